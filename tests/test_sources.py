"""File sources end to end: discovery, headers, permissive CSV, snapshots, sinks."""

import json
import os

import pytest

from cohortlens.plans.analysis import build_user_features, run_pipeline
from cohortlens.sources.files import detect_sources


def _write(d, name, lines):
    with open(os.path.join(d, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _make_r1(d, n_users=12):
    logon1, logon2, device, http1, http2 = [], ["id,date,user,pc,activity"], [], [], []
    for u in range(n_users):
        user = f"U{u:03d}"
        for j in range(3 + u % 4):
            hour = 7 + (u * 3 + j) % 14
            line = f"L{u}-{j},01/0{1 + j % 5}/2010 {hour:02d}:15:00,{user},PC-{u % 5},{'Logon' if j % 3 else 'Logoff'}"
            (logon1 if j % 2 else logon2).append(line)
        if u % 3 == 0:
            device.append(f"D{u},1/4/2010 {20 if u % 2 else 9}:05,{user},PC-{u},Connect")
        for j in range(u % 5):
            (http1 if j % 2 else http2).append(
                f"H{u}-{j},2010-01-04 {8 + j}:00:00,{user},PC-{u},http://s{j}.example")
    logon1.append("short,row")                                  # 2 fields
    logon1.append("X1,01/04/2010 10:00:00,U000,PC-0,Logon,extra")  # 6 fields
    _write(d, "logon_a.csv", logon1)
    _write(d, "logon_b.csv", logon2)                            # header in the second file
    _write(d, "device.csv", device)
    _write(d, "HTTP.csv", http1)
    _write(d, "http2.csv", http2)                               # both letter cases
    ldap1 = ["employee_name,user_id,email,domain,role"] + [
        f"Name {u},U{u:03d},u{u}@x.example,x.example,{'IT Admin' if u < 2 else 'Staff'}"
        for u in range(n_users)]
    ldap2 = [f"Name {u},U{u:03d},u{u}@x.example,x.example,{'IT Admin' if u < 2 else 'Staff'}"
             for u in range(n_users - 1)]                       # last user left
    _write(d, "LDAP-2010-01.csv", ldap1)
    _write(d, "LDAP-2010-02.csv", ldap2)


def test_detect_sources(spark, tmpdir_fresh):
    _make_r1(tmpdir_fresh)
    found = detect_sources(spark, tmpdir_fresh)
    assert set(found) == {"logon", "device", "http", "ldap"}
    assert [os.path.basename(p) for p in found["http"]] == ["HTTP.csv", "http2.csv"]
    assert len(found["logon"]) == 2


def test_build_user_features_from_csv(spark, tmpdir_fresh):
    _make_r1(tmpdir_fresh)
    rows = {r["user"]: r.asDict() for r in build_user_features(spark, tmpdir_fresh).collect()}
    # the 2-field row parses as id='short', date='row', user=null -> dropped;
    # the 6-field row keeps its first five fields
    assert len(rows) == 12
    assert "U000" in rows and rows["U000"]["logon_count"] == 3 + 1
    assert rows["U011"]["role"] is None           # left before the latest snapshot
    assert rows["U000"]["role"] == "IT Admin"
    assert rows["U003"]["device_events"] == 1 and rows["U001"]["device_events"] == 0
    assert rows["U004"]["http_requests"] == 4 and rows["U004"]["http_distinct_urls"] == 4


def test_only_latest_snapshot_file_is_read(spark, tmpdir_fresh):
    from cohortlens.sources.files import latest_snapshot_paths
    paths = ["/d/LDAP-2010-02.csv", "/d/LDAP-2009-12.csv", "/d/ldap-2010-01.csv"]
    # the greatest file name, whatever its letter case
    assert latest_snapshot_paths(paths) == ["/d/LDAP-2010-02.csv"]
    assert latest_snapshot_paths([]) == []
    _make_r1(tmpdir_fresh)
    found = detect_sources(spark, tmpdir_fresh)
    from cohortlens.sources.files import load_directory
    plan = load_directory(spark, found["ldap"])._jdf.queryExecution().executedPlan().toString()
    assert "LDAP-2010-02.csv" in plan and "LDAP-2010-01.csv" not in plan


def test_parquet_fallback_and_missing(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "users.parquet")
    spark.createDataFrame([("U1", 1.0), ("U2", 2.0)], "user string, x double") \
        .write.parquet(p)
    df = build_user_features(spark, tmpdir_fresh)
    assert sorted(df.columns) == ["user", "x"] and df.count() == 2
    empty = os.path.join(tmpdir_fresh, "empty")
    os.makedirs(empty)
    with pytest.raises(FileNotFoundError):
        build_user_features(spark, empty)


def test_run_pipeline_end_to_end(spark, tmpdir_fresh):
    data = os.path.join(tmpdir_fresh, "r1")
    os.makedirs(data)
    _make_r1(data, n_users=40)
    out = os.path.join(tmpdir_fresh, "out")
    users, metrics, details = run_pipeline(spark, data, out, k_baseline=3, k_min=2, k_max=4)
    back = spark.read.option("header", True).csv(os.path.join(out, "clustered_users"))
    assert back.count() == users.count() == 40
    for c in ("prediction_baseline", "prediction_bestk", "prediction_cdpc"):
        assert c in back.columns
        assert back.where(back[c].isNull()).count() == 0
    recs = []
    mdir = os.path.join(out, "metrics")
    for name in os.listdir(mdir):
        if name.startswith("part-"):
            with open(os.path.join(mdir, name)) as f:
                recs += [json.loads(line) for line in f if line.strip()]
    assert [r["method"] for r in recs][0] == "KMeans-Baseline"
    assert len(recs) == 3
    for r in recs:
        assert sum(r["cluster_sizes"].values()) == users.count()
        assert all(isinstance(k, str) for k in r["cluster_sizes"])
        assert -1.0 <= r["silhouette"] <= 1.0


def test_strict_header_rejects_reordered_columns(spark, tmpdir_fresh):
    from cohortlens.sources.files import load_log
    _write(tmpdir_fresh, "logon.csv", ["date,id,user,pc,activity",
                                       "L1,01/04/2010 07:12:31,U1,PC-1,Logon"])
    path = [os.path.join(tmpdir_fresh, "logon.csv")]
    assert load_log(spark, path, "logon").count() == 1          # positional by default
    with pytest.raises(ValueError):
        load_log(spark, path, "logon", strict_header=True)


def test_parquet_sink_round_trip(spark, tmpdir_fresh):
    from cohortlens.sources.sinks import write_labelled_users
    df = spark.createDataFrame([("U1", 0), ("U2", 1)], "user string, prediction int")
    out = os.path.join(tmpdir_fresh, "users")
    write_labelled_users(df, out, fmt="parquet")
    assert sorted(spark.read.parquet(out).collect()) == sorted(df.collect())


def test_folders_of_part_files_are_sources(spark, tmpdir_fresh):
    plain = os.path.join(tmpdir_fresh, "plain")
    nested = os.path.join(tmpdir_fresh, "logon-like.csv")       # the folder itself is named like a source
    os.makedirs(plain)
    os.makedirs(nested)
    _make_r1(plain)
    _make_r1(nested)
    folders = os.path.join(tmpdir_fresh, "folders")
    for name in os.listdir(plain):
        spark.read.text(os.path.join(plain, name)).repartition(2).write.text(os.path.join(folders, name))
    os.makedirs(os.path.join(folders, "logon_empty.csv"))
    def rows(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)

    want = rows(build_user_features(spark, plain))
    assert {r: len(p) for r, p in detect_sources(spark, folders).items()} == {
        "logon": 2, "device": 1, "http": 2, "ldap": 2}
    for data, form in ((folders, "aggregate"), (folders, "joined"), (nested, "aggregate"), (plain, "joined")):
        got = build_user_features(spark, data, form=form)
        assert rows(got.select(*build_user_features(spark, plain).columns)) == want, (data, form)


def test_logs_are_read_in_one_scan(spark, tmpdir_fresh):
    _make_r1(tmpdir_fresh)
    plan = build_user_features(spark, tmpdir_fresh)._jdf.queryExecution().optimizedPlan().toString()
    plan = plan.replace("Relation [", "FileScan csv [")
    assert plan.count("FileScan csv") == 2                     # the logs, and the latest snapshot
    assert "LDAP-2010-01.csv" not in plan


def test_partitioned_parquet_is_detected(spark, tmpdir_fresh):
    df = spark.createDataFrame([("U1", 1, "a"), ("U2", 2, "b")], "user string, v int, dt string")
    df.write.partitionBy("dt").parquet(os.path.join(tmpdir_fresh, "users.parquet"))
    assert list(detect_sources(spark, tmpdir_fresh)) == ["parquet"]


# --- sinks ---------------------------------------------------------------------

def _users(spark):
    return spark.createDataFrame(
        [("U1", 0.1, None, 1), ("", 2.5, 'say "hi", x', None), (None, float("nan"), "two\nlines", 3),
         ("U1", 0.1, None, 1), (" pad ", -0.0, "", 4)], "user string, x double, note string, p int")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_verified_sink_round_trip(spark, tmpdir_fresh, fmt):
    from cohortlens.sources.sinks import read_labelled_users, write_labelled_users
    out = os.path.join(tmpdir_fresh, "users")
    df = _users(spark)
    for _ in range(2):                                         # the second call replaces the first
        assert write_labelled_users(df, out, fmt) == 5
    back = read_labelled_users(spark, out, df.schema, fmt)
    if fmt == "csv":                                           # an empty string comes back as null
        df = df.replace("", None)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert os.listdir(tmpdir_fresh) == ["users"]               # no staging or replaced copy is left
    assert write_labelled_users(df.limit(0), os.path.join(tmpdir_fresh, "none"), fmt) == 0


def test_a_damaged_result_is_not_published(spark, tmpdir_fresh):
    from cohortlens.sources.sinks import SinkMismatch, write_verified
    out = os.path.join(tmpdir_fresh, "users")
    df = _users(spark)
    write_verified(df, out, lambda d, to: d.write.parquet(to), spark.read.parquet)
    with pytest.raises(SinkMismatch):
        write_verified(df, out, lambda d, to: d.write.parquet(to), lambda at: spark.read.parquet(at).limit(3))
    with pytest.raises(SinkMismatch):
        write_verified(df, out, lambda d, to: d.write.parquet(to),
                       lambda at: spark.read.parquet(at).withColumn("p", spark.range(1).selectExpr("7").scalar()))
    assert spark.read.parquet(out).count() == 5


def test_metrics_as_lines_and_as_one_array(spark, tmpdir_fresh):
    from cohortlens.operators.evaluate import METRIC_SCHEMA, metrics_frame
    from cohortlens.sources.sinks import read_metrics, write_metrics
    records = [{"method": f"m{i}", "runtime_s": 0.5, "n_clusters": 2, "silhouette": 0.25, "inertia": 1.0,
                "within_ss": 1.0, "cluster_sizes": {10: 3, 2: 4}, "nmi": None, "ari": None, "purity": None}
               for i in (2, 1)]
    frame = metrics_frame(spark, records)
    for form in ("lines", "array"):
        out = os.path.join(tmpdir_fresh, form)
        write_metrics(frame, out, form)
        got = read_metrics(spark, out, METRIC_SCHEMA).collect()
        assert [r["method"] for r in got] == ["m2", "m1"]
        assert got[0]["cluster_sizes"] == {"10": 3, "2": 4} and got[0]["nmi"] is None
    text = "".join(r[0] for r in spark.read.text(os.path.join(tmpdir_fresh, "array")).collect())
    assert [r["method"] for r in json.loads(text)] == ["m2", "m1"]
    with pytest.raises(ValueError):
        write_metrics(frame, os.path.join(tmpdir_fresh, "x"), "xml")


# --- restart -------------------------------------------------------------------

def test_a_killed_run_goes_on_after_the_fits(spark, tmpdir_fresh, monkeypatch):
    from cohortlens.plans import analysis
    data, out, whole = (os.path.join(tmpdir_fresh, x) for x in ("r1", "out", "whole"))
    os.makedirs(data)
    _make_r1(data, n_users=40)
    kw = dict(k_baseline=3, k_min=2, k_max=4)
    want = run_pipeline(spark, data, whole, **kw)[0].collect()

    def killed(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(analysis, "evaluate_many", killed)
        with pytest.raises(KeyboardInterrupt):
            run_pipeline(spark, data, out, **kw)
    with monkeypatch.context() as m:
        for name in ("seeded_starts", "kmeans", "kmeans_sweep", "density_peaks", "build_user_features"):
            m.setattr(analysis, name, killed)
        users, metrics, details = run_pipeline(spark, data, out, **kw)
        assert sorted(users.collect(), key=str) == sorted(want, key=str)
        assert metrics.count() == 3 and details["sweep"].scores
        # a finished run writes nothing again
        m.setattr(analysis, "write_labelled_users", killed)
        run_pipeline(spark, data, out, **kw)
        # other parameters are another run
        with pytest.raises(KeyboardInterrupt):
            run_pipeline(spark, data, out, **{**kw, "k_max": 5})
    back = spark.read.option("header", True).csv(os.path.join(out, "clustered_users"))
    assert back.count() == 40
    # so is changed input
    _write(data, "logon_c.csv", ["N1,01/04/2010 07:12:31,U999,PC-1,Logon"])
    assert run_pipeline(spark, data, out, **kw)[0].count() == 41


def test_snapshots_are_written_by_many_tasks(spark, tmp_path):
    """One small file of people must not be listed month by month in a single task."""
    from cohortlens.queries import source_folder
    from cohortlens.sources import tables as tb

    spark.range(200).selectExpr(
        "id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 5 AS INT) AS c_nationkey",
        "CAST(id * 97 % 10000 - 900 AS DOUBLE) AS c_acctbal", "concat('S', id % 3) AS c_mktsegment",
    ).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(50).selectExpr(
        "id AS event_id", "timestamp'2010-01-02 08:30:00' AS ts", "id % 7 AS user_id",
        "element_at(array('click', 'view', 'purchase', 'error'), CAST(id % 4 + 1 AS INT)) AS event_type",
        "0D AS value", "concat('{\"k\": ', id, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    folder = source_folder(spark, str(tmp_path))
    assert spark.sparkContext.defaultParallelism > 1
    assert len(spark.read.text(f"{folder}/LDAP-2010-12.csv").inputFiles()) > 1
    assert len(spark.read.text(f"{folder}/ldap-2010-01.csv").inputFiles()) > 1
    plain, dealt = (sorted(map(str, tb.directory_snapshots(spark, str(tmp_path), n).collect())) for n in (None, 3))
    assert plain == dealt
    assert {r[0] for r in tb.directory_snapshots(spark, str(tmp_path)).select("snapshot").distinct().collect()} == {
        f"LDAP-2010-{m:02d}" for m in range(1, 13)}
