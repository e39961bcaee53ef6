"""Feature operators: quirks of the log aggregation, both physical forms."""

from pyspark.sql import functions as F

from cohortlens.functions.timeparse import parse_event_time
from cohortlens.operators import features as feat
from cohortlens.sources import tables as tb

from conftest import SF

LOG = "id string, date string, user string, pc string, activity string"
HTTP = "id string, date string, user string, pc string, url string"


def test_mixed_date_spellings(spark):
    rows = [("01/04/2010 07:12:31",), ("2010-01-04 07:12:31",), ("1/4/2010 7:12",),
            ("junk",), (None,), ("2010-13-45 99:99:99",)]
    df = spark.createDataFrame(rows, "d string")
    got = [r[0] for r in df.select(F.hour(parse_event_time("d"))).collect()]
    assert got == [7, 7, 7, None, None, None]


def _logon(spark):
    return spark.createDataFrame([
        ("1", "01/04/2010 07:12:31", "U1", "PC-1", "Logon"),     # after hours
        ("2", "01/04/2010 09:00:00", "U1", "PC-2", "Logoff"),
        ("3", "01/04/2010 18:00:00", "U1", "PC-1", "Logon"),     # after hours (>= 18)
        ("4", "garbage", "U1", None, "Logon"),                   # null hour, null pc
        ("5", "01/05/2010 10:00:00", "U2", "PC-9", "Logon"),     # one event
        ("6", "01/05/2010 10:00:00", None, "PC-9", "Logon"),     # null user
    ], LOG)


def _device(spark):
    return spark.createDataFrame([
        ("1", "1/4/2010 20:01", "U3", "PC-3", "Connect"),        # device-only user
        ("2", "1/4/2010 10:01", "U1", "PC-1", "Connect"),
    ], LOG)


def _http(spark):
    return spark.createDataFrame([
        ("1", "2010-01-04 10:00:00", "U1", "PC-1", "http://a"),
        ("2", "2010-01-04 23:00:00", "U1", "PC-1", "http://a"),
        ("3", "2010-01-04 11:00:00", "U2", "PC-9", "http://b"),
    ], HTTP)


def _rows(df):
    return {r["user"]: r.asDict() for r in df.collect()}


def test_logon_features_quirks(spark):
    got = _rows(feat.logon_features(_logon(spark)))
    assert set(got) == {"U1", "U2"}                      # null user dropped
    u1 = got["U1"]
    assert u1["logon_count"] == 4
    assert u1["logon_distinct_pcs"] == 2                 # null pc not counted
    assert u1["afterhours_logons"] == 2                  # null hour is in-hours
    assert u1["logon_events"] == 3 and u1["logoff_events"] == 1
    assert abs(u1["logon_avg_hour"] - (7 + 9 + 18) / 3) < 1e-12
    assert got["U2"]["logon_hour_std"] is None           # one row: no sample std


def test_both_forms_agree_and_fill(spark):
    directory = spark.createDataFrame([("U1", "Analyst"), ("U3", "IT Admin")], "user string, role string")
    a = _rows(feat.user_features(_logon(spark), _device(spark), _http(spark), directory))
    b = _rows(feat.user_features_joined(_logon(spark), _device(spark), _http(spark), directory))
    assert set(a) == {"U1", "U2", "U3"}
    for u in a:
        for k, v in a[u].items():
            if isinstance(v, float):
                assert abs(v - b[u][k]) < 1e-9, (u, k)
            else:
                assert v == b[u][k], (u, k)
    assert a["U3"]["logon_count"] == 0 and a["U3"]["device_events"] == 1
    assert a["U3"]["afterhours_device"] == 1
    assert a["U2"]["logon_hour_std"] == 0.0              # null std filled with 0
    assert a["U2"]["role"] is None
    assert a["U1"]["http_distinct_urls"] == 1 and a["U1"]["afterhours_http"] == 1


def test_unfilled_keeps_nulls(spark):
    a = _rows(feat.user_features(_logon(spark), _device(spark), None, fill=False))
    b = _rows(feat.user_features_joined(_logon(spark), _device(spark), None, fill=False))
    assert a == b
    assert a["U3"]["logon_count"] is None and a["U3"]["logon_distinct_pcs"] is None


def test_missing_sources_drop_columns(spark):
    got = feat.user_features(None, _device(spark), None)
    assert got.columns == ["user"] + feat.DEVICE_COLUMNS


def test_latest_directory(spark):
    snaps = spark.createDataFrame([
        ("A", "U1", "e", "d", "Analyst", "LDAP-2010-01"),
        ("B", "U2", "e", "d", "Engineer", "LDAP-2010-01"),   # leaves after January
        ("A", "U1", "e", "d", "Analyst", "LDAP-2010-02"),
        ("C", "U3", "e", "d", "Scientist", "LDAP-2010-02"),
        ("C", "U3", "e", "d", "Admin", "LDAP-2010-02"),       # listed twice
        ("X", None, "e", "d", "Ghost", "LDAP-2010-02"),
    ], "employee_name string, user_id string, email string, domain string, role string, "
       "snapshot string")
    got = {r["user"]: r["role"] for r in feat.latest_directory(snaps).collect()}
    assert got == {"U1": "Analyst", "U3": "Admin"}


def test_forms_agree_on_driver_tables(spark):
    logs = tb.activity_logs(spark, SF)
    d = feat.latest_directory(tb.directory_snapshots(spark, SF))
    a = feat.user_features(logs["logon"], logs["device"], logs["http"], d)
    b = feat.user_features_joined(logs["logon"], logs["device"], logs["http"], d)
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect())
    assert ra == rb and len(ra) > 0


def test_one_scan_event_stream_equals_three_logs(spark):
    logs = tb.activity_logs(spark, SF)
    d = feat.latest_directory(tb.directory_snapshots(spark, SF))
    for fill, exact in ((True, True), (False, True), (True, False)):
        a = feat.user_features(logs["logon"], logs["device"], logs["http"], d,
                               fill=fill, exact_distinct=exact)
        b = feat.user_features_from_events(tb.activity_events(spark, SF), d,
                                           fill=fill, exact_distinct=exact)
        assert a.columns == b.columns
        ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                    for r in a.collect())
        rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                    for r in b.collect())
        assert ra == rb and len(ra) > 0


def test_event_stream_reads_events_once(spark):
    d = feat.latest_directory(tb.directory_snapshots(spark, SF))
    df = feat.user_features_from_events(tb.activity_events(spark, SF), d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1


def test_approx_distinct_option(spark):
    got = _rows(feat.user_features(_logon(spark), _device(spark), _http(spark),
                                   exact_distinct=False))
    assert got["U1"]["logon_distinct_pcs"] == 2


def test_counts_only_fill_leaves_means(spark):
    got = _rows(feat.user_features(_logon(spark), _device(spark), None, fill="counts_only"))
    assert got["U3"]["logon_count"] == 0 and got["U3"]["logon_avg_hour"] is None
    assert got["U2"]["logon_hour_std"] is None


def test_source_quality_counts(spark):
    from cohortlens.operators.quality import source_quality
    got = {r["source"]: r for r in source_quality({"logon": _logon(spark)}).collect()}
    assert got["logon"]["rows"] == 6 and got["logon"]["null_users"] == 1
    assert got["logon"]["unparsed_dates"] == 1


def test_source_quality_one_scan_equals_per_log(spark):
    from cohortlens.operators.quality import source_quality, source_quality_events
    a = sorted(source_quality(tb.activity_logs(spark, SF)).collect())
    b = sorted(source_quality_events(tb.activity_events(spark, SF)).collect())
    assert a == b and len(a) == 3
    empty = tb.activity_events(spark, SF).where("src = 'device'")
    got = {r["source"]: r["rows"] for r in source_quality_events(empty).collect()}
    assert got["logon"] == 0 and got["http"] == 0 and got["device"] > 0


def test_hot_user_holding_a_third_of_rows(spark):
    """One user with a third of all rows: both forms agree, counts stay whole."""
    rows = []
    for i in range(3000):
        user = "HOT" if i % 3 == 0 else f"U{i % 97}"
        rows.append((str(i), f"01/{1 + i % 28:02d}/2010 {i % 24:02d}:00:00", user,
                     f"PC-{i % 13}", "Logon" if i % 2 else "Logoff"))
    logon = spark.createDataFrame(rows, LOG).repartition(8)
    web = spark.createDataFrame(
        [(str(i), "2010-01-04 10:00:00", "HOT" if i % 3 == 0 else f"U{i % 97}", "PC-1",
          f"http://s{i}.example") for i in range(3000)], HTTP).repartition(8)
    a = _rows(feat.user_features(logon, None, web))
    b = _rows(feat.user_features_joined(logon, None, web))
    assert a["HOT"]["logon_count"] == 1000 and a["HOT"]["http_distinct_urls"] == 1000
    assert a["HOT"]["logon_distinct_pcs"] == 13
    for u in a:
        for k, v in a[u].items():
            assert (abs(v - b[u][k]) < 1e-9) if isinstance(v, float) else v == b[u][k]


def test_single_pass_approx_matches_exact_on_small_sets(spark):
    logs = tb.activity_logs(spark, SF)
    d = feat.latest_directory(tb.directory_snapshots(spark, SF))
    exact = feat.user_features(logs["logon"], logs["device"], logs["http"], d)
    approx = feat.user_features(logs["logon"], logs["device"], logs["http"], d,
                                exact_distinct=False)
    assert approx.columns == exact.columns
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in approx.collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in exact.collect())
    assert ra == rb                      # HyperLogLog is exact at these cardinalities
    def rounded(df):
        # the deviation of the single pass may differ in the last place between layouts
        return {u: {c: round(v, 9) if isinstance(v, float) else v for c, v in r.items()}
                for u, r in _rows(df).items()}

    unfilled = rounded(feat.user_features(_logon(spark), _device(spark), None, fill=False,
                                          exact_distinct=False))
    assert unfilled == rounded(feat.user_features(_logon(spark), _device(spark), None, fill=False))


def test_times_parse_as_by_every_format_in_turn(spark):
    """A text goes to the format it is spelled like; all others give what trying each gives."""
    from cohortlens.functions.timeparse import TIMESTAMP_FORMATS

    texts = ["01/02/2010 03:04:05", "2010-01-02 03:04:05", "1/2/2010 3:04", "12/31/2010 23:59", "1/2/2010 13:04",
             "02/30/2010 01:00:00", "2010-02-30 01:00:00", "2/30/2010 1:00", "13/01/2010 01:00", "1/2/2010 3:4",
             "001/2/2010 3:04", "01/02/10 03:04:05", "+12010-01-02 03:04:05", " 1/2/2010 3:04", "1/2/2010 3:04 ",
             "2010/01/02 03:04:05", "n/a 7", "Date", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    plain = F.coalesce(*[F.try_to_timestamp("d", F.lit(f)) for f in TIMESTAMP_FORMATS])
    rows = df.select(parse_event_time("d").cast("string").alias("got"), plain.cast("string").alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert sum(r["got"] is not None for r in rows) >= 5
    # the first thing tried is a format that is kept to its own spelling
    assert "CASE WHEN" in str(parse_event_time("d")).split("try_to_timestamp")[0].upper()
