"""File sources.

A source is a file, or a folder of part files, whose name matches its role's
pattern.  Spark resolves the patterns and names the files of a scan; nothing is
opened on the driver.  Inside a scan a row's role and snapshot come from its
``_metadata.file_path``.  Header lines are removed by a per-row filter instead
of a peek at the first file, so files with and without a header can be mixed.
"""

from __future__ import annotations

from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import header_row
from .schemas import HEADER_KEY, SCHEMAS, TAGGED_SCHEMA

# File-name pattern of each source role.  ``http`` and ``ldap``
# accept either letter case.
ROLE_GLOBS = {
    "logon": "logon*.csv",
    "device": "device*.csv",
    "http": "[hH][tT][tT][pP]*.csv",
    "ldap": "[lL][dD][aA][pP]*.csv",
    "parquet": "*.parquet",
}


def _entry_of(path: str, glob: str) -> str | None:
    """The path of the file or folder that matches ``glob`` and holds ``path``."""
    head, _, name = path.rpartition("/")
    folder = unquote(head.rpartition("/")[2])
    if fnmatchcase(folder, glob):
        return head
    return path if fnmatchcase(unquote(name), glob) else None


def _list(spark: SparkSession, data_dir: str, glob: str) -> list[str]:
    """Sources of the folder itself whose name matches, as Spark resolves the pattern."""
    base = data_dir.rstrip("/")
    try:
        files = spark.read.text(f"{base}/{glob}").inputFiles()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    # a folder that is itself named like a source holds its own files only
    own = unquote(urlparse(base).path).rpartition("/")[2]
    found = {_entry_of(f, glob) if unquote(f.rpartition("/")[0].rpartition("/")[2]) != own else f for f in files}
    return sorted(f for f in found if f)


def detect_sources(spark: SparkSession, data_dir: str) -> dict[str, list[str]]:
    """Map role -> sorted source paths, keeping only roles with at least one.

    The Parquet role maps to one glob over the entries of the folder itself, so
    a partitioned table keeps its partition columns and nested tables stay out.
    """
    found = {}
    for role, glob in ROLE_GLOBS.items():
        paths = _list(spark, data_dir, glob)
        if role == "parquet" and not paths:
            # partitioned tables have their files deeper
            try:
                paths = spark.read.parquet(f"{data_dir.rstrip('/')}/{glob}").inputFiles()
            except AnalysisException as e:
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        if paths:
            found[role] = [f"{data_dir}/{glob}"] if role == "parquet" else paths
    return found


def entry_name(sources: list[str], path: str | Column = "_metadata.file_path") -> Column:
    """The source a row was read from: the name of its file, or of the folder of part files.

    ``sources`` are the paths of one folder's sources, which tell how deep it lies.
    """
    depth = len(urlparse(sources[0]).path.rstrip("/").split("/"))
    col = F.col(path) if isinstance(path, str) else path
    return F.split_part(F.regexp_replace(col, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), F.lit("/"), F.lit(depth))


def load_events(spark: SparkSession, found: dict[str, list[str]]) -> DataFrame:
    """All activity logs as one tagged stream ``(user, src, key, date, activity)``, one scan.

    The three schemas have the same shape, so one permissive CSV scan reads
    them; the role of a row comes from the name of its source, and its header
    filter from the role.
    """
    roles = [r for r in ("logon", "device", "http") if r in found]
    names = TAGGED_SCHEMA.fieldNames()
    paths = [p for r in roles for p in found[r]]
    name = F.lower(entry_name(paths))
    src = reduce(lambda c, r: c.when(name.startswith(r), r), roles, F.when(F.lit(False), ""))
    rows = (spark.read.schema(TAGGED_SCHEMA).option("header", "false").option("mode", "PERMISSIVE")
            .csv(paths).withColumn("src", src))
    headers = {r: header_row(names, HEADER_KEY[r], SCHEMAS[r].fieldNames()) for r in roles}
    # the role is looked up for rows only that some role's header reads like
    header = reduce(lambda a, b: a | b, headers.values()) & reduce(
        lambda c, r: c.when(F.col("src") == r, headers[r]), roles, F.when(F.lit(False), F.lit(False)))
    return rows.where(~header).select(
        "user", "src", F.when(F.col("src") == "http", F.col("last")).otherwise(F.col("pc")).alias("key"),
        "date", F.when(F.col("src") == "logon", F.col("last")).alias("activity"))


def load_log(spark: SparkSession, paths: list[str], role: str,
             strict_header: bool = False) -> DataFrame:
    """Fixed-schema permissive CSV scan of one source role, header lines removed.

    Short rows get nulls, extra fields are dropped (CSV ``PERMISSIVE``).
    Columns are positional: a header with reordered names is still read by
    position, as the source files define no header.  ``strict_header=True``
    runs one extra job and raises if any header line names the columns in a
    different order than the schema.
    """
    schema = SCHEMAS[role]
    df = (spark.read.schema(schema)
          .option("header", "false")
          .option("mode", "PERMISSIVE")
          .csv(paths))
    is_header = header_row(schema.fieldNames(), HEADER_KEY[role])
    if strict_header:
        in_order = reduce(lambda a, b: a & b, [
            F.coalesce(F.lower(F.trim(F.col(c))) == c.lower(), F.lit(False))
            for c in schema.fieldNames()])
        bad = df.where(is_header & ~in_order).limit(1).collect()
        if bad:
            raise ValueError(f"{role}: header line {list(bad[0])} does not match the "
                             f"column order {schema.fieldNames()}")
    return df.where(~is_header)


def parse_lines(lines: DataFrame, role: str, line_col: str = "line") -> DataFrame:
    """CSV lines of one source role as its columns plus ``malformed``, header lines removed.

    The same schema and rules as :func:`load_log`, for lines that are already
    a column (a text file, a message value).  ``malformed`` marks lines with
    too few or too many fields; they stay, with nulls or without the excess.
    A null or blank line gives a row of nulls that is malformed.
    """
    schema = SCHEMAS[role]
    fields = ", ".join(f"`{c}` string" for c in schema.fieldNames())
    parsed = F.from_csv(F.coalesce(F.col(line_col), F.lit("")), f"{fields}, _bad string",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(F.col(line_col).alias("_line"), parsed.alias("_row")).select(
        *[F.col("_row")[c].alias(c) for c in schema.fieldNames()],
        (F.col("_row._bad").isNotNull() | (F.trim(F.coalesce("_line", F.lit(""))) == "")).alias("malformed"))
    return rows.where(~header_row(schema.fieldNames(), HEADER_KEY[role]))


def load_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """A generic user table stored as Parquet, returned as it is."""
    return spark.read.parquet(*paths)


def read_snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All directory snapshots, with ``snapshot`` = the name of the file or folder."""
    schema = SCHEMAS["ldap"]
    rows = (spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE").csv(paths)
            .withColumn("snapshot", entry_name(paths)))
    return rows.where(~header_row(schema.fieldNames(), HEADER_KEY["ldap"]))


def latest_snapshot_paths(paths: list[str]) -> list[str]:
    """The files whose name is the greatest in lower case (the latest snapshot), from the listing."""
    if not paths:
        return []
    last = max(p.rsplit("/", 1)[-1].lower() for p in paths)
    return [p for p in paths if p.rsplit("/", 1)[-1].lower() == last]


def load_directory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Latest directory snapshot as ``(user, role)``, one row per user.

    The latest snapshot is known from the file listing, so only its file is
    read, once; older monthly snapshots are never opened.
    """
    from ..operators.features import directory_roles

    return directory_roles(load_log(spark, latest_snapshot_paths(paths), "ldap"))
