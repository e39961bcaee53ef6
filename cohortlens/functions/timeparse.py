"""Event-time parsing (D1) and hour of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The date spellings found in the activity logs, tried in this
# order; the first format that parses wins.
TIMESTAMP_FORMATS = (
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "M/d/yyyy H:mm",
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _spelled_like(c: Column, fmt: str) -> Column | None:
    """Whether a text has the length and the first separator of a known format.

    A text fits one of the known formats at most, and no other of them parses it.
    """
    return {
        "MM/dd/yyyy HH:mm:ss": (F.length(c) == 19) & (F.substring(c, 3, 1) == "/"),
        "yyyy-MM-dd HH:mm:ss": (F.length(c) == 19) & (F.substring(c, 5, 1) == "-"),
        "M/d/yyyy H:mm": F.length(c).between(13, 16) & (F.substring_index(c, "/", 1) != c),
    }.get(fmt)


def parse_event_time(c: str | Column, formats=TIMESTAMP_FORMATS) -> Column:
    """First successful parse among ``formats``; null when none parses.

    ``try_to_timestamp`` keeps a bad row from failing the job under ANSI mode
    (plain ``to_timestamp`` raises on the first format that does not match).
    A parse that fails costs many times one that does not, so the format that
    a text is spelled like comes first; whatever it does not parse goes
    through all formats.
    """
    c = _col(c)
    spelled = [(f, _spelled_like(c, f)) for f in formats]
    likely = [F.when(like, F.try_to_timestamp(c, F.lit(f))) for f, like in spelled if like is not None]
    return F.coalesce(*likely, *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def event_hour(df: DataFrame, date_col: str = "date", out: str = "hour",
               formats=TIMESTAMP_FORMATS) -> DataFrame:
    """Add ``out`` = hour of day (0-23, null when the time is unknown).

    String columns are parsed with :func:`parse_event_time`; timestamp columns
    are used as they are.
    """
    dtype = df.schema[date_col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        ts = F.col(date_col)
    else:
        ts = parse_event_time(date_col, formats)
    return df.withColumn(out, F.hour(ts))
