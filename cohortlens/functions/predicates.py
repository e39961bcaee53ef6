"""Row predicates shared by the feature operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Working hours are [8, 18); anything else is after hours.
WORKDAY_START = 8
WORKDAY_END = 18


def is_after_hours(hour: str | Column = "hour", start: int = WORKDAY_START,
                   end: int = WORKDAY_END) -> Column:
    """True outside ``[start, end)``; null when the hour is null.

    Aggregate it with ``count_if`` so an unknown hour counts as in-hours.
    """
    h = F.col(hour) if isinstance(hour, str) else hour
    return (h < start) | (h >= end)


def header_row(columns: list[str], key_name: str, names: list[str] | None = None) -> Column:
    """True when every cell, trimmed and lower-cased, is a column name and one is ``key_name``.

    ``names`` are the column names of the source where they differ from ``columns``.

    Used as a per-row filter so that a header line is dropped wherever it
    occurs: in the first file, a later file, or not at all.  A row of data with
    one cell that happens to read like the key column stays.
    """
    names = [c.strip().lower() for c in names or columns]
    cells = [F.coalesce(F.lower(F.trim(F.col(c))), F.lit("")) for c in columns]
    every = reduce(lambda a, b: a & b, [c.isin(names) for c in cells])
    return every & reduce(lambda a, b: a | b, [c == key_name.strip().lower() for c in cells])
