"""Dense-vector arithmetic on ``array<double>`` columns.

All of it compiles to Spark higher-order functions, so distances run inside
the JVM next to the data.  Small matrices (cluster centres, peaks) enter the
plan as one constant-folded literal; their size is checked first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound on the number of doubles embedded as a literal (centres x dims).
MAX_LITERAL_DOUBLES = 2_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_dist(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance between two equal-length arrays."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def sq_norm(a: str | Column) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda acc, v: acc + v * v)


def _double_sql(v: float) -> str:
    v = float(v)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return repr(v) + "D"


def matrix_literal(rows) -> Column:
    """``array<array<double>>`` literal from a small list of vectors.

    Built as one SQL expression (one call into the JVM); ``repr`` keeps every
    double exact.  Raises when the matrix is larger than MAX_LITERAL_DOUBLES.
    """
    rows = [list(r) for r in rows]
    total = sum(len(r) for r in rows)
    if total > MAX_LITERAL_DOUBLES:
        raise ValueError(
            f"matrix of {total} doubles exceeds the literal bound {MAX_LITERAL_DOUBLES}; "
            "use fewer centres or fewer dimensions")
    if not rows:
        return F.expr("CAST(array() AS array<array<double>>)")
    body = ", ".join("array(" + ", ".join(_double_sql(v) for v in r) + ")" for r in rows)
    return F.expr(f"array({body})")


def nearest_index(x: str | Column, centres: Column, k: int) -> Column:
    """``struct(dist, idx)`` of the closest of ``k`` centres; ties go to the lower index."""
    x = _col(x)
    cand = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.struct(sq_dist(x, F.element_at(centres, i + 1)).alias("dist"),
                           i.alias("idx")),
    )
    return F.array_min(cand)
