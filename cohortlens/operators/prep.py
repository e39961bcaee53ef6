"""Feature preparation (P5, A9, M1-M6, X2) with native expressions.

``fit_features`` runs a fixed, small number of aggregation jobs whatever the
row count (column cardinalities, numeric moments, category frequencies) and
keeps only per-column statistics on the driver: at most ``max_categories``
labels per categorical column.  ``FeatureModel.transform`` is then one
projection to ``array<double>``, so new rows can be scored with the same
model.  The semantics are those of MLlib's Imputer(mean) -> StringIndexer
(keep) -> OneHotEncoder(keep) -> VectorAssembler -> StandardScaler(withMean,
withStd) chain, with two fixes: integer columns are imputed with the exact
mean (cast to double first), and label columns are never used as features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A string column is categorical when it holds at most this many
# distinct values (null counts as one); ground-truth column names, searched in
# this order.
MAX_CATEGORIES = 50
LABEL_COLUMNS = ("label", "insider", "malicious")


def find_label_column(df: DataFrame, candidates=LABEL_COLUMNS) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def _string_cols(df: DataFrame, exclude) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def string_cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, n_values)``: distinct values per string column, null counted.

    One aggregation job for all columns.
    """
    cols = columns if columns is not None else _string_cols(df, ())
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_values bigint")
    row = df.agg(*[
        (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull()).cast("bigint")).alias(f"_{i}")
        for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', _{i}" for i, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, n_values)")


# Sketches hold up to 2 ** SKETCH_BITS hashes and count exactly below that.
SKETCH_BITS = 12


def _value_count(c: str) -> Column:
    """Distinct values of a string column, null counted, as a mergeable aggregate of bounded size.

    A sketch keeps the smallest hashes of the values, so a task sends at most
    2 ** SKETCH_BITS of them whatever the column holds.  Exact up to that many
    values, an estimate beyond; ``MAX_CATEGORIES`` is far below.
    """
    # by the hash, since sketches of strings leave the empty one out
    hashed = F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c)))
    sketch = F.theta_sketch_agg(hashed, F.lit(SKETCH_BITS))
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)) + F.coalesce(
        F.max(F.col(c).isNull()).cast("bigint"), F.lit(0))


def column_types(df: DataFrame, id_col: str = "user", exclude=LABEL_COLUMNS,
                 max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """``(column, kind)`` with kind numerical / categorical / dropped (P5).

    String columns are told apart by one aggregate of sketches: no value is
    shuffled and no row is repeated per column.
    """
    if max_categories >= 1 << SKETCH_BITS:
        raise ValueError(f"at most {(1 << SKETCH_BITS) - 1} categories")
    skip = {id_col, *exclude}
    rows, strings = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StringType):
            strings.append(f.name)
        else:
            rows.append((f.name, "numerical" if isinstance(f.dataType, T.NumericType) else "dropped"))
    fixed = df.sparkSession.createDataFrame(rows, "column string, kind string")
    if not strings:
        return fixed
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), _value_count(c).alias("n"))
                              for c in strings]).alias("all")).select(F.inline("all"))
    return fixed.unionByName(counts.select("column", F.when(
        F.col("n") <= max_categories, "categorical").otherwise("dropped").alias("kind")))


def detect_column_types(df: DataFrame, id_col: str = "user", exclude=LABEL_COLUMNS,
                        max_categories: int = MAX_CATEGORIES) -> tuple[list[str], list[str]]:
    """(numerical, categorical) column names in schema order."""
    kinds = {r["column"]: r["kind"] for r in column_types(df, id_col, exclude, max_categories).collect()}
    return tuple([c for c in df.columns if kinds.get(c) == kind] for kind in ("numerical", "categorical"))


def _valid(c: str) -> Column:
    """Value as double, null when missing or NaN (Imputer treats both as missing)."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass
class FeatureModel:
    """Fitted preparation: everything needed to turn rows into feature arrays."""

    numerical: list[str]
    categorical: list[str]
    surrogates: dict[str, float]
    labels: dict[str, list[str]]
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)
    features_col: str = "features"
    n_rows: int = 0

    @property
    def dim_names(self) -> list[str]:
        names = [f"{c}_imp" for c in self.numerical]
        for c in self.categorical:
            names += [f"{c}_ohe_{i}" for i in range(len(self.labels[c]) + 1)]
        return names

    def imputed(self, c: str) -> Column:
        return F.coalesce(_valid(c), F.lit(self.surrogates[c]))

    def index(self, c: str) -> Column:
        """StringIndexer(keep): frequency order, unseen or null -> len(labels)."""
        labels = self.labels[c]
        if not labels:
            return F.lit(0).cast("int")
        m = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
        return F.coalesce(F.element_at(m, F.col(c)), F.lit(len(labels))).cast("int")

    def raw_columns(self) -> list[Column]:
        cols = [self.imputed(c) for c in self.numerical]
        for c in self.categorical:
            idx = self.index(c)
            cols += [F.when(idx == i, F.lit(1.0)).otherwise(F.lit(0.0))
                     for i in range(len(self.labels[c]) + 1)]
        return cols

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``: imputed, one-hot encoded, centred and scaled."""
        scaled = []
        for x, m, s in zip(self.raw_columns(), self.mean, self.std):
            scaled.append(F.lit(0.0) if s == 0 else (x - F.lit(m)) / F.lit(s))
        return df.withColumn(self.features_col, F.array(*scaled).cast("array<double>"))


def _moment_aggs(numerical: list[str]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(numerical):
        v = _valid(c)
        aggs += [F.count(v).alias(f"_c{i}"), F.avg(v).alias(f"_m{i}"),
                 F.stddev_samp(v).alias(f"_s{i}")]
    return aggs


def _category_counts(df: DataFrame, columns: list[str],
                     max_categories: int = MAX_CATEGORIES) -> dict[str, list]:
    """``{column: [(value, count), ...]}`` for the columns with at most ``max_categories`` values.

    One job.  Values are counted on the executors; the number of values per
    column is counted there too, and only columns within the bound come back,
    so at most ``len(columns) * max_categories`` rows reach the driver.  The
    per-column table joined back has one row per column.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("val"))
        for i, c in enumerate(columns)]))
    values = (df.select(pairs.alias("p")).select("p.col", "p.val")
              .groupBy("col", "val").count())
    small = (values.groupBy("col").agg(F.count(F.lit(1)).alias("_nv"))
             .where(F.col("_nv") <= max_categories).select("col"))
    counts = values.join(F.broadcast(small), "col", "left_semi").collect()
    found = {r["col"] for r in counts}
    return {c: [(r["val"], r["count"]) for r in counts if r["col"] == i]
            for i, c in enumerate(columns) if i in found}


def _build_model(row, numerical: list[str], categorical: list[str], freqs: dict,
                 features_col: str) -> FeatureModel:
    n = int(row["_n"])
    surrogates, mean, std = {}, [], []
    for i, c in enumerate(numerical):
        cnt, m, s = row[f"_c{i}"], row[f"_m{i}"], row[f"_s{i}"]
        if cnt == 0:
            raise ValueError(f"column {c!r} has no value to impute from")
        if not math.isfinite(m) or (s is not None and not math.isfinite(s)):
            raise ValueError(f"column {c!r} holds an infinite value")
        surrogates[c] = float(m)
        # imputed rows sit on the mean, so they add nothing to the squared deviations
        ss = (float(s) ** 2) * (cnt - 1) if s is not None else 0.0
        mean.append(float(m))
        std.append(math.sqrt(ss / (n - 1)) if n > 1 else 0.0)
    labels: dict[str, list[str]] = {}
    for c in categorical:
        mine = freqs[c]
        known = sorted([(v, k) for v, k in mine if v is not None], key=lambda t: (-t[1], t[0]))
        labels[c] = [v for v, _ in known]
        freq = [k for _, k in known] + [sum(k for v, k in mine if v is None)]
        for k in freq:
            p = k / n
            mean.append(p)
            std.append(math.sqrt(n * p * (1 - p) / (n - 1)) if n > 1 else 0.0)
    return FeatureModel(numerical, categorical, surrogates, labels, mean, std, features_col, n)


def fit_features(df: DataFrame, numerical: list[str], categorical: list[str],
                 features_col: str = "features", freqs: dict | None = None) -> FeatureModel:
    """Fit imputation, label order and scaling statistics for given columns.

    One aggregation job for the numeric moments, one for the category
    frequencies (skipped when ``freqs`` already holds them).
    """
    row = df.agg(*_moment_aggs(numerical)).first()
    if categorical and (freqs is None or any(c not in freqs for c in categorical)):
        freqs = _category_counts(df, categorical)
        over = [c for c in categorical if c not in freqs]
        if over:
            raise ValueError(f"categorical columns with more than {MAX_CATEGORIES} values: {over}")
    return _build_model(row, numerical, categorical, freqs or {}, features_col)


def prepare(df: DataFrame, id_col: str = "user", exclude=LABEL_COLUMNS,
            max_categories: int = MAX_CATEGORIES,
            features_col: str = "features") -> tuple[DataFrame, FeatureModel]:
    """Detect column roles, fit, and transform.

    The input is stored once first (checkpoint): fitting reads it twice and
    the transform once more, and it is usually an expensive aggregate.
    """
    from ..plans.lineage import materialize_with

    skip = {id_col, *exclude}
    numerical = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    strings = _string_cols(df, skip)
    # job 1: numeric moments and the value counts of the string columns
    # together; it also stores the input (it reads every partition)
    df, row = materialize_with(df, lambda d: d.agg(
        *_moment_aggs(numerical), *[_value_count(c).alias(f"_h{i}") for i, c in enumerate(strings)]
    ).first())
    categorical = [c for i, c in enumerate(strings) if row[f"_h{i}"] <= max_categories]
    # job 2: the label frequencies
    freqs = _category_counts(df, categorical, max_categories) if categorical else {}
    categorical = [c for c in categorical if c in freqs]
    if not numerical and not categorical:
        raise ValueError("no usable feature column (numeric, or string with few values)")
    model = _build_model(row, numerical, categorical, freqs, features_col)
    return model.transform(df), model

