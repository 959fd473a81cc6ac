"""Cleaning and preparing columns: types, scaling, fences, encodings, imputation, weights, names and keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import numeric_columns, require_columns, stored
from loomwork.functions.ordered import quantile_values
from loomwork.operators.neighbours import nearest_rows
from loomwork.operators.profiling import correlations


def clean_names(names: Sequence[str], separator: str = "_") -> list[str]:
    """Lower-cased names without white space; other runs of odd characters become the separator, none at the end."""
    out = [re.sub(r"[^0-9a-z]+", separator, re.sub(r"\s+", "", n.lower())) for n in names]
    return [n.removesuffix(separator) for n in out]


def safe_numeric(df: DataFrame, column: str) -> DataFrame:
    """The column as double; what doesn't parse is null."""
    return df.withColumn(column, F.expr(f"try_cast(`{column}` as double)"))


def classify_columns(df: DataFrame) -> dict[str, str]:
    """numeric, date, categorical or unknown, by type and, for text, by what its values look like (one aggregate)."""
    numeric, kinds = set(numeric_columns(df)), dict(df.dtypes)
    texts = [c for c in df.columns if kinds[c] == "string"]
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in texts:
        aggs += [F.count(c).alias(f"k{c}"), F.count(F.try_to_date(c)).alias(f"d{c}"), F.count_if(F.col(c).rlike("[0-9]")).alias(f"g{c}"), F.count_distinct(c).alias(f"u{c}")]
    s = df.agg(*aggs).first() if texts else None
    out = {}
    for c in df.columns:
        if c in numeric:
            out[c] = "numeric"
        elif kinds[c].startswith(("date", "timestamp")):
            out[c] = "date"
        elif c in texts:
            known = s[f"k{c}"]
            out[c] = "date" if known and s[f"d{c}"] == known else "numeric" if known and s[f"g{c}"] == known else "categorical" if s["n"] and s[f"u{c}"] / s["n"] < 0.05 else "unknown"
        else:
            out[c] = "unknown"
    return out


def categorical_columns(df: DataFrame, share: float = 0.95) -> DataFrame:
    """(variable, categorical): whether distinct values (null is one) are fewer than ``share`` of the rows."""
    aggs = [((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) / F.count(F.lit(1)) < share).alias(c) for c in df.columns]
    return df.agg(*aggs).unpivot([], df.columns, "variable", "categorical")


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """One row with the two figures of each column that ``method`` needs: standard, minmax, robust (exact quartiles)."""
    names = [f"__{k}_{c}" for c in columns for k in ("mid", "size")]
    if method == "robust":
        q = quantile_values(df, columns, (0.25, 0.5, 0.75))
        row = [v for c in columns for v in (q[c][1], None if q[c][1] is None else q[c][2] - q[c][0])]
        return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{n}` double" for n in names))
    pairs = {"standard": lambda c: (F.avg(c), F.stddev_samp(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}
    if method not in pairs:
        raise ValueError(f"no such scaling: {method}")
    figures = [f.cast("double") for c in columns for f in pairs[method](c)]
    return df.agg(*[f.alias(n) for f, n in zip(figures, names, strict=True)])


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mid) / size; columns of size 0 are only shifted."""
    d = df.crossJoin(F.broadcast(scaler))  # one row
    scaled = {c: F.when(F.col(f"__size_{c}") == 0, F.col(c) - F.col(f"__mid_{c}")).otherwise((F.col(c) - F.col(f"__mid_{c}")) / F.col(f"__size_{c}")) for c in columns}
    return d.withColumns(scaled).drop(*scaler.columns)


def fit_fences(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """(low, high) of each column: the quartiles less and plus ``multiplier`` interquartile ranges; None where nothing is known."""
    q = quantile_values(df, columns, (0.25, 0.75))
    return {c: (None, None) if a is None else (a - multiplier * (b - a), b + multiplier * (b - a)) for c, (a, b) in q.items()}


def apply_fences(df: DataFrame, fences: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values beyond their column's fences become null."""
    return df.withColumns({c: F.when(F.col(c).between(F.lit(lo), F.lit(hi)), F.col(c)) for c, (lo, hi) in fences.items()})


def fence_to_null(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Values beyond the quartiles by more than ``multiplier`` interquartile ranges become null."""
    return apply_fences(df, fit_fences(df, columns, multiplier))


def quartile_bins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 to 4 by quartile, a quartile's own value in the lower bin."""
    q = quantile_values(df, columns, (0.25, 0.5, 0.75))
    return df.withColumns({c: sum(((F.col(c) > F.lit(v)).cast("int") for v in q[c]), F.lit(1)) for c in columns})


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A column ``a_x_b`` for the product of each two columns."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None = None, full_rank: bool = False) -> DataFrame:
    """A 0/1 column ``column.level`` for each level (the first is left out at full rank); levels are looked up unless given."""
    if levels is None:
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(1001).collect()]
        if len(levels) > 1000:
            raise ValueError(f"{column} has more than 1000 levels")
    return df.withColumns({f"{column}.{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels[full_rank:]}).drop(column)


def fit_imputer(df: DataFrame, numeric: Sequence[str] = (), factors: Sequence[str] = (), how: str = "mean") -> dict[str, object]:
    """What nulls become: the column's mean or (exact) median, or for factors the least of the most frequent values."""
    fill: dict[str, object] = {}
    if numeric and how == "median":
        fill |= {c: v[0] for c, v in quantile_values(df, numeric, (0.5,)).items()}
    elif numeric:
        fill |= df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    for c in factors:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect()
        fill[c] = top[0][c] if top else None
    return fill


def apply_imputer(df: DataFrame, fill: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def impute(df: DataFrame, numeric: Sequence[str] = (), factors: Sequence[str] = (), how: str = "mean") -> DataFrame:
    """Nulls become the column's mean or median, or for factors the least of the most frequent values."""
    return apply_imputer(df, fit_imputer(df, numeric, factors, how))


def constant_columns(df: DataFrame, tolerance: float = 1e-6) -> list[str]:
    """Numeric columns of variance below ``tolerance`` (or unknown) and other columns of fewer than two values."""
    numeric = set(numeric_columns(df))
    s = df.agg(*[(F.var_samp(c) if c in numeric else F.count_distinct(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if (s[c] is None or s[c] < tolerance if c in numeric else s[c] < 2)]


def redundant_pairs(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Pairs of columns whose correlation is at least ``limit`` in size."""
    return correlations(df, columns).where(F.abs("r") >= limit)


def apply_weights(df: DataFrame, weights: Mapping[str, Mapping[str, float]], columns: Sequence[str], drop_na: bool = True) -> DataFrame:
    """``<c>_total_weight``, the product over the demographic columns of the row's weights, and ``<c>_weighted``, the column times it.

    Every weight's level must occur; levels without a weight count 1.
    """
    require_columns(df, [*weights, *columns])
    for v, w in weights.items():
        seen = {r[0] for r in df.select(v).where(F.col(v).isin(list(w))).distinct().collect()}
        if set(w) - seen:
            raise ValueError(f"{v} has no level {', '.join(sorted(set(w) - seen))}")
    if drop_na:
        df = df.dropna(subset=[*weights, *columns])
    total: Column = F.lit(1.0)
    for v, w in weights.items():
        levels = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
        total = total * F.coalesce(F.try_element_at(levels, F.col(v)), F.lit(1.0))
    return df.withColumns({f"{c}_total_weight": total for c in columns} | {f"{c}_weighted": F.col(c) * total for c in columns})


def shared_columns(frames: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(frame, other frame, column) for each column that two frames share."""
    return [(a, b, c) for a, b in combinations(frames, 2) for c in frames[a].columns if c in frames[b].columns]


def balanced_sample(df: DataFrame, target: str, features: Sequence[str], percent: int = 100, k: int = 5, id_col: str = "id", seed: int = 0) -> DataFrame:
    """``df`` (id, features, target) with synthetic rows of the rarest class, between a row and one of its k nearest of that class.

    Each row gives percent // 100 synthetic ones, and a share of the rows one more; which neighbour, how far towards
    it and which rows is decided by hashes of id, number and seed. Neighbours are exact, see ``nearest_rows``; ids
    must be unique. Rows with unknown features give none; synthetic rows have a null id.
    """
    top = df.where(F.col(target).isNotNull()).groupBy(target).count().orderBy("count", target).limit(1).collect()
    own = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features], target)
    if not top:
        return own
    rare = top[0][target]
    x = stored(df.where(F.col(target) == rare).dropna(subset=list(features)).select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]))
    names = [f"f{i}" for i in range(len(features))]
    near = nearest_rows(x, "id", names, k)
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "o"))
    near = near.withColumn("r", place).join(x.select(F.col("id").alias("o"), F.array(*names).alias("w")), "o")
    listed = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda s: s["w"]).alias("ws")).join(x.select("id", F.array(*names).alias("v")), "id")

    def hashed(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")

    extra = (hashed(F.col("id"), F.lit("extra"), F.lit(seed)) % 100 < percent % 100).cast("int")
    made = listed.withColumn("n", F.lit(percent // 100) + extra).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    pick = F.get("ws", (hashed(F.col("id"), F.col("i"), F.lit("pick"), F.lit(seed)) % F.size("ws")).cast("int"))
    u = hashed(F.col("id"), F.col("i"), F.lit("gap"), F.lit(seed)) / float(1 << 32)
    made = made.withColumn("s", F.zip_with("v", pick, lambda a, b: a + u * (b - a)))
    synthetic = made.select(F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), *[F.get("s", F.lit(i)).alias(f) for i, f in enumerate(features)], F.lit(rare).alias(target))
    return own.unionByName(synthetic)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Each distinct row once."""
    return df.distinct()
