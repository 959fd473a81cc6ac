"""Preparing tables for models: stratified splits, a chain of steps fitted on the training rows, column filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.core import numeric_columns, require_columns
from loomwork.functions.ordered import quantile_values, quantiles
from loomwork.operators.cleaning import apply_fences, apply_imputer, fit_fences, fit_imputer, fit_scaler, interactions, one_hot
from loomwork.operators.models import random_forest, score
from loomwork.operators.profiling import correlations


def hash_share(id_col: str, seed: int = 0) -> Column:
    """A number from 0 to below 1 that only the id and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def stratified_split(df: DataFrame, outcome: str, id_col: str, share: float = 0.7, seed: int = 0, bins: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test): ``share`` of the rows of each level of the outcome, of each quantile bin if it is numeric, by a hash of the id.

    The cut is the share's exact quantile of the hashes in each stratum, so it holds within one row; rows
    with an unknown outcome are a stratum. The same rows on every run. Rows that repeat an id stay together.
    """
    require_columns(df, [outcome, id_col])
    d = df.withColumn("__u", hash_share(id_col, seed))
    if outcome in numeric_columns(df):
        cuts = quantile_values(df, [outcome], [i / bins for i in range(1, bins)])[outcome]
        d = d.withColumn("__s", sum(((F.col(outcome) > F.lit(c)).cast("int") for c in cuts), F.lit(0)))
    else:
        d = d.withColumn("__s", F.col(outcome))
    cut = quantiles(d, ["__u"], (share,), ["__s"]).select(F.col("__s").alias("__t"), F.get("q", F.lit(0)).alias("__cut"))
    d = d.join(cut, d["__s"].eqNullSafe(cut["__t"]))
    return tuple(d.where(side).select(df.columns) for side in (F.col("__u") <= F.col("__cut"), F.col("__u") > F.col("__cut")))


@dataclass
class Preparation:
    """What the steps learned from the training rows; ``apply`` does the same to any rows, in the same order:
    scaling, one-hot columns, fences, imputation, interactions, a step of one's own, selection."""

    scales: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    levels: dict[str, list] = field(default_factory=dict)
    fences: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    fill: dict[str, object] = field(default_factory=dict)
    crossed: list[str] = field(default_factory=list)
    full_rank: bool = False
    own: Callable[[DataFrame], DataFrame] | None = None
    selected: list[str] | None = None

    def scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in self.scales.items()})

    def encoded(self, df: DataFrame) -> DataFrame:
        for c, levels in self.levels.items():
            df = one_hot(df, c, levels, self.full_rank)
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        df = apply_imputer(apply_fences(self.encoded(self.scaled(df)), self.fences), self.fill)
        df = interactions(df, self.crossed) if len(self.crossed) > 1 else df
        df = self.own(df) if self.own else df
        return df.select(*self.selected) if self.selected else df


def fit_preparation(
    train: DataFrame, outcome: str, keep: Sequence[str] = (), scaling: str | None = "standard", multiplier: float = 1.5, fill: str = "mean", degree: int = 2, full_rank: bool = False,
    own: Callable[[DataFrame], DataFrame] | None = None, select: int | None = None,
) -> Preparation:
    """The steps fitted on training rows; ``keep`` names columns (such as ids) that pass untouched.

    Numeric columns are scaled, fenced and filled with the training mean or median; text columns become a 0/1
    column per training level (at most 1,000). ``select`` keeps the predictors of greatest importance in a random forest.
    """
    require_columns(train, [outcome, *keep])
    fixed = {outcome, *keep}
    numeric = [c for c in numeric_columns(train) if c not in fixed]
    p = Preparation(full_rank=full_rank, own=own)
    if scaling and numeric:
        row = fit_scaler(train, numeric, scaling).first()
        p.scales = {c: (row[f"__mid_{c}"], row[f"__size_{c}"]) for c in numeric}
    texts = [f.name for f in train.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in fixed]
    for c in texts:
        levels = [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(1001).collect()]
        if len(levels) > 1000:
            raise ValueError(f"{c} has more than 1000 levels")
        p.levels[c] = levels
    d = p.encoded(p.scaled(train))
    p.fences = fit_fences(d, numeric, multiplier) if numeric else {}
    d = apply_fences(d, p.fences)
    p.fill = fit_imputer(d, numeric, how=fill) if numeric else {}
    p.crossed = numeric if degree > 1 else []
    if select is not None:
        ready = p.apply(train)
        predictors = [c for c in numeric_columns(ready) if c not in fixed]
        kind = "regress" if outcome in numeric_columns(train) else "classify"
        plain = ready.withColumnsRenamed({c: f"x{i}" for i, c in enumerate(predictors)})  # names with dots can't be assembled
        if kind == "classify":
            classes = [r[0] for r in train.select(outcome).where(F.col(outcome).isNotNull()).distinct().orderBy(outcome).limit(1001).collect()]
            number = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))])
            plain = plain.withColumn(outcome, F.try_element_at(number, F.col(outcome))).where(F.col(outcome).isNotNull())
        weight = random_forest(plain, outcome, [f"x{i}" for i in range(len(predictors))], kind, 50).stages[-1].featureImportances
        best = sorted(range(len(predictors)), key=lambda i: (-float(weight[i]), i))[:select]
        p.selected = [*[f"`{predictors[i]}`" for i in sorted(best)], *keep, outcome]
    return p


def prepare(df: DataFrame, outcome: str, id_col: str, share: float = 0.7, seed: int = 0, **steps) -> tuple[DataFrame, DataFrame, Preparation]:
    """(train, test, preparation): a stratified split, the steps fitted on the training rows and applied to both."""
    train, test = stratified_split(df, outcome, id_col, share, seed)
    p = fit_preparation(train, outcome, [id_col], **steps)
    return p.apply(train), p.apply(test), p


def tune_preparation(df: DataFrame, outcome: str, id_col: str, grid: Mapping[str, Sequence[object]], trees: int = 20, seed: int = 0) -> list[dict[str, object]]:
    """A row per combination of the grid's options with the held-out score of a random forest (RMSE, or accuracy of a text outcome), best first."""
    regress = outcome in numeric_columns(df)
    rows = []
    for values in product(*grid.values()):
        options = dict(zip(grid, values, strict=True))
        train, test, _ = prepare(df, outcome, id_col, seed=seed, **options)
        x = [c for c in numeric_columns(train) if c not in (outcome, id_col)]
        names = {c: f"x{i}" for i, c in enumerate(x)}
        train, test = train.withColumnsRenamed(names), test.withColumnsRenamed(names)
        if not regress:
            classes = [r[0] for r in train.select(outcome).where(F.col(outcome).isNotNull()).distinct().orderBy(outcome).limit(1001).collect()]
            number = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))])
            train, test = (d.withColumn(outcome, F.try_element_at(number, F.col(outcome))).where(F.col(outcome).isNotNull()) for d in (train, test))
        forest = random_forest(train, outcome, list(names.values()), "regress" if regress else "classify", trees, seed)
        rows.append({**options, "score": score(forest.transform(test), outcome, "regress" if regress else "classify")})
    return sorted(rows, key=lambda r: r["score"] if regress else -r["score"])


def near_zero_variance(df: DataFrame, columns: Sequence[str], ratio: float = 95 / 5, unique: float = 10.0) -> DataFrame:
    """(variable, freq_ratio, pct_unique, near_zero): the most frequent value over the next, distinct values per hundred rows, and whether the column says little.

    Known values only; a column of one value has ratio null and says nothing, one without any likewise.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value").where("value is not null")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("variable").agg(F.max("n").alias("first"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"), F.max_by("value", F.struct("n", "value")).alias("best"))
    second = counts.join(top.select("variable", "best"), "variable").where("value != best").groupBy("variable").agg(F.max("n").alias("second"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    d = names.join(top, "variable", "left").join(second, "variable", "left")
    freq, pct = F.col("first") / F.col("second"), 100.0 * F.col("values") / F.col("rows")
    return d.select("variable", freq.alias("freq_ratio"), F.coalesce(pct, F.lit(0.0)).alias("pct_unique"), (F.coalesce("values", F.lit(0)) <= 1).alias("__one")).select(
        "variable", "freq_ratio", "pct_unique", (F.col("__one") | ((F.col("freq_ratio") > ratio) & (F.col("pct_unique") < unique))).alias("near_zero")
    )


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.89) -> list[str]:
    """Columns to leave out so that no two left correlate above ``limit``: of the closest pair always the one closer to the rest."""
    r = {frozenset((x["var1"], x["var2"])): abs(x["r"] or 0.0) for x in correlations(df, columns).collect()}  # a row per pair of columns
    left, gone = list(columns), []
    while True:
        close = [p for p in combinations(left, 2) if r[frozenset(p)] > limit]
        if not close:
            return gone
        pair = max(close, key=lambda p: r[frozenset(p)])
        rest = {c: sum(r[frozenset((c, o))] for o in left if o != c) for c in pair}
        out = max(pair, key=lambda c: (rest[c], columns.index(c)))
        left.remove(out)
        gone.append(out)
