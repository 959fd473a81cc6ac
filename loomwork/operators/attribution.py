"""Multi-touch attribution of conversions to touchpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.core import require_columns, share

REQUIRED = ("customer_id", "touchpoint", "conversion", "timestamp")
MODELS = ("linear", "first_touch", "last_touch", "position_based")


def rename_journey(df: DataFrame, current: Sequence[str | int], new: Sequence[str]) -> DataFrame:
    """Rename columns, given by name or by place from 1, to the names that attribution uses."""
    if len(current) != len(new):
        raise ValueError("as many new names as columns are needed")
    if bad := [n for n in new if n not in REQUIRED]:
        raise ValueError(f"not a journey column: {', '.join(bad)}")
    names = [df.columns[c - 1] if isinstance(c, int) else c for c in current]
    require_columns(df, names)
    return df.withColumnsRenamed(dict(zip(names, new, strict=True)))


def prepare(df: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """Validated journeys with ``touch_rank``: the place of a touch in its customer's journey, from 1."""
    require_columns(df, REQUIRED)
    if df.schema["timestamp"].dataType.simpleString() == "string":
        df = df.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    order = [F.col("timestamp"), *([F.col(tiebreak)] if tiebreak else [])]
    df = df.withColumn("conversion", F.col("conversion").cast("double"))
    return df.withColumn("touch_rank", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order)))


def _normalised(sums: DataFrame) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy())  # over one row per touchpoint
    return sums.select("touchpoint", share(F.col("w"), total).alias("weight"))


def linear(journeys: DataFrame) -> DataFrame:
    """Each touchpoint's share of all conversions."""
    return _normalised(journeys.groupBy("touchpoint").agg(F.sum("conversion").alias("w")))


def first_touch(journeys: DataFrame) -> DataFrame:
    """Each touchpoint's share of conversions on first touches."""
    return linear(journeys.where("touch_rank = 1"))


def last_touch(journeys: DataFrame) -> DataFrame:
    """Each touchpoint's share of customers' last converting touches."""
    last = journeys.where("conversion = 1").groupBy("customer_id").agg(F.max_by("touchpoint", F.col("touch_rank")).alias("touchpoint"))
    return _normalised(last.groupBy("touchpoint").agg(F.count(F.lit(1)).alias("w")))


def position_based(journeys: DataFrame, first: float = 0.4, last: float = 0.4) -> DataFrame:
    """Conversions weighted by place: first and last touches get fixed weights, those between share the rest."""
    if first + last > 1:
        raise ValueError("the first and last weights exceed 1")
    n = F.count(F.lit(1)).over(Window.partitionBy("customer_id"))
    place = F.when(F.col("n") == 1, 1.0).when(F.col("touch_rank") == 1, first).when(F.col("touch_rank") == F.col("n"), last)
    weighted = journeys.withColumn("n", n).withColumn("w", F.col("conversion") * place.otherwise((1 - first - last) / (F.col("n") - 2)))
    return _normalised(weighted.groupBy("touchpoint").agg(F.sum("w").alias("w")))


def analyse(df: DataFrame, models: Sequence[str] = MODELS, tiebreak: str | None = None) -> dict[str, DataFrame]:
    """The weights of each model by its name."""
    if bad := [m for m in models if m not in MODELS]:
        raise ValueError(f"unknown models: {', '.join(bad)}")
    journeys = prepare(df, tiebreak)
    run = {"linear": linear, "first_touch": first_touch, "last_touch": last_touch, "position_based": position_based}
    return {m: run[m](journeys) for m in models}


def joined_weights(df: DataFrame, results: Mapping[str, DataFrame]) -> DataFrame:
    """A row per touchpoint of ``df`` with a weight column per model; absent touchpoints weigh 0."""
    out = df.select("touchpoint").distinct()
    for model, weights in results.items():
        out = out.join(weights.withColumnRenamed("weight", f"weight_{model}"), "touchpoint", "left")
    return out.select("touchpoint", *[F.coalesce(f"weight_{m}", F.lit(0.0)).alias(f"weight_{m}") for m in results])
