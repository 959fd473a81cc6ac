"""Helpers that all operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def require_columns(df: DataFrame, columns: Iterable[str | None]) -> None:
    """Raise ValueError naming the columns that ``df`` lacks; None entries are skipped."""
    missing = [c for c in columns if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def share(x: Column, total: Column) -> Column:
    """x / total, and 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(x / total)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/loomwork/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts the lineage, and lost executors cost nothing.

    The tables stay until ``drop_stored`` removes them: results are computed from them when they are asked for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _WRITTEN:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that each ``stored_alone`` under way has written.
_WRITTEN: list[list[str]] = []


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, stored; the tables that it stored on the way are removed."""
    _WRITTEN.append(paths := [])
    try:
        out = stored(make())
    finally:
        _WRITTEN.pop()
    for path in paths[:-1]:
        _removed(spark, path)
    return out


def _removed(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession) -> None:
    """Remove all tables that ``stored`` has written for this application; results based on them can't be computed any more."""
    _removed(spark, shared_dir(spark))
