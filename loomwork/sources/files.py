"""Files in and out: a folder of tables as lazily read frames, joins of many frames, delimited and database sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readers by extension: format and options.
READERS = {
    "csv": ("csv", {"header": True, "inferSchema": True}), "txt": ("csv", {"header": True, "inferSchema": True, "sep": "\t"}), "tsv": ("csv", {"header": True, "inferSchema": True, "sep": "\t"}),
    "json": ("json", {"multiLine": True}), "jsonl": ("json", {}), "parquet": ("parquet", {}), "orc": ("orc", {}),
}
DRIVERS = {"mysql": "jdbc:mysql://{host}:{port}/{database}", "postgresql": "jdbc:postgresql://{host}:{port}/{database}", "sqlite": "jdbc:sqlite:{database}"}
JOINS = ("full", "inner", "left", "right")


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> list[str]:
    """Paths of the files in a folder of any store that Spark reads, by a regular expression on their names."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select("path").collect()  # names only: contents aren't read
    paths = sorted(r["path"] for r in listed)
    return [p for p in paths if pattern is None or re.search(pattern, p.rpartition("/")[2])]


def read_file(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of one file by its extension, with ``system_date`` and ``original_file_name``; None for an unknown extension."""
    extension = path.rpartition(".")[2].lower()
    if extension not in READERS:
        return None
    kind, options = READERS[extension]
    df = spark.read.format(kind).options(**options).load(path)
    return df.withColumn("system_date", F.current_date()).withColumn("original_file_name", F.lit(path.rpartition("/")[2]))


def read_folder(spark: SparkSession, folder: str, pattern: str | None = None) -> dict[str, DataFrame]:
    """A lazily read frame per readable file of a folder; raises where there is none."""
    frames = {p.rpartition("/")[2]: read_file(spark, p) for p in list_files(spark, folder, pattern)}
    frames = {n: f for n, f in frames.items() if f is not None}
    if not frames:
        raise ValueError(f"no readable files in {folder}")
    return frames


def join_frames(frames: Sequence[DataFrame], key: str, how: str = "full") -> DataFrame:
    """All frames that have the key, joined by it; columns that collide get ``.x`` and ``.y``."""
    if how not in JOINS:
        raise ValueError(f"no such join: {how}")

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        same = [c for c in a.columns if c in b.columns and c != key]
        return a.withColumnsRenamed({c: f"{c}.x" for c in same}).join(b.withColumnsRenamed({c: f"{c}.y" for c in same}), key, how)

    return reduce(join, [f for f in frames if key in f.columns])


def register_views(frames: Mapping[str, DataFrame]) -> list[str]:
    """A temporary view per frame, named after its file."""
    names = []
    for n, f in frames.items():
        name = re.sub(r"\W+", "_", n.rpartition(".")[0] or n)
        f.createOrReplaceTempView(name)
        names.append(name)
    return names


def database(spark: SparkSession, kind: str, table: str, host: str = "localhost", port: int = 0, name: str = "", user: str | None = None, password: str | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of a database (its driver must be on the class path), read in parallel by ranges of a column where ``split`` is given."""
    if kind not in DRIVERS:
        raise ValueError(f"no such database: {kind}")
    options = {"url": DRIVERS[kind].format(host=host, port=port, database=name), "dbtable": table, "user": user, "password": password}
    if split:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split), strict=True))
    return spark.read.format("jdbc").options(**{k: v for k, v in options.items() if v is not None}).load()


def area_crosswalk(spark: SparkSession, path: str, columns: Mapping[str, str], code: str, state: str, area: str) -> DataFrame:
    """A ``|``-delimited crosswalk with renamed columns, the state as the first two digits of a code, rows without an area left out."""
    df = spark.read.option("sep", "|").option("header", True).csv(path).withColumnsRenamed(dict(columns)).select(*columns.values())
    return df.withColumn(state, F.substring(code, 1, 2)).where(F.col(area).isNotNull())


def areas_of(df: DataFrame, identifiers: Sequence[str], candidates: Sequence[str], area: str) -> DataFrame:
    """Distinct areas of the first candidate column in which all identifiers (in any case) occur."""
    wanted = {str(i).lower() for i in identifiers}
    hits = df.agg(*[F.count_distinct(F.when(F.lower(c).isin(*wanted), F.lower(c))).alias(c) for c in candidates]).first()
    match = next((c for c in candidates if hits[c] == len(wanted)), None)
    if match is None:
        raise ValueError("no column holds all identifiers")
    return df.where(F.lower(match).isin(*wanted)).select(area).distinct()


def catalogue(frames: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(name, rows, columns) of named frames."""
    return spark.createDataFrame([(n, f.count(), len(f.columns)) for n, f in frames.items()], "name string, rows long, columns int")
