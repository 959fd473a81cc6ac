"""A training-data pipeline of five stages over the documents table; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import materialise, table
from loomwork.llm.line_dedup import dedup_lines
from loomwork.llm.mixing import mixed_documents
from loomwork.llm.near_texts import drop_similar
from loomwork.llm.packing import pack_documents
from loomwork.llm.quality import grade_documents, ratings_of
from loomwork.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality grade is 1 or more with probability of a half or more; the others go."""
    graded = grade_documents(docs, ratings_of(table(spark, sf_dir, "labels")), keep_grade=1)
    return graded.where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of runs of 50 words or more; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose five-word shingles are alike to 0.8 or more, by SimHash and verified."""
    return drop_similar(docs).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights: a document is a row as often as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences of 1024 tokens: a row per piece."""
    return pack_documents(docs, tokenizer_file())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses the trained classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
