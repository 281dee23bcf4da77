"""The corpus pipeline: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from geoloom.session import discard, materialize

#: A document whose language has a smaller share of its words than this is rejected; with four
#: languages mixed evenly no share is smaller than a quarter.
LEAST_SHARE = 0.3
ROW = "_geoloom_row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letters, or no language with LEAST_SHARE of the words."""
    return language_id.keep_identified(docs, language_id.fit_model(docs), LEAST_SHARE)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written so that it stays; ids may repeat, so they can't name rows.

    It is a second copy of all texts on disk, so it is packed well.
    """
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows", compression="zstd")


def _first_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group (row number, group) the row with the smallest id; a null id is larger than any other."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW)
    first = rows.select(ROW, "doc_id").join(groups, ROW).groupBy("group").agg(F.min(order).alias("first")).select(f"first.{ROW}")
    return rows.join(first, ROW).drop(ROW)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one with the smallest id stays."""
    rows = _numbered(docs)
    return _first_of_each(rows, exact_dedup.exact_dedup(rows, ROW).select(ROW, F.col("keep_id").alias("group"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row with the smallest id stays."""
    rows = _numbered(docs)
    return _first_of_each(rows, jaccard_join.near_duplicates(rows, ROW).select(ROW, F.col("component_id").alias("group"))).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
