"""Files through Spark's own readers and Hadoop's file systems, so paths may be in any store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import shared_dir


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/geoloom-{tag}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file of bounded size, written by the driver."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of files; a file is one row."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "length", "content")


def is_image(content) -> F.Column:
    """Magic bytes of JPEG or PNG."""
    return F.hex(F.substring(content, 1, 3)).eqNullSafe("FFD8FF") | F.hex(F.substring(content, 1, 4)).eqNullSafe("89504E47")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of the files under a folder."""
    return read_files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def manifest_drift(now: DataFrame, shipped: DataFrame) -> DataFrame:
    """Files that came, went or changed size."""
    d = now.select("name", F.col("bytes").alias("now")).join(shipped.select("name", F.col("bytes").alias("shipped")), "name", "full_outer")
    return d.where(~F.col("now").eqNullSafe(F.col("shipped")))
