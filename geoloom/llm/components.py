"""Connected components of an edge table, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    """Count and hash sums of distinct edges: equal for equal tables, and practically for these only."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, for all nodes of edges (a, b).

    Alternating large-star and small-star steps: every node hooks its larger, then its smaller
    neighbours to the smallest node it knows, until nothing changes. Each round is group-bys with
    partial aggregation and joins, and is written out, so lineage stays short and a lost executor
    costs one round. Hub nodes shrink the graph instead of blowing it up: an edge never becomes two.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = materialize(small, "edges")
        after = _signature(small)
        discard(now)
        now = small
        if after == before:
            break
        before = after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    out._geoloom_path = now._geoloom_path  # discard() deletes what this reads
    return out
