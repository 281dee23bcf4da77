"""Aggregations that differ from SQL's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_percentile(sorted_values: Column, q: float) -> Column:
    """sorted[min(n - 1, floor(n * q))], the index rule; null when empty. Not percentile_disc."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, F.least(n - 1, F.floor(n * F.lit(q))).cast("int")))


def index_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], *more: Column) -> DataFrame:
    """Index percentiles of a group, from one sorted array; for groups that fit into a row."""
    d = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"), *more)
    return d.select(*keys, F.size("_v").cast("long").alias("n"), *[at_percentile(F.col("_v"), q).alias(k) for k, q in qs.items()], *[c for c in d.columns if c not in (*keys, "_v")])


def histogram_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], scale: float) -> DataFrame:
    """The same for values on a lattice (whole multiples of 1 / scale), however large the groups.

    Values are counted first, with partial aggregation; a window then adds up counts of distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) * scale + 0.5).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = counts.withColumn("_below", F.sum("_c").over(w.orderBy("_k")) - F.col("_c")).withColumn("_n", F.sum("_c").over(w))
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q)))
    pick = lambda q: F.max(F.when((F.col("_below") <= at(q)) & (at(q) < F.col("_below") + F.col("_c")), F.col("_k") / scale))
    return d.groupBy(*keys).agg(F.max("_n").alias("n"), *[pick(q).alias(k) for k, q in qs.items()])


def dense_band(df: DataFrame, keys: list[str], value: Column, width: float = 1.0) -> DataFrame:
    """Share of a group's values in the best two neighbouring bins, and the lower bin."""
    counts = df.groupBy(*keys, F.floor(value / width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    pair = F.sum("c").over(w.orderBy("bin").rangeBetween(0, 1))
    d = counts.withColumn("pair", pair).withColumn("n", F.sum("c").over(w))
    return d.groupBy(*keys).agg((F.max("pair") / F.max("n")).alias("density"), F.max_by("bin", F.struct("pair", -F.col("bin"))).alias("bin"))


def argmax_first(value: Column, order: Column, payload: Column) -> Column:
    """Payload of the largest value; of equal values, the first in order."""
    return F.max_by(payload, F.struct(value, -order))


def line_fit(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(a, b, sigma) of y = a + b x; a falling or undefined slope gives way to the mean."""
    b = F.regr_slope(y, x)
    rising = b > 0
    return (
        F.when(rising, F.regr_intercept(y, x)).otherwise(F.avg(y)),
        F.when(rising, b).otherwise(F.lit(0.0)),
        F.sqrt(F.when(rising, (F.regr_syy(y, x) - b * b * F.regr_sxx(y, x)) / F.regr_count(y, x)).otherwise(F.var_pop(y))),
    )


def quantise(df: DataFrame, channels: list[str], step: int, most: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(palette, index): colours snapped to a step, the most frequent kept; the others take the nearest of these.

    palette has i, the snapped channels and n. Nearest colours are looked up once for each distinct
    snapped colour; the palette has at most `most` rows.
    """
    snapped = df.select(*keys, *[(F.floor(F.col(c) / step + 0.5) * step).cast("int").alias(c) for c in channels])
    counts = snapped.groupBy(*channels).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), *channels)
    palette = counts.orderBy(F.desc("n"), *channels).limit(most).withColumn("i", (F.row_number().over(w) - 1).cast("int"))
    p = palette.select("i", *[F.col(c).alias(f"p_{c}") for c in channels])
    far = sum(((F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in channels), F.lit(0))
    nearest = counts.select(*channels).join(F.broadcast(p)).groupBy(*channels).agg(F.min(F.struct(far.alias("d"), "i")).alias("m")).select(*channels, F.col("m.i").alias("i"))
    return palette, snapped.join(nearest, channels)
