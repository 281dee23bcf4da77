"""Spatial tables derived by formula from the driver's tables, as DataFrames and as SQL.

The world is a square of 1000 m. All rows of the source tables take part, in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scaled(expr: str, modulus: int):
    return (F.expr(f"({expr}) % {modulus}").cast("double") / 100).cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point returns: place x, z, height h, class (2 is ground)."""
    t = table(spark, sf_dir, "lineitem")
    line = "CAST(l_linenumber AS BIGINT)"
    return t.select(
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("pkey"),
        F.col("l_suppkey").alias("skey"),
        _scaled(f"l_orderkey * 7919 + {line} * 104729", 100000).alias("x"),
        _scaled(f"l_partkey * 6151 + l_suppkey * 3571 + {line} * 257", 100000).alias("z"),
        _scaled(f"l_orderkey * 31 + l_partkey * 17 + {line} * 7", 3000).alias("h"),
        F.when(F.col("l_returnflag") == "N", 2).otherwise(1).alias("cls"),
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square outlines: idx, name nm, corner x0, z0, side w, ring of four corners."""
    t = table(spark, sf_dir, "part")
    t = t.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("nm"), _scaled("p_partkey * 7907", 96000).alias("x0"), _scaled("p_partkey * 5003", 96000).alias("z0"), (8 + F.col("p_size") % 32).cast("double").alias("w"))
    corner = lambda dx, dz: F.array(F.col("x0") + F.col("w") * dx, F.col("z0") + F.col("w") * dz)
    return t.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


def grid(spark: SparkSession, sf_dir: str, cell: float = 20.0) -> DataFrame:
    """Mean ground height by cell (c, r), in whole centimetres added up so that order doesn't matter."""
    g = points(spark, sf_dir).where("cls = 2")
    at = lambda c: F.floor(F.col(c) / cell + 0.5).cast("int")
    cm = F.sum(F.floor(F.col("h") * 100 + 0.5))
    return g.groupBy(at("x").alias("c"), at("z").alias("r")).agg(F.floor(cm / F.count(F.lit(1)) + 0.5).cast("double").alias("v"), F.count(F.lit(1)).alias("n")).withColumn("v", F.col("v") / 100)


def voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with about a quarter of its cells taken out."""
    return grid(spark, sf_dir).where("(r * 7 + c * 13) % 11 >= 3")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier")
    return t.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.expr("CAST(s_suppkey * 7919 % 1000 AS DOUBLE)").alias("x"), F.expr("CAST(s_suppkey * 6151 % 1000 AS DOUBLE)").alias("z"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 squares of 200 m, by nation."""
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("zone"), F.col("n_name").alias("zname"))
    return t.select("zone", "zname", ((F.col("zone") % 5) * 200).cast("double").alias("zx"), (F.floor(F.col("zone") / 5) * 200).cast("double").alias("zz"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of polylines: the points of an order, with their place pos from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("okey").orderBy("line", "pkey", "skey", "x", "z")
    return points(spark, sf_dir).select("okey", (F.row_number().over(w) - 1).alias("pos"), "x", "z", "h")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order, with the milliseconds since the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.expr("floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000)")  # whatever the session's time zone
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", ms.alias("ms"), (ms - F.lag(ms).over(w)).alias("dt"), F.row_number().over(w).alias("seq"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour at the cell of each point."""
    p = points(spark, sf_dir)
    at = lambda c: F.floor(F.col(c) / 20.0 + 0.5).cast("int")
    return p.select("okey", "line", "pkey", "skey", at("x").alias("c"), at("z").alias("r"), (F.col("pkey") % 256).cast("int").alias("red"), (F.col("skey") % 256).cast("int").alias("green"), (F.col("okey") % 256).cast("int").alias("blue"))


_CTE = {
    "points": """SELECT l_orderkey AS okey, l_linenumber AS line, l_partkey AS pkey, l_suppkey AS skey,
        CAST((l_orderkey * 7919 + l_linenumber * 104729) % 100000 AS DOUBLE) / 100 AS x,
        CAST((l_partkey * 6151 + l_suppkey * 3571 + l_linenumber * 257) % 100000 AS DOUBLE) / 100 AS z,
        CAST((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 3000 AS DOUBLE) / 100 AS h,
        CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS cls FROM lineitem""",
    "footprints": """SELECT *, [[x0, z0], [x0 + w, z0], [x0 + w, z0 + w], [x0, z0 + w]] AS ring FROM (
        SELECT p_partkey AS idx, p_brand AS nm, CAST(p_partkey * 7907 % 96000 AS DOUBLE) / 100 AS x0,
        CAST(p_partkey * 5003 % 96000 AS DOUBLE) / 100 AS z0, CAST(8 + p_size % 32 AS DOUBLE) AS w FROM part)""",
    "grid": """SELECT CAST(floor(x / 20 + 0.5) AS INTEGER) AS c, CAST(floor(z / 20 + 0.5) AS INTEGER) AS r,
        floor(sum(floor(h * 100 + 0.5)) / count(*) + 0.5) / 100 AS v, count(*) AS n FROM points WHERE cls = 2 GROUP BY 1, 2""",
    "voids": "SELECT * FROM grid WHERE (r * 7 + c * 13) % 11 >= 3",
    "places": "SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey * 7919 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 6151 % 1000 AS DOUBLE) AS z FROM supplier",
    "zones": "SELECT n_nationkey AS zone, n_name AS zname, CAST(n_nationkey % 5 * 200 AS DOUBLE) AS zx, CAST(n_nationkey // 5 * 200 AS DOUBLE) AS zz FROM nation",
    "paths": "SELECT okey, row_number() OVER (PARTITION BY okey ORDER BY line, pkey, skey, x, z) - 1 AS pos, x, z, h FROM points",
    "ticks": """SELECT user_id, event_id, event_type, value, ms, ms - lag(ms) OVER w AS dt, row_number() OVER w AS seq
        FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "pixels": """SELECT okey, line, pkey, skey, CAST(floor(x / 20 + 0.5) AS INTEGER) AS c, CAST(floor(z / 20 + 0.5) AS INTEGER) AS r,
        CAST(pkey % 256 AS INTEGER) AS red, CAST(skey % 256 AS INTEGER) AS green, CAST(okey % 256 AS INTEGER) AS blue FROM points""",
}
_NEEDS = {"grid": ["points"], "voids": ["grid"], "paths": ["points"], "pixels": ["points"]}


def with_(*names: str, **more: str) -> str:
    """WITH and these fixtures as common table expressions, then any more given as name=select."""
    out: dict[str, str] = {}

    def add(name):
        for n in _NEEDS.get(name, []):
            add(n)
        out.setdefault(name, _CTE[name])

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in (out | more).items())
