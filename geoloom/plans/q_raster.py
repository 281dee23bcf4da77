"""Queries for rasters, stepped roofs, facilities and registries; a tile or group is one task's work."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geoloom.functions import numeric, raster
from geoloom.functions.numeric import half_up as r
from geoloom.operators import aggregates as agg
from geoloom.operators import grids
from geoloom.plans import fixtures as fx
from geoloom.plans.fixtures import with_
from geoloom.plans.q_agg import pct, returns
from geoloom.plans.q_join import CENTRES, centres, feet
from geoloom.plans.q_scalar import sq
from geoloom.plans.registry import query
from geoloom.session import ship_package
from geoloom.sources import files, readers, sinks
from geoloom.streaming import state

TILE = 17  # cells of a tile's side: 9 tiles


def tiles(spark, sf):
    """A grey and an RGB value for each cell of nine tiles."""
    ship_package(spark)
    p = fx.pixels(spark, sf).where("c < 51 AND r < 51").groupBy("c", "r").agg(*[F.max(c).alias(c) for c in ("red", "green", "blue")])
    full = grids.whole_grid(spark, 51, 51).join(p, ["c", "r"], "left").fillna(0)
    tile = (F.floor(F.col("r") / TILE) * 3 + F.floor(F.col("c") / TILE)).cast("int")
    return full.select(tile.alias("tile"), (F.col("c") % TILE).alias("i"), (F.col("r") % TILE).alias("j"), "red", "green", "blue")


def image(part: pd.DataFrame) -> np.ndarray:
    out = np.zeros((TILE, TILE, 3))
    out[part.j, part.i] = part[["red", "green", "blue"]].to_numpy()
    return out


def per_tile(name: str, schema: str, f):
    @query(name)
    def run(spark, sf):
        names = [c.split()[0] for c in schema.split(", ")]

        def one(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(int(part.tile.iloc[0]), *row) for row in f(image(part))], columns=["tile", *names])

        return tiles(spark, sf).groupBy("tile").applyInPandas(one, "tile int, " + schema)

    return run


def grey(p: np.ndarray) -> np.ndarray:
    return p @ np.array([0.299, 0.587, 0.114])


per_tile("a27_image_metrics", "gradient double, rise double, dx int, dz int, correlation double", lambda p: [(float(raster.sobel(grey(p), 0.5).mean()), raster.edge_rise(grey(p), 0.5), *raster.best_shift(grey(p), np.roll(grey(p), 1, 1), 2))])
per_tile("i13_trace_blob", "pos int, x double, z double", lambda p: [(k, *q) for k, q in enumerate(raster.trace(grey(p) > 90))])
per_tile("m5_raster_bilinear", "k int, red double, green double, blue double", lambda p: [(k, *map(float, raster.bilinear(p, k * 0.7, k * 0.4))) for k in range(20)])
per_tile("m6_reproject", "i int, j int, red double, green double, blue double", lambda p: [(i, j, *map(float, v)) for j, row in enumerate(raster.reproject(p, lambda x, z: (x * 1.5, z * 1.5), 10, 10, 2, [(0, 0), (10, 0), (10, 8), (0, 8)], 9.0)) for i, v in enumerate(row)])
per_tile("i18_scale_bar", "metres double", lambda p: [(raster.scale_bar(np.where(np.arange(64) % 12 < 2, 255, 0), 5.0),)])


def _whiteness(p: np.ndarray):
    y = grey(p)
    pad = np.pad(y, 2, mode="edge")
    around = sum(pad[a : a + TILE, b : b + TILE] for a in range(5) for b in range(5)) / 25
    top, low = p.max(2), p.min(2)
    white = np.maximum(y - around, 0) * (1 - np.where(top > 0, (top - low) / np.maximum(top, 1), 0))
    mask = raster.inset_mask(TILE, TILE, [(1, 1), (16, 1), (16, 16), (1, 16)], 1.2)
    return [(int(i), int(j), float(white[j, i])) for j, i in zip(*np.nonzero(mask & (y > 0)))]


per_tile("m7_whiteness_field", "i int, j int, white double", _whiteness)


@query("a5_stepped_levels")
def a5(spark, sf):
    def finish(values, counts, carried):
        idx, base = carried
        return [(idx, k, float(level), share) for k, (level, share) in enumerate(raster.roof_levels(values, base, share=0.15, explained=0.3, tight=0.5, times=counts))]

    return returns(spark, sf, finish, "idx long, k int, level double, share double")


@query("c12_roof_elevation", with_("footprints", "grid", k="SELECT idx, w, CAST(floor(u[1] / 20 + 0.5) AS INTEGER) AS c, CAST(floor(u[2] / 20 + 0.5) AS INTEGER) AS r FROM (SELECT idx, w, unnest(ring) AS u FROM footprints)",
       s="SELECT idx, any_value(w) AS w, list_sort(list(v)) AS v FROM k JOIN grid USING (c, r) GROUP BY idx") + f" SELECT idx, {sq('greatest(' + pct('v', .5) + ' + w / 4, list_max(v))')} AS y FROM s")
def c12(spark, sf):
    v = feet(spark, sf).select("idx", "w", F.explode("ring").alias("p")).select("idx", "w", F.col("p")[0].alias("x"), F.col("p")[1].alias("z"))
    g = grids.sample_nearest(v, fx.grid(spark, sf), 20.0).where("v IS NOT NULL").groupBy("idx").agg(F.first("w").alias("w"), F.array_sort(F.collect_list("v")).alias("s"))
    return g.select("idx", r(F.greatest(agg.at_percentile(F.col("s"), 0.5) + F.col("w") / 4, F.array_max("s")), 4).alias("y"))


@query("f10_visibility_tiers", with_("ticks", d="""SELECT user_id, seq, last_value(CASE WHEN value < 20 THEN true WHEN value >= 30 THEN false END IGNORE NULLS) OVER w AS near,
    last_value(CASE WHEN value < 60 THEN true WHEN value >= 80 THEN false END IGNORE NULLS) OVER w AS far FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""") + """
  SELECT user_id, seq, CASE WHEN near THEN 'full' WHEN far THEN 'simple' ELSE 'hidden' END AS tier FROM d""")
def f10(spark, sf):
    within = lambda near, band: state.shown(F.col("value"), F.col("seq") - 1, "user_id", "seq", near, band, 1)
    return fx.ticks(spark, sf).select("user_id", "seq", F.when(within(20.0, 10.0), "full").when(within(60.0, 20.0), "simple").otherwise("hidden").alias("tier"))


@query("i15_facility_markings")
def i15(spark, sf):
    """Each place gets a facility of its kind; template lines turned and moved into the world by expressions."""
    kinds = sorted(raster.FACILITIES)
    rows = [(k, n, p, float(u), float(v)) for k in kinds for n, line in enumerate(raster.FACILITIES[k]()) for p, (u, v) in enumerate(line)]
    template = spark.createDataFrame(rows, "kind string, line int, pos int, u double, v double")  # bounded by the registry
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int"))
    d = fx.places(spark, sf).withColumn("kind", kind).join(template, "kind")
    p = numeric.rotate(F.col("u"), F.col("v"), F.col("id") / 7, F.col("x"), F.col("z"))
    return d.withColumn("p", p).select("id", "kind", "line", "pos", r(F.col("p.x"), 3).alias("x"), r(F.col("p.z"), 3).alias("z"))


@query("i16_subdivided_triangles")
def i16(spark, sf):
    ship_package(spark)
    surface = lambda x, z: 3 * math.sin(x / 9) + 2 * math.cos(z / 7)

    @F.pandas_udf("int")
    def count(x0: pd.Series, z0: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([raster.subdivide((a, b), (a + s, b), (a, b + s), surface) for a, b, s in zip(x0, z0, w)])

    return fx.footprints(spark, sf).select("idx", count("x0", "z0", "w").alias("triangles"))


@query("s14_chunk_pixels", with_("footprints", "pixels", m=CENTRES, p="SELECT c, r, max(red) AS red FROM pixels WHERE c < 50 AND r < 50 GROUP BY c, r") + " SELECT id, coalesce(red, 0)::INTEGER AS red FROM m LEFT JOIN p ON c = floor(x / 20) AND r = floor(z / 20) WHERE x < 1000 AND z < 1000")
def s14(spark, sf):
    """Points read from raster chunks of 25 x 25 pixels; a chunk is decoded once and points come to it by its key."""
    path = files.scratch(spark, "chunks")
    px = fx.pixels(spark, sf).where("c < 50 AND r < 50").groupBy("c", "r").agg(*[F.max(c).alias(c) for c in ("red", "green", "blue")])
    for a in range(2):
        for b in range(2):
            part = px.where((F.floor(F.col("c") / 25) == a) & (F.floor(F.col("r") / 25) == b))
            sinks.write_raster(part.select((F.col("c") % 25).alias("col"), (F.col("r") % 25).alias("row"), "red", "green", "blue"), f"{path}/{a}-{b}.ppm", 25, 25)
    key = F.split(F.regexp_extract("path", r"(\d+-\d+)\.ppm$", 1), "-")
    long = readers.read_rasters(spark, path).select((key[0].cast("int") * 25 + F.col("col")).alias("c"), (key[1].cast("int") * 25 + F.col("row")).alias("r"), "red")
    p = centres(spark, sf).where("x < 1000 AND z < 1000").select("id", F.floor(F.col("x") / 20).cast("int").alias("c"), F.floor(F.col("z") / 20).cast("int").alias("r"))
    return p.join(long, ["c", "r"], "left").select("id", F.coalesce("red", F.lit(0)).alias("red"))


@query("k3_raster_chunks", "SELECT a.i || '-' || b.i || '.ppm' AS name, CAST(11 + 75 AS BIGINT) AS bytes FROM range(0, 2) a(i), range(0, 2) b(i)")
def k3(spark, sf):
    path = files.scratch(spark, "chunks")
    one = spark.range(25).select((F.col("id") % 5).cast("int").alias("col"), F.floor(F.col("id") / 5).cast("int").alias("row"), F.lit(1).alias("red"), F.lit(2).alias("green"), F.lit(3).alias("blue"))
    for a in range(2):
        for b in range(2):
            sinks.write_raster(one, f"{path}/{a}-{b}.ppm", 5, 5)
    return files.manifest(spark, path)


@query("x3_objective_callback", with_("places") + " SELECT id, x AS bx, z AS bz FROM places")
def x3(spark, sf):
    ship_package(spark)

    @F.pandas_udf("bx double, bz double")
    def fit(x: pd.Series, z: pd.Series) -> pd.DataFrame:
        seeds = [(float(a), float(b)) for a in range(0, 1001, 200) for b in range(0, 1001, 200)]
        return pd.DataFrame([raster.refine(lambda a, b: -abs(a - p) - abs(b - q), seeds) for p, q in zip(x, z)], columns=["bx", "bz"])  # noqa: B023

    return fx.places(spark, sf).withColumn("b", fit("x", "z")).select("id", "b.bx", "b.bz")


@query("x4_registries", "SELECT * FROM (VALUES ('facility', 'basketball'), ('facility', 'pitch'), ('facility', 'tennis'), ('facility', 'track'), ('provider', 'squares')) t(registry, name)")
def x4(spark, sf):
    rows = [("facility", k) for k in raster.FACILITIES] + [("provider", k) for k in readers.PROVIDERS]
    return spark.createDataFrame(rows, "registry string, name string")
