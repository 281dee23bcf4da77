"""Queries for aggregations, ordered operators, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import colour, rules
from geoloom.functions.numeric import half_up as r
from geoloom.operators import aggregates as agg
from geoloom.operators import grids, profiles, spatial
from geoloom.plans import fixtures as fx
from geoloom.plans.fixtures import with_
from geoloom.plans.q_join import CENTRES, IN, centres, feet
from geoloom.plans.q_scalar import sq
from geoloom.plans.registry import query
from geoloom.session import materialize

TALL = f"SELECT f.idx, p.h, (f.idx % 7)::DOUBLE / 2 AS base FROM points p JOIN footprints f ON {IN} AND p.cls = 1"


def returns(spark, sf, finish, schema):
    """Rows that finish gives for the heights of the returns in each footprint, with its idx and base height."""
    rings = fx.footprints(spark, sf).select("idx", ((F.col("idx") % 7) / 2).alias("base"), "ring")
    return profiles.ring_profiles(fx.points(spark, sf).where("cls = 1"), rings, "h", ["idx", "base"], finish, schema)


def pct(v: str, q: float, n: str = "len({v})") -> str:
    return f"{v}[CAST(least(len({v}) - 1, floor(len({v}) * {q}::DOUBLE)) AS INTEGER) + 1]"


S = "SELECT idx, list_sort(list(h)) AS v, any_value(base) AS base FROM tall GROUP BY idx"
QS = {"p50": 0.5, "p75": 0.75, "p98": 0.98}


def percentiles(values, counts, carried):
    return [(carried[0], int(counts.sum()), *profiles.percentiles(values, counts, QS.values()))]


def stats(spark, sf):
    return returns(spark, sf, percentiles, "idx long, n long, p50 double, p75 double, p98 double")


@query("a1_index_percentile", with_("points", "footprints", tall=TALL, s=S) + f" SELECT idx, len(v) AS n, {pct('v', .5)} AS p50, {pct('v', .75)} AS p75, {pct('v', .98)} AS p98 FROM s")
def a1(spark, sf):
    return stats(spark, sf)


@query("a1_histogram_percentile", with_("points", s="SELECT cls, list_sort(list(h)) AS v FROM points GROUP BY cls") + f" SELECT cls, len(v) AS n, {pct('v', .5)} AS p50, {pct('v', .75)} AS p75, {pct('v', .98)} AS p98 FROM s")
def a1b(spark, sf):
    return agg.histogram_percentiles(fx.points(spark, sf), ["cls"], "h", QS, 100.0)


BAND = "SELECT idx, floor(h - base) AS bin, count(*) AS c FROM tall GROUP BY 1, 2"
BAND2 = "SELECT idx, bin, sum(c) OVER (PARTITION BY idx ORDER BY bin RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS pair, sum(c) OVER (PARTITION BY idx) AS n FROM band"
DENSITY = "SELECT idx, max(pair)::DOUBLE / max(n) AS density, CAST(arg_max(bin, pair * 1000 - bin) AS BIGINT) AS bin FROM band2 GROUP BY idx"


@query("a2_dense_band", with_("points", "footprints", tall=TALL, band=BAND, band2=BAND2, density=DENSITY) + f" SELECT idx, {sq('density')} AS density, bin FROM density")
def a2(spark, sf):
    band = lambda values, counts, carried: [(carried[0], *profiles.dense_band(values - carried[1], counts))]
    return returns(spark, sf, band, "idx long, density double, bin long").select("idx", r(F.col("density"), 4).alias("density"), "bin")


def roofs(spark, sf):
    """Percentiles and dense band of a footprint's returns, and the rule they lead to."""
    both = lambda values, counts, carried: [(*percentiles(values, counts, carried)[0], carried[1], profiles.dense_band(values - carried[1], counts)[0])]
    d = returns(spark, sf, both, "idx long, n long, p50 double, p75 double, p98 double, base double, density double")
    return d.withColumn("roof", rules.roof_rule(F.col("p50"), F.col("p75"), F.col("p98"), F.col("density"), F.col("base")))


_ROOF = with_("points", "footprints", tall=TALL, s=S, band=BAND, band2=BAND2, density=DENSITY, p=f"SELECT idx, {pct('v', .5)} AS p50, {pct('v', .75)} AS p75, {pct('v', .98)} AS p98, base, len(v) AS n FROM s",
              q="SELECT p.*, density, CASE WHEN p98 - p75 > 5 THEN 'canopy' WHEN p75 - p50 <= 2 AND p98 - p75 > 2 AND density >= 0.85 THEN 'shelf' ELSE 'top' END AS rule FROM p JOIN density USING (idx)")


@query("a3_roof_rule", _ROOF + " SELECT idx, n, rule, CASE rule WHEN 'top' THEN p98 ELSE p75 END AS h, n >= 10 AND (CASE rule WHEN 'top' THEN p98 ELSE p75 END) >= 3 AS admitted FROM q")
def a3(spark, sf):
    d = roofs(spark, sf)
    ok = rules.admissible(F.col("roof.h"), F.col("n"), F.lit(1.0), F.lit(0.0), F.lit(False), least_n=10)
    return d.select("idx", "n", "roof.rule", "roof.h", ok.alias("admitted"))


@query("a4_roof_explained", _ROOF + f" SELECT idx, p50, p75, p98, {sq('density')} AS density, rule FROM q")
def a4(spark, sf):
    return roofs(spark, sf).select("idx", "p50", "p75", "p98", r(F.col("density"), 4).alias("density"), "roof.rule")


@query("a6_slab_rule", with_("points", "footprints", tall=TALL, s=S, p=f"SELECT idx, {pct('v', .5)} AS p50, {pct('v', .75)} AS p75, {pct('v', .98)} AS p98 FROM s") + " SELECT idx, CASE WHEN p98 - p75 > 5 AND p75 - p50 > 2 THEN NULL WHEN p98 - p75 > 5 THEN p75 ELSE p98 END AS h FROM p")
def a6(spark, sf):
    return stats(spark, sf).select("idx", rules.slab_rule(F.col("p50"), F.col("p75"), F.col("p98")).alias("h"))


@query("a7_grid_mean", with_("grid") + " SELECT c, r, v, n FROM grid")
def a7(spark, sf):
    return fx.grid(spark, sf).select("c", "r", "v", "n")


@query("a8_cell_argmax", with_("points") + " SELECT CAST(floor(x / 20) AS INTEGER) AS c, CAST(floor(z / 20) AS INTEGER) AS r, max(h) AS h, arg_max(okey * 10 + line, h * 1e12 - (okey * 10 + line)) AS id FROM points WHERE cls = 1 GROUP BY 1, 2")
def a8(spark, sf):
    p = fx.points(spark, sf).where("cls = 1").withColumn("id", F.col("okey") * 10 + F.col("line"))
    return p.groupBy(spatial.cell_of(F.col("x"), 20.0).alias("c"), spatial.cell_of(F.col("z"), 20.0).alias("r")).agg(F.max("h").alias("h"), agg.argmax_first(F.col("h"), F.col("id"), F.col("id")).alias("id"))


@query("a9_datum_median", with_("grid", s="SELECT list_sort(list(v)) AS v FROM grid") + f" SELECT floor({pct('v', .5)} * 10 + 0.5) / 10 AS datum, len(v) AS n FROM s")
def a9(spark, sf):
    return agg.histogram_percentiles(fx.grid(spark, sf), [], "v", {"m": 0.5}, 100.0).select(r(F.col("m"), 1).alias("datum"), "n")


@query("a10_rim_base", with_("footprints", "voids", k="SELECT idx, CAST(floor(u[1] / 20 + 0.5) AS INTEGER) AS c, CAST(floor(u[2] / 20 + 0.5) AS INTEGER) AS r FROM (SELECT idx, unnest(ring) AS u FROM footprints)",
       s="SELECT idx, list_sort(list(v) FILTER (v IS NOT NULL)) AS v, count(v)::DOUBLE / count(*) AS cov FROM k LEFT JOIN voids USING (c, r) GROUP BY idx") + f" SELECT idx, {pct('v', .5)} AS base, {sq('cov')} AS coverage FROM s")
def a10(spark, sf):
    v = feet(spark, sf).select("idx", F.explode("ring").alias("p")).select("idx", F.col("p")[0].alias("x"), F.col("p")[1].alias("z"))
    g = grids.sample_nearest(v, fx.voids(spark, sf), 20.0).groupBy("idx").agg(F.array_sort(F.collect_list("v")).alias("s"), (F.count("v") / F.count(F.lit(1))).alias("cov"))
    return g.select("idx", agg.at_percentile(F.col("s"), 0.5).alias("base"), r(F.col("cov"), 4).alias("coverage"))


@query("a11_group_max_payload", with_("footprints") + " SELECT nm, max(w) AS w, arg_max(idx, w * 100000 - idx) AS idx FROM footprints GROUP BY nm")
def a11(spark, sf):
    return feet(spark, sf).groupBy("nm").agg(F.max("w").alias("w"), agg.argmax_first(F.col("w"), F.col("idx"), F.col("idx")).alias("idx"))


@query("a12_distinct_floors", "SELECT p_brand AS nm, count(DISTINCT p_size) AS floors, max(p_size) * 3.5::DOUBLE AS top FROM part GROUP BY 1")
def a12(spark, sf):
    return fx.table(spark, sf, "part").groupBy(F.col("p_brand").alias("nm")).agg(F.count_distinct("p_size").alias("floors"), (F.max("p_size") * 3.5).alias("top"))


@query("a13_band_calibration", with_("footprints", s="SELECT CASE WHEN w * w < 200 THEN 0 WHEN w * w < 600 THEN 1 WHEN w * w < 1200 THEN 2 ELSE 3 END AS band, list_sort(list(w)) AS v FROM footprints GROUP BY 1") + f" SELECT band, len(v) AS n, {pct('v', .5)} AS median, {pct('v', .25)} AS p25, {pct('v', .75)} AS p75 FROM s")
def a13(spark, sf):
    bands = spark.createDataFrame([(0, 0.0, 200.0), (1, 200.0, 600.0), (2, 600.0, 1200.0), (3, 1200.0, 1e9)], "band int, lo double, hi double")
    a = F.col("w") * F.col("w")
    d = feet(spark, sf).join(F.broadcast(bands), (a >= F.col("lo")) & (a < F.col("hi")))
    return agg.index_percentiles(d, ["band"], "w", {"median": 0.5, "p25": 0.25, "p75": 0.75})


@query("a14_storey_fit", with_("footprints", l="SELECT idx % 12 + 1 AS level, w FROM footprints", m="SELECT level, list_sort(list(w)) AS v FROM l GROUP BY level",
       e="SELECT level, list_sort(list(abs(w - (level * 3.4::DOUBLE + 1.05)))) AS a, list_sort(list(abs(w - level * 3.0::DOUBLE))) AS b FROM l GROUP BY level") + f" SELECT level, {pct('v', .5)} AS median, {sq(pct('v', .5) + ' / level')} AS per, {sq(pct('a', .5))} AS err_a, {sq(pct('b', .5))} AS err_b FROM m JOIN e USING (level)")
def a14(spark, sf):
    d = feet(spark, sf).withColumn("level", F.col("idx") % 12 + 1)
    at = lambda v: agg.at_percentile(F.array_sort(F.collect_list(v)), 0.5)
    g = d.groupBy("level").agg(at(F.col("w")).alias("median"), at(F.abs(F.col("w") - (F.col("level") * 3.4 + 1.05))).alias("a"), at(F.abs(F.col("w") - F.col("level") * 3.0)).alias("b"))
    return g.select("level", "median", r(F.col("median") / F.col("level"), 4).alias("per"), r(F.col("a"), 4).alias("err_a"), r(F.col("b"), 4).alias("err_b"))


SAMPLED = "SELECT * REPLACE ((k - 1) // 6 + 1 AS k) FROM (SELECT *, row_number() OVER (PARTITION BY c, r ORDER BY okey, line, pkey, skey) AS k FROM pixels) WHERE k % 6 = 1 AND k <= 96"


def sampled(spark, sf):
    """The first 16 of every sixth pixel of a cell; k is their place."""
    w = Window.partitionBy("c", "r").orderBy("okey", "line", "pkey", "skey")
    return fx.pixels(spark, sf).withColumn("k", F.row_number().over(w)).where("k % 6 = 1 AND k <= 96").withColumn("k", (F.col("k") - 1) / 6 + 1)


@query("a15_capped_sampling", with_("pixels", t=SAMPLED) + " SELECT c, r, okey, line, pkey, skey, CAST(k AS INTEGER) AS k FROM t")
def a15(spark, sf):
    return sampled(spark, sf).select("c", "r", "okey", "line", "pkey", "skey", "k")


@query("a16_channel_median", with_("pixels", t=SAMPLED, s="SELECT c, r, list_sort(list(red)) AS a, list_sort(list(green)) AS b, list_sort(list(blue)) AS d FROM t GROUP BY c, r") + f" SELECT c, r, {pct('a', .5)} AS red, {pct('b', .5)} AS green, {pct('d', .5)} AS blue FROM s")
def a16(spark, sf):
    # The median of a channel in linear light is that of the channel itself: the curve only rises.
    at = lambda c: agg.at_percentile(F.array_sort(F.collect_list(c)), 0.5).alias(c)
    return sampled(spark, sf).groupBy("c", "r").agg(at("red"), at("green"), at("blue"))


@query("a17_quantise", with_("pixels", s="SELECT c, r, okey, line, pkey, skey, CAST(floor(red / 64 + 0.5) * 64 AS INTEGER) AS red, CAST(floor(green / 64 + 0.5) * 64 AS INTEGER) AS green, CAST(floor(blue / 64 + 0.5) * 64 AS INTEGER) AS blue FROM pixels",
       n="SELECT red, green, blue, count(*) AS n FROM s GROUP BY ALL", p="SELECT *, CAST(row_number() OVER (ORDER BY n DESC, red, green, blue) - 1 AS INTEGER) AS i FROM n QUALIFY i < 12",
       m="SELECT n.red, n.green, n.blue, arg_min(p.i, ((n.red - p.red) ** 2 + (n.green - p.green) ** 2 + (n.blue - p.blue) ** 2) * 100 + p.i) AS i FROM n, p GROUP BY ALL") + " SELECT i, count(*) AS cells FROM s JOIN m USING (red, green, blue) GROUP BY i")
def a17(spark, sf):
    _, index = agg.quantise(fx.pixels(spark, sf), ["red", "green", "blue"], 64, 12, ["c", "r", "okey", "line", "pkey", "skey"])
    return index.groupBy("i").agg(F.count(F.lit(1)).alias("cells"))


LUMA = "red * 0.299::DOUBLE + green * 0.587::DOUBLE + blue * 0.114::DOUBLE"


def luma(a="red", b="green", c="blue"):
    return colour.luma601(F.col(a), F.col(b), F.col(c))


@query("a18_trimmed_colour", with_("pixels", l=f"SELECT c, r, red, green, blue, {LUMA} AS y FROM pixels", m="SELECT c, r, list_sort(list(y)) AS v FROM l GROUP BY c, r", k=f"SELECT c, r, {pct('v', .5)} AS mid FROM m",
       t="SELECT c, r, list_sort(list(red)) AS a, list_sort(list(green)) AS b, list_sort(list(blue)) AS d FROM l JOIN k USING (c, r) WHERE y BETWEEN 0.5 * mid AND 1.7 * mid GROUP BY c, r") + f" SELECT c, r, len(a) AS n, {pct('a', .5)} AS red, {pct('b', .5)} AS green, {pct('d', .5)} AS blue FROM t")
def a18(spark, sf):
    p = fx.pixels(spark, sf).withColumn("y", luma())
    mid = agg.index_percentiles(p, ["c", "r"], "y", {"mid": 0.5}).drop("n")
    kept = p.join(mid, ["c", "r"]).where((F.col("y") >= F.col("mid") * 0.5) & (F.col("y") <= F.col("mid") * 1.7))
    at = lambda c: agg.at_percentile(F.array_sort(F.collect_list(c)), 0.5).alias(c)
    return kept.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"), at("red"), at("green"), at("blue"))


@query("a19_five_point_median", with_("grid", "footprints", k="SELECT idx, unnest([[x0, z0], [x0 + w, z0], [x0 + w, z0 + w], [x0, z0 + w], [x0 + w / 2, z0 + w / 2]]) AS u FROM footprints",
       s="SELECT idx, list_sort(list(v)) AS v FROM (SELECT idx, CAST(floor(u[1] / 20 + 0.5) AS INTEGER) AS c, CAST(floor(u[2] / 20 + 0.5) AS INTEGER) AS r FROM k) JOIN grid USING (c, r) GROUP BY idx") + f" SELECT idx, len(v) AS n, {pct('v', .5)} AS v FROM s")
def a19(spark, sf):
    f = fx.footprints(spark, sf)
    spots = F.array_append("ring", F.array(F.col("x0") + F.col("w") / 2, F.col("z0") + F.col("w") / 2))
    v = f.select("idx", F.explode(spots).alias("p")).select("idx", F.col("p")[0].alias("x"), F.col("p")[1].alias("z"))
    return agg.index_percentiles(grids.sample_nearest(v, fx.grid(spark, sf), 20.0), ["idx"], "v", {"m": 0.5}).select("idx", "n", F.col("m").alias("v"))


@query("a20_luma_spread_rank", with_("pixels", l=f"SELECT c, r, {LUMA} AS y FROM pixels", m="SELECT c, r, list_sort(list(y)) AS v FROM l GROUP BY c, r", s=f"SELECT c, r, floor(({pct('v', .75)} - {pct('v', .25)}) / {pct('v', .5)} * 10000 + 0.5) / 10000 AS spread FROM m") + " SELECT c, r, spread, (SELECT count(*) FROM s t WHERE t.spread < s.spread) AS below FROM s")
def a20(spark, sf):
    d = agg.index_percentiles(fx.pixels(spark, sf).withColumn("y", luma()), ["c", "r"], "y", {"a": 0.25, "m": 0.5, "b": 0.75})
    d = d.select("c", "r", r((F.col("b") - F.col("a")) / F.col("m"), 4).alias("spread"))
    # Ranks over counts of distinct values, not over all rows in one task.
    counts = d.groupBy("spread").agg(F.count(F.lit(1)).alias("k"))
    below = counts.withColumn("below", F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("spread")) - F.col("k")).select("spread", "below")
    return d.join(below, "spread").select("c", "r", "spread", "below")


@query("a21_percentile_window_colour", with_("pixels", l=f"SELECT c, r, red, {LUMA} AS y FROM pixels", m="SELECT c, r, list_sort(list(y)) AS v FROM l GROUP BY c, r", k=f"SELECT c, r, {pct('v', .3)} AS lo, {pct('v', .92)} AS hi FROM m") + " SELECT c, r, count(*) AS n, floor(sum(red)::DOUBLE / count(*) + 0.5) AS red FROM l JOIN k USING (c, r) WHERE y BETWEEN lo AND hi GROUP BY c, r HAVING count(*) >= 10")
def a21(spark, sf):
    p = fx.pixels(spark, sf).withColumn("y", luma())
    k = agg.index_percentiles(p, ["c", "r"], "y", {"lo": 0.3, "hi": 0.92}).drop("n")
    d = p.join(k, ["c", "r"]).where("y BETWEEN lo AND hi").groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"), r(F.sum("red") / F.count(F.lit(1))).alias("red"))
    return d.where("n >= 10")


@query("a22_tallies", with_("footprints", m=CENTRES) + " SELECT CASE WHEN side < 15 THEN 'area' WHEN side < 25 THEN 'levels' ELSE 'height' END AS src, count(*) AS n, count(*) FILTER (x < 500) AS west FROM m GROUP BY 1")
def a22(spark, sf):
    src = F.when(F.col("side") < 15, "area").when(F.col("side") < 25, "levels").otherwise("height")
    return centres(spark, sf).groupBy(src.alias("src")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < 500).alias("west"))


@query("a23_survey_facts", with_("footprints") + " SELECT unnest(['rings', 'area', 'west', 'east']) AS key, unnest([count(*)::DOUBLE, sum(w * w), min(x0), max(x0 + w)]) AS value, unnest(['', 'm2', 'm', 'm']) AS unit FROM footprints")
def a23(spark, sf):
    d = fx.footprints(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("w") * F.col("w")).alias("a"), F.min("x0").alias("lo"), F.max(F.col("x0") + F.col("w")).alias("hi"))
    return d.selectExpr("stack(4, 'rings', n, '', 'area', a, 'm2', 'west', lo, 'm', 'east', hi, 'm') AS (key, value, unit)")


@query("a24_error_stats", with_("grid", e="SELECT v - 15 AS d FROM grid") + f" SELECT {sq('sqrt(avg(d * d))', 3)} AS rms, {sq('avg(d)', 3)} AS mean, {sq('sqrt(avg(d * d) - avg(d) * avg(d))', 3)} AS detrended, {sq('max(abs(d))', 3)} AS worst FROM e")
def a24(spark, sf):
    d = F.col("v") - 15
    g = fx.grid(spark, sf).agg(F.avg(d * d).alias("q"), F.avg(d).alias("m"), F.max(F.abs(d)).alias("w"))
    return g.select(r(F.sqrt("q"), 3).alias("rms"), r(F.col("m"), 3).alias("mean"), r(F.sqrt(F.col("q") - F.col("m") * F.col("m")), 3).alias("detrended"), r(F.col("w"), 3).alias("worst"))


@query("a25_line_fit", with_("ticks") + f" SELECT event_type, {sq('CASE WHEN b > 0 THEN a ELSE m END', 3)} AS a, {sq('CASE WHEN b > 0 THEN b ELSE 0 END', 5)} AS b, {sq('CASE WHEN b > 0 THEN sqrt((syy - b * b * sxx) / n) ELSE sqrt(vp) END', 3)} AS sigma FROM (SELECT event_type, regr_slope(value, seq) AS b, regr_intercept(value, seq) AS a, avg(value) AS m, regr_syy(value, seq) AS syy, regr_sxx(value, seq) AS sxx, count(*) AS n, var_pop(value) AS vp FROM ticks GROUP BY event_type)")
def a25(spark, sf):
    a, b, s = agg.line_fit(F.col("seq").cast("double"), F.col("value"))
    return fx.ticks(spark, sf).groupBy("event_type").agg(r(a, 3).alias("a"), r(b, 5).alias("b"), r(s, 3).alias("sigma"))


@query("a26_line_error", with_("paths") + f" SELECT okey, {sq('avg(abs((x - 500) * 0.6::DOUBLE + (z - 500) * 0.8::DOUBLE))', 2)} AS error, {sq('avg(CASE WHEN h > 15 THEN 1.0::DOUBLE ELSE 0 END)')} AS coverage FROM paths GROUP BY okey")
def a26(spark, sf):
    off = F.abs((F.col("x") - 500) * 0.6 + (F.col("z") - 500) * 0.8)
    return fx.paths(spark, sf).groupBy("okey").agg(r(F.avg(off), 2).alias("error"), r(F.avg(F.when(F.col("h") > 15, 1.0).otherwise(0.0)), 4).alias("coverage"))


@query("a28_frame_stats", with_("ticks", d="SELECT user_id, dt FROM ticks WHERE dt > 0", s="SELECT user_id, list_reverse_sort(list(dt)) AS v FROM d GROUP BY user_id") + f" SELECT user_id, {sq('1000.0::DOUBLE * len(v) / list_sum(v)', 6)} AS avg_fps, {sq('1000.0::DOUBLE / ' + pct('v', .05), 6)} AS worst_fps FROM s")
def a28(spark, sf):
    d = fx.ticks(spark, sf).where("dt > 0").groupBy("user_id").agg(F.sort_array(F.collect_list("dt"), asc=False).alias("v"), F.count(F.lit(1)).alias("n"), F.sum("dt").alias("t"))
    return d.select("user_id", r(F.lit(1000.0) * F.col("n") / F.col("t"), 6).alias("avg_fps"), r(F.lit(1000.0) / agg.at_percentile(F.col("v"), 0.05), 6).alias("worst_fps"))


@query("a29_duplicate_names", with_("footprints") + " SELECT idx, count(*) OVER (PARTITION BY nm) AS n FROM footprints")
def a29(spark, sf):
    return feet(spark, sf).select("idx", F.count(F.lit(1)).over(Window.partitionBy("nm")).alias("n"))


@query("a30_readiness_census", with_("footprints") + f" SELECT CASE WHEN idx % 5 = 0 THEN 'absent' WHEN abs(w - 20) <= 8 THEN 'measured' WHEN idx % 2 = 0 THEN 'estimated' ELSE 'guessed' END AS class, count(*) AS n, {sq('100.0::DOUBLE * sum(w * w) / (SELECT sum(w * w) FROM footprints)')} AS share FROM footprints GROUP BY 1")
def a30(spark, sf):
    c = F.when(F.col("idx") % 5 == 0, "absent").when(F.abs(F.col("w") - 20) <= 8, "measured").when(F.col("idx") % 2 == 0, "estimated").otherwise("guessed")
    g = feet(spark, sf).groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("w")).alias("a"))
    return g.select("class", "n", r(F.lit(100.0) * F.col("a") / F.sum("a").over(Window.partitionBy(F.lit(0))), 4).alias("share"))


@query("f6_statistical_admission", with_("points", "footprints", tall=TALL, s=S) + f" SELECT idx, len(v) AS n, {pct('v', .98)} >= 3 AND len(v) >= 15 AND {pct('v', .75)} - {pct('v', .25)} <= 20 AND idx % 30 <> 0 AS admitted FROM s")
def f6(spark, sf):
    spread = lambda values, counts, carried: [(carried[0], int(counts.sum()), *profiles.percentiles(values, counts, (0.25, 0.75, 0.98)))]
    d = returns(spark, sf, spread, "idx long, n long, a double, b double, h double")
    ok = rules.admissible(F.col("h"), F.col("n"), F.lit(1.0), F.col("b") - F.col("a"), F.col("idx") % 30 == 0, least_n=15, most_spread=20)
    return d.select("idx", "n", ok.alias("admitted"))


# Ordered operators

def along():
    return Window.partitionBy("okey").orderBy("pos")


@query("w1_segments", with_("paths") + " SELECT okey, pos, x AS ax, z AS az, bx, bz FROM (SELECT *, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM paths WINDOW w AS (PARTITION BY okey ORDER BY pos)) WHERE bx IS NOT NULL")
def w1(spark, sf):
    return segments(spark, sf).select("okey", "pos", "ax", "az", "bx", "bz")


def segments(spark, sf):
    d = fx.paths(spark, sf).select("okey", F.col("pos").cast("long").alias("pos"), F.col("x").alias("ax"), F.col("z").alias("az"), F.lead("x").over(along()).alias("bx"), F.lead("z").over(along()).alias("bz"))
    return d.where("bx IS NOT NULL").withColumn("len", F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("bz") - F.col("az"), 2)))


SEGS = "SELECT okey, pos, x AS ax, z AS az, bx, bz, sqrt((bx - x) ** 2 + (bz - z) ** 2) AS len FROM (SELECT *, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM paths WINDOW w AS (PARTITION BY okey ORDER BY pos)) WHERE bx IS NOT NULL"
ARC = "SELECT *, coalesce(sum(len) OVER (PARTITION BY okey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM segs"


@query("w2_fixed_interval", with_("paths", segs=SEGS, arc=ARC) + f" SELECT okey, CAST(k AS BIGINT) AS k, {sq('ax + (bx - ax) * (k * 250 - s0) / len', 2)} AS x, {sq('az + (bz - az) * (k * 250 - s0) / len', 2)} AS z FROM (SELECT *, unnest(range(CAST(ceil(s0 / 250) AS BIGINT), CAST(ceil((s0 + len) / 250) AS BIGINT))) AS k FROM arc WHERE len > 0)")
def w2(spark, sf):
    d = segments(spark, sf).where("len > 0").withColumn("s0", F.coalesce(F.sum("len").over(along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    a, b = F.ceil(F.col("s0") / 250), F.ceil((F.col("s0") + F.col("len")) / 250) - 1
    d = d.where(a <= b).withColumn("k", F.explode(F.sequence(a, b)))
    t = (F.col("k") * 250 - F.col("s0")) / F.col("len")
    return d.select("okey", "k", r(F.col("ax") + (F.col("bx") - F.col("ax")) * t, 2).alias("x"), r(F.col("az") + (F.col("bz") - F.col("az")) * t, 2).alias("z"))


@query("w3_backtrack", with_("paths") + f" SELECT okey, {sq('max(back)')} AS back FROM (SELECT okey, max(x) OVER (PARTITION BY okey ORDER BY pos) - x AS back FROM paths) GROUP BY okey")
def w3(spark, sf):
    return fx.paths(spark, sf).select("okey", (F.max("x").over(along().rowsBetween(Window.unboundedPreceding, 0)) - F.col("x")).alias("b")).groupBy("okey").agg(r(F.max("b"), 4).alias("back"))


@query("w4_spacing", with_("paths") + " SELECT okey, pos, x - lag(x) OVER (PARTITION BY okey ORDER BY x, pos) >= 12 AS ok FROM paths")
def w4(spark, sf):
    w = Window.partitionBy("okey").orderBy("x", "pos")
    return fx.paths(spark, sf).select("okey", F.col("pos").cast("long").alias("pos"), (F.col("x") - F.lag("x").over(w) >= 12).alias("ok"))


@query("w5_islands", with_("paths", f="SELECT *, x BETWEEN 200 AND 800 AS inside FROM paths", g="SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY okey ORDER BY pos) AS island FROM f") + " SELECT okey, min(pos) AS first, count(*) AS n FROM g WHERE inside GROUP BY okey, island HAVING count(*) >= 2")
def w5(spark, sf):
    d = fx.paths(spark, sf).withColumn("inside", F.col("x").between(200, 800))
    d = d.withColumn("island", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(along().rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("inside").groupBy("okey", "island").agg(F.min(F.col("pos").cast("long")).alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("island")


@query("w6_widest_gap", with_("points", i="SELECT okey % 500 AS k, x AS a, x + h AS b FROM points", g="SELECT k, a - max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM i") + f" SELECT k, {sq('greatest(coalesce(max(gap), 0), 0)')} AS gap FROM g GROUP BY k")
def w6(spark, sf):
    d = fx.points(spark, sf).select((F.col("okey") % 500).alias("k"), F.col("x").alias("a"), (F.col("x") + F.col("h")).alias("b"))
    w = Window.partitionBy("k").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("k", (F.col("a") - F.max("b").over(w)).alias("gap")).groupBy("k").agg(r(F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(0.0)), 4).alias("gap"))


@query("w7_histogram_peaks", with_("points", "footprints", tall=TALL, b="SELECT idx, CAST(floor(h * 2) AS BIGINT) AS bin, count(*) AS c FROM tall GROUP BY 1, 2") + " SELECT idx, bin, c FROM b WHERE c >= coalesce((SELECT c FROM b x WHERE x.idx = b.idx AND x.bin = b.bin - 1), 0) AND c > coalesce((SELECT c FROM b x WHERE x.idx = b.idx AND x.bin = b.bin + 1), 0)")
def w7(spark, sf):
    return returns(spark, sf, lambda values, counts, carried: [(carried[0], *p) for p in profiles.peaks(values * 2, counts)], "idx long, bin long, c long")


TOPS = """SELECT g.c, g.r, g.v FROM grid g WHERE EXISTS (SELECT 1 FROM grid n WHERE abs(n.c - g.c) <= 2 AND abs(n.r - g.r) <= 2 AND (n.c <> g.c OR n.r <> g.r))
  AND NOT EXISTS (SELECT 1 FROM grid n WHERE abs(n.c - g.c) <= 2 AND abs(n.r - g.r) <= 2 AND (n.c <> g.c OR n.r <> g.r) AND (n.v > g.v OR (n.v = g.v AND n.c || ':' || n.r < g.c || ':' || g.r)))"""


def tops(spark, sf):
    g = fx.grid(spark, sf).select("c", "r", "v")
    n = grids.neighbours(g.withColumnRenamed("v", "nv"), 2).select("c", "r", "nv", F.concat_ws(":", "c0", "r0").alias("nk"))
    best = n.groupBy("c", "r").agg(F.min(F.struct((-F.col("nv")).alias("v"), F.col("nk").alias("k"))).alias("m"))
    own = F.struct((-F.col("v")).alias("v"), F.concat_ws(":", "c", "r").alias("k"))
    return g.join(best, ["c", "r"]).where(own < F.col("m")).select("c", "r", "v")


@query("w8_local_maxima", with_("grid") + " " + TOPS)
def w8(spark, sf):
    return tops(spark, sf)


@query("w9_crown_radius", with_("grid", t=TOPS) + f" SELECT a.c, a.r, {sq('least(greatest(min(sqrt((a.c - b.c) ** 2 + (a.r - b.r) ** 2)) * 20 / 2, 1.5), 80)')} AS radius FROM t a JOIN t b ON (a.c <> b.c OR a.r <> b.r) AND (a.c - b.c) ** 2 + (a.r - b.r) ** 2 <= 100 GROUP BY a.c, a.r")
def w9(spark, sf):
    t = tops(spark, sf).select("c", "r", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("z"))
    b = t.select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    near = spatial.within_distance(t, b, 10.0).where("c <> c2 OR r <> r2")
    return near.groupBy("c", "r").agg(r(F.least(F.greatest(F.min("d") * 20 / 2, F.lit(1.5)), F.lit(80.0)), 4).alias("radius"))


FULL = "SELECT c::INTEGER AS c, r::INTEGER AS r, coalesce(g.v, 15.0::DOUBLE) AS v FROM (SELECT a.i AS c, b.i AS r FROM range(0, 51) a(i), range(0, 51) b(i)) LEFT JOIN grid g USING (c, r)"


def full(spark, sf):
    return grids.whole_grid(spark, 51, 51).join(fx.grid(spark, sf).select("c", "r", "v"), ["c", "r"], "left").fillna(15.0, ["v"])


@query("w10_box_blur", with_("grid", f=FULL, o="SELECT a.i AS dc, b.i AS dr FROM range(-2, 3) a(i), range(-2, 3) b(i)") + f" SELECT f.c, f.r, {sq('sum(n.v) / 25', 3)} AS v FROM f, o JOIN f n ON n.c = least(greatest(f.c + dc, 0), 50) AND n.r = least(greatest(f.r + dr, 0), 50) GROUP BY f.c, f.r")
def w10(spark, sf):
    return grids.box_blur(full(spark, sf), 2, 51, 51).select("c", "r", r(F.col("v"), 3).alias("v"))


@query("w12_top_one", with_("footprints") + " SELECT nm, idx FROM (SELECT nm, idx, row_number() OVER (PARTITION BY nm ORDER BY w DESC, idx) AS k FROM footprints) WHERE k = 1")
def w12(spark, sf):
    return spatial.first_per(feet(spark, sf), ["nm"], [F.desc("w"), F.col("idx")]).select("nm", "idx")


# Sorts, limits and set operations


@query("o1_stable_sort", with_("points") + " SELECT okey, line, pkey, skey, x, z FROM points ORDER BY x, z, okey, line, pkey, skey")
def o1(spark, sf):
    return fx.points(spark, sf).select("okey", "line", "pkey", "skey", "x", "z").orderBy("x", "z", "okey", "line", "pkey", "skey")


@query("o2_top_n", with_("points") + " SELECT okey, line, pkey, skey, h FROM points ORDER BY h DESC, okey, line, pkey, skey LIMIT 200")
def o2(spark, sf):
    return fx.points(spark, sf).select("okey", "line", "pkey", "skey", "h").orderBy(F.desc("h"), "okey", "line", "pkey", "skey").limit(200)


@query("o3_first_some_every", with_("paths") + " SELECT okey, min(pos) FILTER (h > 20) AS first, bool_or(h > 25) AS some, bool_and(h > 1) AS every FROM paths GROUP BY okey")
def o3(spark, sf):
    return fx.paths(spark, sf).groupBy("okey").agg(F.min(F.when(F.col("h") > 20, F.col("pos").cast("long"))).alias("first"), F.bool_or(F.col("h") > 25).alias("some"), F.bool_and(F.col("h") > 1).alias("every"))


@query("u1_union_by_kind", with_("footprints", "places") + " SELECT 'mass' AS kind, idx AS id, w FROM footprints UNION ALL SELECT 'place', id, NULL FROM places")
def u1(spark, sf):
    a = feet(spark, sf).select(F.lit("mass").alias("kind"), F.col("idx").alias("id"), "w")
    return a.unionByName(fx.places(spark, sf).select(F.lit("place").alias("kind"), "id"), allowMissingColumns=True)


@query("u2_key_union", with_("footprints", "places") + " SELECT idx AS id FROM footprints UNION SELECT id FROM places")
def u2(spark, sf):
    return feet(spark, sf).select(F.col("idx").alias("id")).union(fx.places(spark, sf).select("id")).distinct()


@query("u3_except", with_("grid", "voids") + " SELECT c, r FROM grid EXCEPT ALL SELECT c, r FROM voids")
def u3(spark, sf):
    return fx.grid(spark, sf).select("c", "r").exceptAll(fx.voids(spark, sf).select("c", "r"))


@query("u4_overlay", with_("grid", "voids") + " SELECT c, r, coalesce(o.v, v.v) AS v FROM voids v FULL JOIN (SELECT c, r, v + 100 AS v FROM grid WHERE c BETWEEN 10 AND 20 AND r BETWEEN 10 AND 20) o USING (c, r)")
def u4(spark, sf):
    return grids.overlay(fx.voids(spark, sf), fx.grid(spark, sf).where("c BETWEEN 10 AND 20 AND r BETWEEN 10 AND 20").withColumn("v", F.col("v") + 100))


@query("u5_reasoned_override", with_("footprints") + " SELECT idx, CASE WHEN idx % 90 = 0 THEN 12.5::DOUBLE ELSE w END AS h, CASE WHEN idx % 90 = 0 THEN 'surveyed' END AS reason FROM footprints")
def u5(spark, sf):
    over = feet(spark, sf).where("idx % 90 = 0").select("idx", F.lit(12.5).alias("value"), F.lit("surveyed").alias("reason"))
    bad = F.when(F.col("reason").isNull() & F.col("value").isNotNull(), F.raise_error(F.lit("an override needs a reason"))).otherwise(F.col("value"))
    return feet(spark, sf).join(over, "idx", "left").select("idx", F.coalesce(bad, "w").alias("h"), "reason")
