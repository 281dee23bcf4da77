"""Queries for scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import colour, geometry, numeric, rules, text
from geoloom.functions.numeric import half_up
from geoloom.plans import fixtures as fx
from geoloom.plans.fixtures import with_
from geoloom.operators import spatial
from geoloom.plans.registry import query
from geoloom.session import materialize

LAT0, LNG0 = 32.0, -117.0
_LL = "SELECT okey, line, pkey, skey, x, z, h, 32.0::DOUBLE - z / 111320 AS lat, -117.0::DOUBLE + x / 94404.9 AS lng FROM points"


def _latlng(spark, sf):
    return fx.points(spark, sf).withColumn("lat", F.lit(32.0) - F.col("z") / 111320).withColumn("lng", F.lit(-117.0) + F.col("x") / 94404.9)


def r(c, digits=4):
    return half_up(c, digits)


def sq(e, digits=4):
    return f"floor(({e}) * {10 ** digits} + 0.5) / {10 ** digits}"


KEY = ["okey", "line", "pkey", "skey"]
KEYS = "okey, line, pkey, skey"


@query("p1_local_metres", with_("points", ll=_LL) + f""" SELECT {KEYS}, floor((lng + 117) * (111320 * cos(radians(32.0::DOUBLE))) * 10 + 0.5) / 10 AS x,
  floor((32 - lat) * 111320 * 10 + 0.5) / 10 AS z FROM ll""")
def p1(spark, sf):
    return _latlng(spark, sf).withColumn("p", numeric.to_local(F.col("lat"), F.col("lng"), LAT0, LNG0)).select(*KEY, "p.x", "p.z")


@query("p2_web_mercator", with_("points", ll=_LL) + f""" SELECT {KEYS}, {sq("radians(lng) * 6378137", 2)} AS mx, {sq("ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137", 2)} AS my,
  {sq("lat", 7)} AS lat, {sq("lng", 7)} AS lng FROM ll""")
def p2(spark, sf):
    d = _latlng(spark, sf).withColumn("m", numeric.to_mercator(F.col("lat"), F.col("lng"))).withColumn("b", numeric.from_mercator(F.col("m.mx"), F.col("m.my")))
    return d.select(*KEY, r(F.col("m.mx"), 2).alias("mx"), r(F.col("m.my"), 2).alias("my"), r(F.col("b.lat"), 7).alias("lat"), r(F.col("b.lng"), 7).alias("lng"))


@query("p3_pixel_mercator", with_("points", ll=_LL) + f""" SELECT {KEYS}, {sq("(lng + 180) / 360 * 256 * 2 ** 19", 2)} AS px,
  {sq("(0.5::DOUBLE - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 2 ** 19", 2)} AS py, {sq("lat", 6)} AS lat,
  {sq("cos(radians(lat)) * 2 * pi() * 6378137 / (256 * 2 ** 19)", 6)} AS mpp FROM ll""")
def p3(spark, sf):
    zoom = F.lit(19.0)
    d = _latlng(spark, sf).withColumn("p", numeric.to_pixel(F.col("lat"), F.col("lng"), zoom)).withColumn("b", numeric.from_pixel(F.col("p.px"), F.col("p.py"), zoom))
    return d.select(*KEY, r(F.col("p.px"), 2).alias("px"), r(F.col("p.py"), 2).alias("py"), r(F.col("b.lat"), 6).alias("lat"), r(numeric.metres_per_pixel(F.col("lat"), zoom), 6).alias("mpp"))


@query("p4_two_point_fit", with_("points") + f""" SELECT {KEYS}, {sq("-117 + (x - 100) * 0.01 / 800", 10)} AS lng, {sq("33 - (z - 100) * 0.01 / 800", 10)} AS lat,
  abs(x - 500) * 0.0000125 * 111320 <= 400 AS ok FROM points""")
def p4(spark, sf):
    lng, lat = numeric.two_point_affine(F.col("x"), (100, -117), (900, -116.99)), numeric.two_point_affine(F.col("z"), (100, 33), (900, 32.99))
    return fx.points(spark, sf).select(*KEY, r(lng, 10).alias("lng"), r(lat, 10).alias("lat"), (F.abs(F.col("x") - 500) * 0.0000125 * 111320 <= 400).alias("ok"))


@query("p5_half_up", with_("points") + f" SELECT {KEYS}, floor((h - 15) * 10 + 0.5) / 10 AS tenth, floor((h - 15) * 100 + 0.5) / 100 AS hundredth, floor((h - 15) + 0.5) AS whole FROM points")
def p5(spark, sf):
    v = F.col("h") - 15
    return fx.points(spark, sf).select(*KEY, half_up(v, 1).alias("tenth"), half_up(v, 2).alias("hundredth"), half_up(v).alias("whole"))


@query("p6_decimetre_ring", with_("footprints") + """ SELECT idx, array_to_string(list_transform(ring, lambda p: array_to_string(list_transform(p, lambda v: CAST(CAST(floor(v * 10 + 0.5) AS INTEGER) AS VARCHAR)), ':')), ' ') AS dm FROM footprints""")
def p6(spark, sf):
    dm = numeric.to_decimetres(F.col("ring"))
    return fx.footprints(spark, sf).select("idx", F.array_join(F.transform(dm, lambda p: F.array_join(p.cast("array<string>"), ":")), " ").alias("dm"))


@query("p7_letterbox", with_("places") + f" SELECT id, {sq('x * 0.3 + 50')} AS mx, {sq('z * 0.3')} AS my FROM places")
def p7(spark, sf):
    return fx.places(spark, sf).withColumn("m", numeric.letterbox(F.col("x"), F.col("z"), (0, 0, 1000, 1000), 400, 300)).select("id", r(F.col("m.mx")).alias("mx"), r(F.col("m.my")).alias("my"))


@query("p8_rotate_template", with_("places") + f" SELECT id, {sq('x + 10 * cos(id / 10.0::DOUBLE) - 5 * sin(id / 10.0::DOUBLE)')} AS x, {sq('z + 10 * sin(id / 10.0::DOUBLE) + 5 * cos(id / 10.0::DOUBLE)')} AS z FROM places")
def p8(spark, sf):
    p = numeric.rotate(F.lit(10.0), F.lit(5.0), F.col("id") / 10, F.col("x"), F.col("z"))
    return fx.places(spark, sf).withColumn("p", p).select("id", r(F.col("p.x")).alias("x"), r(F.col("p.z")).alias("z"))


@query("p9_yaw", with_("points") + f" SELECT {KEYS}, {sq('(360 - h * 12) - 360 * floor((360 - h * 12) / 360)')} AS yaw FROM points")
def p9(spark, sf):
    return fx.points(spark, sf).select(*KEY, r(numeric.yaw_of(F.col("h") * 12)).alias("yaw"))


@query("p10_speed_map", with_("points") + f""" SELECT {KEYS}, {sq("2 * (200.0::DOUBLE / 2) ** (h / 30)")} AS speed, {sq("h / 30", 6)} AS t,
  {sq("least(greatest(h * 1.5, 2), 40)")} AS stepped, {sq("least(greatest(h * 0.8, 1), 20)")} AS climb FROM points""")
def p10(spark, sf):
    t = F.col("h") / 30
    v = numeric.log_slider(t, 2, 200)
    return fx.points(spark, sf).select(*KEY, r(v).alias("speed"), r(numeric.slider_of(v, 2, 200), 6).alias("t"), r(numeric.step_speed(F.col("h"), F.lit(1.0), 1.5, 2, 40)).alias("stepped"), r(numeric.climb_rate(F.col("h"), 0.8, 1, 20)).alias("climb"))


@query("p11_sine_hash", with_("places", h="SELECT id, sin(x * 12.9898::DOUBLE + z * 78.233::DOUBLE) * 43758.5453::DOUBLE AS s FROM places") + f" SELECT id, {sq('s - floor(s)', 5)} AS v FROM h")
def p11(spark, sf):
    return fx.places(spark, sf).select("id", r(numeric.sine_hash(F.col("x"), F.col("z")), 5).alias("v"))


@query("p12_alias_map", "SELECT p_partkey AS idx, CASE p_type WHEN 'ECONOMY' THEN 'plaza' WHEN 'STANDARD' THEN 'green' WHEN 'PROMO' THEN 'water' END AS kind FROM part")
def p12(spark, sf):
    kinds = {"ECONOMY": "plaza", "STANDARD": "green", "PROMO": "water"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.try_element_at(table, F.col("p_type")).alias("kind"))


@query("g1_ring_area", with_("footprints") + f" SELECT idx, {sq('w * w')} AS area, {sq('w * w - (w / 2) * (w / 2)')} AS with_hole FROM footprints")
def g1(spark, sf):
    hole = F.transform("ring", lambda p: F.array((p[0] - F.col("x0")) / 2 + F.col("x0") + 1, (p[1] - F.col("z0")) / 2 + F.col("z0") + 1))
    return fx.footprints(spark, sf).select("idx", r(geometry.area(F.col("ring"))).alias("area"), r(geometry.polygon_area(F.array("ring", hole))).alias("with_hole"))


@query("g2_vertex_mean", with_("footprints") + " SELECT idx, floor((x0 + (x0 + w) + (x0 + w) + x0) / 4 * 10 + 0.5) / 10 AS x, floor((z0 + z0 + (z0 + w) + (z0 + w)) / 4 * 10 + 0.5) / 10 AS z FROM footprints")
def g2(spark, sf):
    return fx.footprints(spark, sf).withColumn("m", geometry.vertex_mean(F.col("ring"))).select("idx", "m.x", "m.z")


@query("g3_bounds", with_("footprints") + f" SELECT idx, {sq('x0 - 1')} AS x0, {sq('z0 - 1')} AS z0, {sq('x0 + w + 1')} AS x1, {sq('z0 + w + 1')} AS z1 FROM footprints")
def g3(spark, sf):
    b = fx.footprints(spark, sf).withColumn("b", geometry.bounds(F.col("ring"), 1.0))
    return b.select("idx", *[r(F.col(f"b.{k}")).alias(k) for k in ("x0", "z0", "x1", "z1")])


@query("g4_point_in_ring", with_("footprints") + """ SELECT idx, k, q.x0 + dx * w >= q.x0 AND dx >= 0 AND dx < 1 AND dz >= 0 AND dz < 1 AS inside
  FROM footprints q, (VALUES (0, 0.5::DOUBLE, 0.5::DOUBLE), (1, 0.25, 0.75), (2, 1.25, 0.5), (3, 0.5, -0.25)) AS t(k, dx, dz)""")
def g4(spark, sf):
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in ((0, 0.5, 0.5), (1, 0.25, 0.75), (2, 1.25, 0.5), (3, 0.5, -0.25))])
    d = fx.footprints(spark, sf).withColumn("s", F.explode(spots))
    x, z = F.col("x0") + F.col("s.a") * F.col("w"), F.col("z0") + F.col("s.b") * F.col("w")
    return d.select("idx", F.col("s.k").alias("k"), geometry.inside(x, z, F.col("ring")).alias("inside"))


@query("g5_distance_to_ring", with_("footprints") + f""" SELECT idx, {sq("least(abs(500 - greatest(least(500, x0 + w), x0)), 1e9)")} AS dx, {sq('''
  CASE WHEN 500 > x0 AND 500 < x0 + w AND 500 > z0 AND 500 < z0 + w THEN least(500 - x0, x0 + w - 500, 500 - z0, z0 + w - 500)
  ELSE sqrt((500 - greatest(least(500, x0 + w), x0)) ** 2 + (500 - greatest(least(500, z0 + w), z0)) ** 2) END''')} AS d FROM footprints""")
def g5(spark, sf):
    n = geometry.nearest_on_ring(F.lit(500.0), F.lit(500.0), F.col("ring"))
    x = F.greatest(F.least(F.lit(500.0), F.col("x0") + F.col("w")), F.col("x0"))
    return fx.footprints(spark, sf).withColumn("n", n).select("idx", r(F.abs(500 - x)).alias("dx"), r(F.col("n.d")).alias("d"))


@query("g6_segment_crosses_ring", with_("footprints") + " SELECT idx, z0 < 500 AND z0 + w > 500 AND x0 > 0 AND x0 + w < 1000 AS crosses, x0 <= 600 AND x0 + w >= 400 AND z0 <= 600 AND z0 + w >= 400 AS meets FROM footprints WHERE z0 <> 500 AND x0 > 0 AND x0 + w < 1000")
def g6(spark, sf):
    d = fx.footprints(spark, sf).where("z0 <> 500 AND x0 > 0 AND x0 + w < 1000")
    one = F.lit
    return d.select("idx", geometry.segment_hits_ring(one(-10.0), one(500.0), one(1010.0), one(500.0), F.col("ring")).alias("crosses"), geometry.rectangle_meets_ring(one(400.0), one(400.0), one(600.0), one(600.0), F.col("ring")).alias("meets"))


@query("g7_ring_stats", with_("footprints") + f" SELECT idx, {sq('w * w')} AS area, {sq('4 * w')} AS perimeter, {sq('w')} AS width FROM footprints")
def g7(spark, sf):
    closed = F.array_append("ring", F.element_at("ring", 1))
    d = fx.footprints(spark, sf).withColumn("s", geometry.ring_stats(geometry.open_ring(closed)))
    return d.select("idx", r(F.col("s.area")).alias("area"), r(F.col("s.perimeter")).alias("perimeter"), r(F.col("s.width")).alias("width"))


@query("g8_oriented_frame", with_("footprints") + f" SELECT idx, {sq('2 * w', 3)} AS length, {sq('w', 3)} AS width FROM footprints")
def g8(spark, sf):
    long = F.transform("ring", lambda p: F.array((p[0] - F.col("x0")) * 2, p[1] - F.col("z0")))
    return fx.footprints(spark, sf).withColumn("f", geometry.oriented_frame(long)).select("idx", r(F.col("f.length"), 3).alias("length"), r(F.col("f.width"), 3).alias("width"))


@query("g9_line_length", with_("paths") + """ SELECT okey, floor(coalesce(sum(d), 0) * 100 + 0.5) / 100 AS length, count(*) AS n FROM (
  SELECT okey, sqrt((x - lag(x) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS d FROM paths WINDOW w AS (PARTITION BY okey ORDER BY pos)) GROUP BY okey""")
def g9(spark, sf):
    lines = fx.paths(spark, sf).groupBy("okey").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "z"))).alias("v"))
    return lines.select("okey", r(geometry.line_length(F.transform("v", lambda p: F.array(p["x"], p["z"]))), 2).alias("length"), F.size("v").cast("long").alias("n"))


@query("g10_coverage_ratio", with_("footprints") + f""" SELECT a.idx, b.idx AS other, {sq('''
  count(*) FILTER (a.x0 + 2 * i + 1 >= b.x0 AND a.x0 + 2 * i + 1 < b.x0 + b.w AND a.z0 + 2 * j + 1 >= b.z0 AND a.z0 + 2 * j + 1 < b.z0 + b.w) / count(*)''')} AS ratio
  FROM footprints a JOIN footprints b ON a.nm = b.nm AND a.idx <> b.idx AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.z0 < b.z0 + b.w AND b.z0 < a.z0 + a.w,
  range(0, 20) AS i(i), range(0, 20) AS j(j)
  WHERE a.x0 + 2 * i + 1 < a.x0 + a.w AND a.z0 + 2 * j + 1 < a.z0 + a.w GROUP BY 1, 2""")
def g10(spark, sf):
    f = fx.footprints(spark, sf)
    cells = lambda d: spatial.ring_cells(d, 32.0).drop("_ring")
    a = cells(f)
    names = {"idx": "other", "nm": "bnm", "x0": "bx", "z0": "bz", "w": "bw", "ring": "bring", "_cx": "_bx", "_cz": "_bz", "_box": "_bbox", "_b": "_bb"}
    b = cells(f).withColumnsRenamed(names)
    # Two rings share several cells; the pair counts in the first of these.
    first = (F.col("_cx") == F.floor(F.greatest("_b.x0", "_bb.x0") / 32)) & (F.col("_cz") == F.floor(F.greatest("_b.z0", "_bb.z0") / 32))
    met = a.join(b.hint("merge"), (F.col("nm") == F.col("bnm")) & (F.col("_cx") == F.col("_bx")) & (F.col("_cz") == F.col("_bz")) & first & F.expr("idx <> other AND x0 < bx + bw AND bx < x0 + w AND z0 < bz + bw AND bz < z0 + w"))
    ratio = F.when(F.col("_box") & F.col("_bbox"), geometry.box_coverage(F.col("_b"), F.col("_bb"))).otherwise(geometry.coverage(F.col("ring"), F.col("bring")))
    return met.select("idx", "other", r(ratio).alias("ratio"))


@query("g15_trim_to_core", with_("footprints") + f""" , t AS (SELECT idx, x0, z0, x0 + w AS x1, z0 + w AS z1 FROM footprints)
  SELECT idx, {sq("CASE WHEN apart THEN x0 WHEN x0 < 300 THEN x0 WHEN x1 > 700 THEN greatest(x0, 700) ELSE x0 END")} AS x0,
  {sq("CASE WHEN apart THEN z0 WHEN x0 < 300 OR x1 > 700 OR z0 < 300 THEN z0 ELSE greatest(z0, 700) END")} AS z0,
  {sq("CASE WHEN apart THEN x1 WHEN x0 < 300 THEN least(x1, 300) ELSE x1 END")} AS x1,
  {sq("CASE WHEN apart OR x0 < 300 OR x1 > 700 THEN z1 WHEN z0 < 300 THEN least(z1, 300) ELSE z1 END")} AS z1
  FROM (SELECT *, x1 <= 300 OR x0 >= 700 OR z1 <= 300 OR z0 >= 700 AS apart FROM t) WHERE NOT (x0 >= 300 AND x1 <= 700 AND z0 >= 300 AND z1 <= 700)""")
def g15(spark, sf):
    d = fx.footprints(spark, sf).withColumn("b", geometry.trim_box(F.col("x0"), F.col("z0"), F.col("x0") + F.col("w"), F.col("z0") + F.col("w"), 300, 300, 700, 700))
    return d.where("b IS NOT NULL").select("idx", *[r(F.col(f"b.{k}")).alias(k) for k in ("x0", "z0", "x1", "z1")])


@query("g17_erosion_distance", with_("footprints") + f" SELECT idx, {sq('least(w * 0.15, w * 0.25, 3)')} AS d, {sq('CASE nm WHEN $$Brand#1$$ THEN 12 WHEN $$Brand#2$$ THEN 7 ELSE 5 END / 2')} AS half FROM footprints")
def g17(spark, sf):
    return fx.footprints(spark, sf).select("idx", r(geometry.erosion_distance(F.col("w"), F.col("w"), 0.15, 0.25, 3)).alias("d"), r(geometry.half_width(F.col("nm"), {"Brand#1": 12, "Brand#2": 7}, 5)).alias("half"))


_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query("c1_normalise_name", f"SELECT p_partkey AS idx, {_NORM.format('p_name || $$ & $$ || p_brand')} AS name, array_to_string(list_filter(string_split({_NORM.format('p_name || $$ & $$ || p_brand')}, ' '), lambda t: t NOT IN ('and', 'brand')), ' ') AS bare FROM part")
def c1(spark, sf):
    n = F.concat("p_name", F.lit(" & "), "p_brand")
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), text.normalise_name(n).alias("name"), text.normalise_name(n, ("and", "brand")).alias("bare"))


@query("c2_names_match", """SELECT c_custkey AS id, s_suppkey AS other, coalesce(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') = replace(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'), 'supplier', 'customer'), false) AS same
  FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50""")
def c2(spark, sf):
    # Names are taken apart once for each row, not for each pair.
    parts = lambda d, key, name, side: d.select(F.col(key).alias(f"{side}id"), (F.col(key) % 50).alias(f"{side}k"), *text.match_parts(F.col(name), side, {"supplier": "customer"}))
    c = parts(fx.table(spark, sf, "customer"), "c_custkey", "c_name", "a")
    s = parts(fx.table(spark, sf, "supplier"), "s_suppkey", "s_name", "b")
    return c.join(s, F.col("ak") == F.col("bk")).select(F.col("aid").alias("id"), F.col("bid").alias("other"), text.parts_match("a", "b").alias("same"))


@query("c3_name_similarity", f"""WITH t AS (SELECT a.p_partkey AS idx, b.p_partkey AS other, list_distinct(string_split(lower(a.p_name), ' ')) AS x, list_distinct(string_split(lower(b.p_name), ' ')) AS y
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
  SELECT idx, other, {sq("len(list_intersect(x, y))::DOUBLE / least(len(x), len(y))")} AS similarity FROM t""")
def c3(spark, sf):
    # Similarity once for each pair of different names of a group, then joined to the rows.
    keys = ["p_brand", "p_size"]
    a = fx.table(spark, sf, "part").where("p_brand IS NOT NULL AND p_size IS NOT NULL").select(F.col("p_partkey").alias("idx"), F.coalesce("p_name", F.lit("")).alias("x"), F.col("p_name").isNull().alias("xn"), *keys)
    b = a.withColumnsRenamed({"idx": "other", "x": "y", "xn": "yn"})
    names = a.select("x", "xn", *keys).distinct()
    pairs = names.join(names.withColumnsRenamed({"x": "y", "xn": "yn"}), keys).withColumn("similarity", r(text.name_similarity(F.when(~F.col("xn"), F.col("x")), F.when(~F.col("yn"), F.col("y")))))
    left = a.join(materialize(pairs, "similar").hint("merge"), [*keys, "x", "xn"])
    return left.join(b.hint("merge"), [*keys, "y", "yn"]).where("idx < other").select("idx", "other", "similarity")


@query("c4_fix_name", with_("places") + " SELECT id, CASE WHEN name = 'Supplier#000000001' THEN 'First' WHEN x BETWEEN 0 AND 500 AND z BETWEEN 0 AND 500 THEN 'Hall ' || substr(name, 10) ELSE substr(name, 10) END AS name FROM places")
def c4(spark, sf):
    short = F.substring("name", 10, 100)
    return fx.places(spark, sf).select("id", text.fix_name(F.when(F.col("name") == "Supplier#000000001", F.col("name")).otherwise(short), {"Supplier#000000001": "First"}, rules.in_box(F.col("x"), F.col("z"), 0, 0, 500, 500), "Hall ").alias("name"))


RUNGS, TOP = [(100.0, 4.0), (400.0, 7.0), (900.0, 11.0)], 16.0
_LADDER = "CASE WHEN w * w < 100 THEN 4.0::DOUBLE WHEN w * w < 400 THEN 7 WHEN w * w < 900 THEN 11 ELSE 16 END"


@query("c5_height_by_tags", with_("footprints") + f" SELECT idx, {sq('CASE WHEN idx % 3 = 0 THEN w WHEN idx % 3 = 1 THEN (idx % 12 + 1) * 3.6 + 1.2 ELSE ' + _LADDER + ' END')} AS h, CASE WHEN idx % 3 = 0 THEN 'height' WHEN idx % 3 = 1 THEN 'levels' ELSE 'area' END AS src FROM footprints")
def c5(spark, sf):
    tag, levels = F.when(F.col("idx") % 3 == 0, F.col("w")), F.when(F.col("idx") % 3 == 1, F.col("idx") % 12 + 1)
    h = rules.height_by_precedence(tag, levels, r(geometry.area(F.col("ring")), 6), RUNGS, TOP, 3.6, 1.2)
    return fx.footprints(spark, sf).withColumn("t", h).select("idx", r(F.col("t.h")).alias("h"), F.col("t.src").alias("src"))


@query("c6_regional_height", with_("footprints") + f" SELECT idx, {sq('CASE WHEN idx % 4 = 0 AND w <= 30 THEN w WHEN idx % 40 BETWEEN 1 AND 20 THEN (idx % 40) * 3.4 + 1.05 ELSE ' + _LADDER + ' END')} AS h, CASE WHEN idx % 4 = 0 AND w <= 30 THEN 'height' WHEN idx % 40 BETWEEN 1 AND 20 THEN 'levels' ELSE 'area' END AS src FROM footprints")
def c6(spark, sf):
    tag = F.when(F.col("idx") % 4 == 0, F.col("w"))
    h = rules.height_by_precedence(tag, F.col("idx") % 40, F.col("w") * F.col("w"), RUNGS, TOP, 3.4, 1.05, most=30, most_levels=20)
    return fx.footprints(spark, sf).withColumn("t", h).select("idx", r(F.col("t.h")).alias("h"), F.col("t.src").alias("src"))


@query("c7_parse_number_prefix", "SELECT event_id, try_cast(regexp_extract(t, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) AS v FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || CAST(event_id AS VARCHAR) || '.5 m' WHEN 1 THEN event_type ELSE '-' || CAST(event_id AS VARCHAR) || 'e1x' END AS t FROM events)")
def c7(spark, sf):
    k, e = F.col("event_id"), F.col("event_id").cast("string")
    t = F.when(k % 3 == 0, F.concat(F.lit(" "), e, F.lit(".5 m"))).when(k % 3 == 1, F.col("event_type")).otherwise(F.concat(F.lit("-"), e, F.lit("e1x")))
    return fx.table(spark, sf, "events").select("event_id", text.parse_number(t).alias("v"))


@query("c8_colour_spaces", with_("pixels") + """ , n AS (SELECT *, greatest(red, green, blue) / 255.0::DOUBLE AS t, least(red, green, blue) / 255.0::DOUBLE AS b FROM pixels)
  SELECT okey, line, pkey, skey, """ + f"""{sq("(t + b) / 2")} AS light, {sq("CASE WHEN t = b THEN 0 ELSE (t - b) / (1 - abs((t + b) - 1)) END")} AS sat,
  {sq("CASE WHEN red / 255.0::DOUBLE <= 0.04045 THEN red / 255.0::DOUBLE / 12.92 ELSE ((red / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END")} AS lin,
  red AS back, '#' || lower(printf('%02x%02x%02x', red, green, blue)) AS hex, {sq("red * 0.2126 + green * 0.7152 + blue * 0.0722")} AS l709, {sq("red * 0.299 + green * 0.587 + blue * 0.114")} AS l601 FROM n""")
def c8(spark, sf):
    a = [F.col(c) for c in ("red", "green", "blue")]
    d = fx.pixels(spark, sf).withColumn("hsl", colour.rgb_to_hsl(*a)).withColumn("rgb", colour.hsl_to_rgb(F.col("hsl.h"), F.col("hsl.s"), F.col("hsl.l")))
    lin = colour.srgb_to_linear(a[0])
    return d.select(*KEY, r(F.col("hsl.l")).alias("light"), r(F.col("hsl.s")).alias("sat"), r(lin).alias("lin"), F.col("rgb.r").alias("back"), colour.to_hex(*a).alias("hex"), r(colour.luma709(*a)).alias("l709"), r(colour.luma601(*a)).alias("l601"))


_CHANNEL = "CAST(floor(greatest(0, least(1, l - s * least(l, 1 - l) * greatest(least({k} - 3, 9 - {k}, 1), -1))) * 255 + 0.5) AS INTEGER)"


@query("c8_gamut_clamp", with_("pixels", n="SELECT okey, line, pkey, skey, red / 255.0::DOUBLE AS a, green / 255.0::DOUBLE AS b, blue / 255.0::DOUBLE AS c FROM pixels",
  m="SELECT *, greatest(a, b, c) AS t, greatest(a, b, c) - least(a, b, c) AS d, (greatest(a, b, c) + least(a, b, c)) / 2 AS l0 FROM n",
  h="SELECT *, CASE WHEN d = 0 THEN 0 WHEN t = a THEN CASE WHEN b < c THEN ((b - c) / d + 6) % 6 ELSE (b - c) / d % 6 END WHEN t = b THEN (c - a) / d + 2 ELSE (a - b) / d + 4 END / 6 * 12 AS h, least(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(l0 * 2 - 1)) END, 0.55) AS s, greatest(0.2::DOUBLE, least(0.85::DOUBLE, l0)) AS l FROM m")
  + f" SELECT okey, line, pkey, skey, {_CHANNEL.format(k='(h % 12)')} AS red, {_CHANNEL.format(k='((h + 8) % 12)')} AS green, {_CHANNEL.format(k='((h + 4) % 12)')} AS blue FROM h")
def c8b(spark, sf):
    a = [F.col(c) for c in ("red", "green", "blue")]
    return fx.pixels(spark, sf).withColumn("k", colour.clamp_gamut(*a)).select(*KEY, F.col("k.r").alias("red"), F.col("k.g").alias("green"), F.col("k.b").alias("blue"))


@query("c9_pixel_tests", with_("pixels") + f""" SELECT {KEYS}, {sq("greatest(red * 0.299::DOUBLE + green * 0.587::DOUBLE + blue * 0.114::DOUBLE - 100, 0) * (1 - CASE WHEN greatest(red, green, blue) > 0 THEN (greatest(red, green, blue) - least(red, green, blue))::DOUBLE / greatest(red, green, blue) ELSE 0 END)")} AS white,
  2 * green - red - blue > 20 OR (red * 0.299::DOUBLE + green * 0.587::DOUBLE + blue * 0.114::DOUBLE < 90 AND green > red AND green > blue) AS vegetation FROM pixels""")
def c9(spark, sf):
    a = [F.col(c) for c in ("red", "green", "blue")]
    return fx.pixels(spark, sf).select(*KEY, r(colour.whiteness(*a, F.lit(100.0))).alias("white"), colour.is_vegetation(*a).alias("vegetation"))


@query("c10_tree_species", with_("places", t="SELECT id, x, z, (id % 30)::DOUBLE AS h, (id % 7)::DOUBLE AS cr, sin(x * 12.9898::DOUBLE + z * 78.233::DOUBLE) * 43758.5453::DOUBLE AS s FROM places") + f""" SELECT id, CASE WHEN h > 18 AND cr < h * 0.25 THEN 'palm' WHEN h > 18 THEN 'eucalyptus' WHEN s - floor(s) < 0.5 THEN 'oak' ELSE 'pine' END AS species,
  {sq("least(greatest(cr, 0.8), 9)")} AS r, {sq("least(greatest(h * 0.35, least(greatest(cr, 0.8), 9) * 0.6), h * 0.48)")} AS half FROM t""")
def c10(spark, sf):
    h, crown = (F.col("id") % 30).cast("double"), (F.col("id") % 7).cast("double")
    d = fx.places(spark, sf).withColumn("k", rules.crown_shape(h, crown))
    return d.select("id", rules.tree_species(F.col("x"), F.col("z"), h, crown).alias("species"), r(F.col("k.r")).alias("r"), r(F.col("k.half")).alias("half"))


@query("c11_reconcile_heights", with_("footprints", t="SELECT idx, w AS a, (idx % 50)::DOUBLE AS b FROM footprints") + f" SELECT idx, {sq('CASE WHEN abs(a - b) <= greatest(8, least(a, b) * 0.45) THEN b ELSE greatest(a, b) END')} AS h FROM t")
def c11(spark, sf):
    return fx.footprints(spark, sf).select("idx", r(rules.reconcile(F.col("w"), (F.col("idx") % 50).cast("double"))).alias("h"))


@query("c13_zone_predicates", with_("places") + " SELECT id, x BETWEEN 200 AND 600 AND z BETWEEN 100 AND 500 AS core, (x - 500) ** 2 + (z - 500) ** 2 <= 10000 OR (x - 100) ** 2 + (z - 900) ** 2 <= 10000 AS near FROM places")
def c13(spark, sf):
    x, z = F.col("x"), F.col("z")
    return fx.places(spark, sf).select("id", rules.in_box(x, z, 200, 100, 600, 500).alias("core"), rules.near_any(x, z, [(500, 500), (100, 900)], 100).alias("near"))


@query("c15_fingerprint", with_("footprints") + """ SELECT substr(sha1(string_agg(k, '' ORDER BY idx)), 1, 16) AS fingerprint, count(*) AS n FROM (
  SELECT idx, CAST(CAST(floor(floor((x0 + (x0 + w) + (x0 + w) + x0) / 4 * 10 + 0.5) / 10 * 10 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(floor((z0 + z0 + (z0 + w) + (z0 + w)) / 4 * 10 + 0.5) / 10 * 10 + 0.5) AS BIGINT) AS VARCHAR) AS k FROM footprints)""")
def c15(spark, sf):
    d = fx.footprints(spark, sf).select("idx", text.centroid_key(F.col("ring")).alias("k"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("idx", "k"))), lambda t: t["k"])
    return d.agg(text.fingerprint(keys).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("c16_centroid_key", with_("footprints") + " SELECT idx, CAST(CAST(floor(floor((x0 + (x0 + w) + (x0 + w) + x0) / 4 * 10 + 0.5) / 10 * 10 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(floor((z0 + z0 + (z0 + w) + (z0 + w)) / 4 * 10 + 0.5) / 10 * 10 + 0.5) AS BIGINT) AS VARCHAR) AS k FROM footprints")
def c16(spark, sf):
    return fx.footprints(spark, sf).select("idx", text.centroid_key(F.col("ring")).alias("k"))


@query("f1_admission_routes", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'building' WHEN event_type = 'click' THEN 'path' WHEN event_type = 'error' AND value > 50 THEN 'water' END AS kind FROM events) WHERE kind IS NOT NULL GROUP BY kind")
def f1(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "building").when(F.col("event_type") == "click", "path").when((F.col("event_type") == "error") & (F.col("value") > 50), "water")
    return fx.table(spark, sf, "events").select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("f2_minimum_area", with_("footprints") + " SELECT idx FROM footprints WHERE w * w >= 60 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 10 = idx)")
def f2(spark, sf):
    gone = fx.table(spark, sf, "supplier").select((F.col("s_suppkey") * 10).alias("idx"))
    return fx.footprints(spark, sf).where(geometry.area(F.col("ring")) >= 60).join(gone, "idx", "left_anti").select("idx")


@query("f3_drop_reasons", with_("points") + " SELECT CASE WHEN x < 100 THEN 'west' WHEN x BETWEEN 400 AND 600 AND z BETWEEN 400 AND 600 THEN 'core' WHEN h < 1 THEN 'low' ELSE 'kept' END AS reason, count(*) AS n FROM points GROUP BY 1")
def f3(spark, sf):
    reason = F.when(F.col("x") < 100, "west").when(rules.in_box(F.col("x"), F.col("z"), 400, 400, 600, 600), "core").when(F.col("h") < 1, "low").otherwise("kept")
    return fx.points(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f4_ground_returns", with_("points") + f" SELECT {KEYS}, x, z, h FROM points WHERE cls = 2")
def f4(spark, sf):
    return fx.points(spark, sf).where("cls = 2").select(*KEY, "x", "z", "h")


@query("f5_epoch_gate", with_("footprints") + " SELECT idx, CASE WHEN idx % 50 = 0 THEN 9.5::DOUBLE WHEN w < 0.6 * (idx % 60) THEN NULL ELSE w END AS h FROM footprints WHERE idx % 70 <> 0")
def f5(spark, sf):
    d = fx.footprints(spark, sf)
    audited = d.where("idx % 50 = 0").select("idx", F.lit(9.5).alias("audited"))
    late = d.where("idx % 70 = 0").select("idx")
    h = F.coalesce("audited", F.when(~(F.col("w") < (F.col("idx") % 60) * 0.6), F.col("w")))
    return d.join(late, "idx", "left_anti").join(audited, "idx", "left").select("idx", h.alias("h"))


@query("f7_height_sanity", with_("points") + f" SELECT {KEYS}, h BETWEEN 2 AND 90 AS campus, h BETWEEN 2.5 AND 90 AS region, h / 4 BETWEEN 2.2 AND 6.5 AS storey FROM points")
def f7(spark, sf):
    return fx.points(spark, sf).select(*KEY, F.col("h").between(2, 90).alias("campus"), F.col("h").between(2.5, 90).alias("region"), (F.col("h") / 4).between(2.2, 6.5).alias("storey"))


@query("f8_suspect_colour", with_("pixels", n="SELECT *, greatest(red, green, blue) - least(red, green, blue) AS s FROM pixels") + " SELECT okey, line, pkey, skey, CASE WHEN (red > green AND green > blue AND s >= 60) OR s >= 200 THEN 'suspect' ELSE 'roof' END AS route FROM n")
def f8(spark, sf):
    s = F.greatest("red", "green", "blue") - F.least("red", "green", "blue")
    earthy = (F.col("red") > F.col("green")) & (F.col("green") > F.col("blue"))
    return fx.pixels(spark, sf).select(*KEY, F.when((earthy & (s >= 60)) | (s >= 200), "suspect").otherwise("roof").alias("route"))


@query("f9_acceptance_gates", with_("footprints") + " SELECT idx FROM footprints WHERE w / 40 >= CASE nm WHEN 'Brand#1' THEN 0.9 WHEN 'Brand#2' THEN 0.3 ELSE 0.5 END")
def f9(spark, sf):
    gate = F.when(F.col("nm") == "Brand#1", 0.9).when(F.col("nm") == "Brand#2", 0.3).otherwise(0.5)
    return fx.footprints(spark, sf).where(F.col("w") / 40 >= gate).select("idx")
