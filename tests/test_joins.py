"""Joins of shapes and points: no grown side is broadcast, and what is left out could not have mattered."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom import plans
from geoloom.functions import geometry, text
from geoloom.operators import spatial
from geoloom.plans import fixtures as fx
from tests.conftest import SF

QUERIES = plans.queries()


def boxes(spark, rows):
    """rows of idx, x0, z0, w as rings."""
    d = spark.createDataFrame(rows, "idx long, x0 double, z0 double, w double")
    at = lambda i, j: F.array(F.col("x0") + F.col("w") * i, F.col("z0") + F.col("w") * j)
    return d.withColumn("ring", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)))


def world(n, seed):
    rnd = random.Random(seed)
    rings = [(k, rnd.randrange(0, 80) / 1.0, rnd.randrange(0, 80) / 1.0, float(rnd.choice([4, 16, 32, 40]))) for k in range(n)]
    return rings, [(k, rnd.randrange(0, 240) / 2, rnd.randrange(0, 240) / 2) for k in range(n)]


def holds(p, f):
    return f[1] <= p[1] < f[1] + f[3] and f[2] <= p[2] < f[2] + f[3]


@pytest.mark.parametrize("name", ["j12_sliver_suppression", "j8_host_assignment", "j2_containment_minus_excluded", "j3_cells_outside_hosts", "j30_building_hit", "t9_zone_placement", "j1_point_in_polygon", "j11_nested_pad_suppression", "j22_nearest_nodes", "i5_entry_choice"])
def test_grown_sides_are_not_broadcast(spark, name):
    """Catalyst takes exploded rows for as large as the table they came from: 60 times sf0.1 ended on the driver's memory."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan


def test_largest_near_is_within_the_radius(spark):
    rnd = random.Random(3)
    rows = [(k, "ab"[k % 2], rnd.uniform(-50, 50), rnd.uniform(-50, 50), float(rnd.randrange(40))) for k in range(200)]
    d = spark.createDataFrame(rows, "id long, name string, x double, z double, side double")
    for a in spatial.largest_near(d, "side", "name", 20.0).collect():
        near = [b[4] for b in rows if b[1] == a.name and (a.x - b[2]) ** 2 + (a.z - b[3]) ** 2 <= 400]
        assert a.side <= a.near <= max(near)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_ring_leaves_out_the_point_s_own(spark, seed):
    rings, points = world(120, seed)
    got = {r.id: r.idx for r in spatial.first_ring(spark.createDataFrame(points, "id long, x double, z double"), boxes(spark, rings + rings[:20]), "id", "idx").collect()}
    want = {p[0]: min(f[0] for f in rings if holds(p, f) and f[0] != p[0]) for p in points if any(holds(p, f) and f[0] != p[0] for f in rings)}
    assert got == want


def test_hold_apart_is_greedy_in_the_order_of_ids(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.uniform(-30, 30), rnd.uniform(-30, 30)) for k in range(300)]
    kept = []
    for name, k, x, z in rows:
        if name is None or not any(n == name and (x - bx) ** 2 + (z - bz) ** 2 <= 100 for n, _, bx, bz in kept):
            kept.append((name, k, x, z))
    rnd.shuffle(rows)
    got = spatial.hold_apart(spark.createDataFrame(rows, "name string, id long, x double, z double"), 10.0).collect()
    assert len(got) == 300 and sorted(r.id for r in got if r.held) == [k for _, k, _, _ in kept]


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner"])
def test_covered_cells_give_the_same_points(spark, how):
    rings, points = world(60, 7)
    got = spatial.points_in_rings(spark.createDataFrame(points, "id long, x double, z double"), boxes(spark, rings[:8]), how=how).select("id").collect()
    want = {"inner": [p[0] for p in points for f in rings[:8] if holds(p, f)], "left_semi": [p[0] for p in points if any(holds(p, f) for f in rings[:8])], "left_anti": [p[0] for p in points if not any(holds(p, f) for f in rings[:8])]}[how]
    assert sorted(r.id for r in got) == sorted(want)


def test_match_parts_equal_names_match(spark):
    names = ["Supplier#1", "customer 1", "CUSTOMER#1", "", None]
    d = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    table = {"supplier": "customer"}
    both = d.select(text.names_match(F.col("a"), F.col("b"), table).alias("want"), *text.match_parts(F.col("a"), "a", table), *text.match_parts(F.col("b"), "b", table))
    assert all(r.want == r.got for r in both.select("want", text.parts_match("a", "b").alias("got")).collect())


def test_similarity_is_taken_once_for_equal_names(spark, tmp_path):
    rows = [(k, ["red bolt", "red nut", None][k % 3], "b", 1) for k in range(12)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["c3_name_similarity"](spark, str(tmp_path))
    assert sorted((r.idx, r.other) for r in got.collect()) == [(a, b) for a in range(12) for b in range(a + 1, 12)]
    assert "intersect" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_sizes_are_split_once(spark):
    """The shape of a size is split for each size, not for each row."""
    plan = QUERIES["g16_neck_split"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") > plan.index("ArrowEvalPython")  # the plan lists the last step first


def test_box_coverage_equals_that_of_rings(spark):
    rings, _ = world(12, 9)
    a = boxes(spark, rings)
    pairs = a.select("ring").crossJoin(a.select(F.col("ring").alias("other")))
    got = pairs.select(geometry.coverage(F.col("ring"), F.col("other")).alias("a"), geometry.box_coverage(geometry.bounds(F.col("ring")), geometry.bounds(F.col("other"))).alias("b")).collect()
    assert len(got) == 144 and all(r.a == r.b for r in got)


def test_places_at_one_spot_are_joined_once(spark, tmp_path, monkeypatch):
    """Each place was joined to each middle: 60 times sf0.1 has 3 * 10^9 such pairs."""
    import duckdb

    ids = [k % 7 + 1000 * (k // 7) for k in range(70)] + [3, 1003, 70003, 200003]  # equal spots, repeated rows, spans of ids
    spark.createDataFrame([(k, f"Supplier#{k % 23}" if k % 11 else None) for k in ids], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 31}", k % 50) for k in range(400)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen, plain = [], spatial.within_distance
    monkeypatch.setattr(spatial, "within_distance", lambda a, b, *c, **d: seen.append(b) or plain(a, b, *c, **d))
    got = QUERIES["j27_cross_source_audit"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(plans.oracle_sql()["j27_cross_source_audit"]).fetchall()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want)
    assert seen[0].count() == 9  # seven spots, one of them with ids of three spans


@pytest.mark.parametrize("name", ["j3_cells_outside_hosts", "j30_building_hit"])
def test_rings_are_in_few_cells_for_few_points(spark, monkeypatch, name):
    """At cells of 16 m a ring of these queries was in six to ten."""
    seen, plain = [], spatial.ring_cells
    monkeypatch.setattr(spatial, "ring_cells", lambda rings, *a, **b: seen.append((rings, plain(rings, *a, **b))) or seen[-1][1])
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    (rings, cells), = seen
    assert cells.count() < 3 * rings.count() and plan.count("SortMergeJoin") <= (2 if "j30" in name else 1)


def test_one_ring_is_enough_over_a_cell(spark, monkeypatch):
    """Of the rings over a cell that one covers, those stayed whose hash came first."""
    seen, plain = [], spatial.needed_cells
    monkeypatch.setattr(spatial, "needed_cells", lambda *a: seen.append(plain(*a)) or seen[-1])
    rings, points = world(200, 11)
    spatial.points_in_rings(spark.createDataFrame(points, "id long, x double, z double"), boxes(spark, rings), how="left_semi")
    rows = seen[0].withColumn("full", spatial._covers(16.0)).groupBy("_cx", "_cz").agg(F.max("full").alias("full"), F.count("*").alias("n")).where("full").collect()
    assert len(rows) > 10 and all(r.n == 1 for r in rows)


def test_lattice_points_are_added_up_as_in_sql(spark, tmp_path):
    """Corners in hundredths of a metre: of x0 + 2i + 1 and x0 + (2i + 1) only one is below an edge at the same place."""
    import duckdb

    sizes = [(7618, 33), (13931, 31), (16675, 19), (34809, 7), (44461, 10), (78444, 38), (95636, 26), (103734, 49), (119717, 39), (119967, 50)]
    spark.createDataFrame([(k, "Brand#1", s) for k, s in sizes], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    f = fx.footprints(spark, str(tmp_path))
    plain = f.select("ring").crossJoin(f.select(F.col("ring").alias("other"))).select(geometry.coverage(F.col("ring"), F.col("other")).alias("a"), geometry.box_coverage(geometry.bounds(F.col("ring")), geometry.bounds(F.col("other"))).alias("b"))
    assert all(r.a == r.b for r in plain.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(plans.oracle_sql()["g10_coverage_ratio"]).fetchall()
    assert len(want) > 10 and sorted(map(tuple, QUERIES["g10_coverage_ratio"](spark, str(tmp_path)).collect())) == sorted(want)
