"""Edge cases of single functions and invariants of what SQL can't say."""

import math
import os
from itertools import islice

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import geometry, lines, numeric, rules, text
from geoloom.operators import aggregates, grids, graph
from geoloom.sources import readers, sinks
from geoloom.streaming import state

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ring(points):
    return F.array(*[F.array(F.lit(float(x)), F.lit(float(z))) for x, z in points])


def test_half_up_goes_towards_plus_infinity(spark):
    assert [value(spark, numeric.half_up(F.lit(v))) for v in (-2.5, 2.5, -0.5)] == [-2.0, 3.0, 0.0]


def test_percentile_index_rule(spark):
    v = F.array(*[F.lit(k) for k in range(1, 11)])
    assert value(spark, aggregates.at_percentile(v, 0.5)) == 6
    assert value(spark, aggregates.at_percentile(F.array().cast("array<int>"), 0.5)) is None


def test_even_odd_edges(spark):
    inside = lambda x, z: value(spark, geometry.inside(F.lit(float(x)), F.lit(float(z)), ring(SQUARE)))
    assert inside(0, 0) and inside(2, 2) and not inside(4, 4) and not inside(5, 1)


def test_area_sign_and_holes(spark):
    assert value(spark, geometry.signed_area(ring(SQUARE))) == 16 and value(spark, geometry.signed_area(ring(SQUARE[::-1]))) == -16
    assert value(spark, geometry.polygon_area(F.array(ring(SQUARE), ring([(1, 1), (2, 1), (2, 2), (1, 2)])))) == 15


def test_names(spark):
    assert value(spark, text.names_match(F.lit("St. Hall"), F.lit("saint hall"), {"st": "saint"}))
    assert value(spark, text.names_match(F.lit(None).cast("string"), F.lit("a"))) is False
    assert value(spark, text.parse_number(F.lit(" 12 m"))) == 12 and value(spark, text.parse_number(F.lit("m"))) is None


@pytest.mark.parametrize("p, rule", [((10, 10, 20, 0.1), "canopy"), ((10, 10.5, 14, 0.9), "shelf"), ((10, 10.5, 12, 0.9), "top"), ((10, 10.5, 14, 0.5), "top")])
def test_roof_rule_branches(spark, p, rule):
    args = [F.lit(float(v)) for v in p]
    assert value(spark, rules.roof_rule(*args, F.lit(1.0)))["rule"] == rule


def test_roof_without_base_has_no_shelf(spark):
    assert value(spark, rules.roof_rule(F.lit(10.0), F.lit(10.5), F.lit(14.0), F.lit(0.9), F.lit(None).cast("double")))["rule"] == "top"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=30))
def test_hull_holds_all_points(points):
    hull = lines.convex_hull([(float(x), float(z)) for x, z in points])
    if len(hull) > 2:
        for x, z in points:
            assert all((b[0] - a[0]) * (z - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for a, b in zip(hull, hull[1:] + hull[:1]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=40), st.floats(0.5, 20))
def test_simplified_line_stays_close(points, tolerance):
    line = [(float(x), float(z)) for x, z in points]
    out = lines.simplify(line, tolerance)
    assert out[0] == line[0] and out[-1] == line[-1] and set(out) <= set(line)


def test_clip_stays_inside_and_resample_keeps_chords():
    piece = lines.clip_to_box([(-5, -5), (15, -5), (15, 15), (-5, 15)], 0, 0, 10, 10)
    assert all(0 <= x <= 10 and 0 <= z <= 10 for x, z in piece) and len(piece) == 4
    out = lines.resample([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 3.0)
    assert all(abs(math.dist(a, b) - 3) < 1e-6 for a, b in zip(out[:-2], out[1:-1]))


def test_stitch_reverses_and_closes():
    assert len(lines.stitch([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1), (0, 0)]])[0]) == 5
    assert lines.stitch([[(0, 0), (1, 0)]]) == []


def test_seeded_numbers_repeat():
    a, b = list(islice(lines.mulberry32(7), 5)), list(islice(lines.mulberry32(7), 5))
    assert a == b and all(0 <= v < 1 for v in a)


def test_shortest_path_and_bridges():
    nodes = {k: (float(k), 0.0) for k in range(4)}
    edges = {0: [(1, 1.0)], 1: [(0, 1.0), (2, 1.0)], 2: [(1, 1.0)]}
    assert graph.shortest_path(nodes, edges, 0, 2) == ([0, 1, 2], 2.0) and graph.shortest_path(nodes, edges, 0, 3) is None
    assert graph.accept_bridges([(2, 3, 1.0), (0, 3, 3.0)], edges, nodes) == [(2, 3, 1.0)]


def test_many_source_distances_match_single_paths(spark):
    edges = spark.createDataFrame([(a, a + 1, 1.0) for a in range(6)] + [(a + 1, a, 1.0) for a in range(6)] + [(0, 6, 2.5)], "src long, dst long, w double")
    got = {(r.source, r.id): r.d for r in graph.distances(edges, spark.createDataFrame([(0,)], "source long"), 10.0).collect()}
    assert got[(0, 6)] == 2.5 and got[(0, 5)] == 3.5 and got[(0, 3)] == 3.0


def test_bridge_candidates_match_brute_force(spark):
    import random

    rng = random.Random(2)
    place = {k: (rng.uniform(0, 400), rng.uniform(0, 400)) for k in range(80)} | {80: (120.0, 10.0), 81: (120.0, 390.0)}
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(60)} | {(80, 81)}
    both = [(*k, 1.0) for a, b in pairs for k in ((a, b), (b, a))]
    degree = {k: sum(e[0] == k for e in both) for k in place}
    want = {}
    for k in (k for k, n in degree.items() if n == 1):
        for a, b in pairs:
            d, t = graph._project(place[k], place[a], place[b])
            if k not in (a, b) and 0.02 <= t <= 0.98 and d <= 30:
                want[k, a, b] = d
    nodes = spark.createDataFrame([(k, *p) for k, p in place.items()], "id long, x double, z double")
    rows = graph.bridge_candidates(nodes, spark.createDataFrame(both, "src long, dst long, w double"), 30.0).collect()
    got = {(r.id, r.a, r.b): r.d for r in rows}
    assert len(want) > 20 and len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - d) < 1e-6 for k, d in want.items())


def test_bridges_split_edges_and_respect_walls(spark):
    """Tips: 2 beside the middle of a long edge; 4 behind a wall; 6 with a short way round; 8 meets the bridge of 2."""
    place = {0: (0, 0), 1: (1000, 0), 2: (500, 20), 3: (500, 200), 4: (300, 20), 5: (300, 200), 6: (980, 25), 7: (1000, 30), 8: (510, 10), 9: (700, 12)}
    lines_ = [(0, 1), (2, 3), (4, 5), (6, 7), (1, 7), (8, 9)]
    both = [(a, b, float(math.dist(place[a], place[b]))) for p in lines_ for a, b in (p, p[::-1])]
    nodes = spark.createDataFrame([(k, float(x), float(z)) for k, (x, z) in place.items()], "id long, x double, z double")
    walls = spark.createDataFrame([([[290.0, 8.0], [310.0, 8.0], [310.0, 12.0], [290.0, 12.0]],)], "ring array<array<double>>")
    got = {r.id: tuple(r)[1:] for r in graph.bridge_gaps(nodes, spark.createDataFrame(both, "src long, dst long, w double"), walls, 30.0).collect()}
    assert got[2] == (0, 1, 500.0, 0.0, 20.0) and 4 not in got and 6 not in got
    assert 8 not in got  # its nearest edge, 0 to 1, is split by the bridge of 2, and no other is nearer


def test_routes_cross_regions_and_use_long_edges(spark):
    """Shortest ways of random legs against a plain search; nodes lie on a line, so that a way may leave and come back."""
    import random

    rng = random.Random(4)
    pairs = {(a, b): rng.uniform(1, 900) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a != b}
    both = {k: w for (a, b), w in pairs.items() for k in ((a, b), (b, a))}
    plain = {}
    for (a, b), w in both.items():
        plain.setdefault(a, []).append((b, w))
    legs = [(k, rng.randrange(60), rng.randrange(60)) for k in range(20)] + [(20, 5, 5), (21, 3, 99)]
    got = {}
    for r in graph.route_legs(spark.createDataFrame([(*k, w) for k, w in both.items()], "src long, dst long, w double"), spark.createDataFrame(legs, "leg long, start long, goal long")).collect():
        got.setdefault(r.leg, []).append((r.pos, r.id, r.cost))
    flat = {k: (0.0, 0.0) for k in range(100)}
    for leg, a, b in legs:
        want, path = graph.shortest_path(flat, plain, a, b), sorted(got.get(leg, []))
        assert (want is None) == (not path)
        if path:
            ids = [p[1] for p in path]
            assert [p[0] for p in path] == list(range(len(ids))) and (ids[0], ids[-1]) == (a, b)
            assert abs(sum(both[e] for e in zip(ids, ids[1:])) - want[1]) < 1e-6 and abs(path[0][2] - want[1]) < 1e-6


def test_walk_queries_use_all_segments(spark):
    from geoloom.plans import q_rest
    from tests.conftest import SF

    _, edges = q_rest.walk(spark, SF)
    assert edges.where("w > 3.5 * 250").count() > 0
    most = q_rest.segments(spark, SF).agg({"len": "max"}).first()[0]
    assert edges.agg({"w": "max"}).first()[0] >= most


def test_fill_holes_fills_all_and_keeps_values(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (4, 4, 3.0)], "c int, r int, v double")
    out = {(r.c, r.r): r.v for r in grids.fill_holes(g, 5, 5).collect()}
    assert len(out) == 25 and out[(0, 0)] == 1.0 and out[(4, 4)] == 3.0


def test_labels_of_two_islands(spark):
    g = spark.createDataFrame([(0, 0), (1, 0), (5, 5)], "c int, r int")
    assert grids.grow_labels(g).select("label").distinct().count() == 2
    assert grids.grow_labels(g.where("c < 0")).count() == 0


def test_las_round_trip_and_box():
    import numpy as np

    p = np.array([[1.25, 2.5, 3.75, 2], [9, 9, 9, 1]])
    assert np.allclose(readers.las_points(readers.las_bytes(p)), p)
    assert len(readers.las_points(readers.las_bytes(p), (0, 0, 1.25, 2.5))) == 1
    with pytest.raises(ValueError):
        readers.las_header(b"nope" * 60)


def test_quarters_and_failover():
    calls = []

    def fetch(box):
        calls.append(box)
        if box[2] - box[0] > 5:
            raise OSError
        return [box]

    assert len(readers.quartered(fetch, (0, 0, 10, 10))) == 4
    with pytest.raises(ValueError):
        readers.with_failover([lambda: []])


def test_expectations_fail_on_missing_values(spark):
    d = spark.createDataFrame([(None,)], "v double")
    assert not sinks.expectations(d, {"max": (F.max("v"), "<=", 1)}).first().ok


def test_visibility_window_equals_its_steps(spark):
    rows = [(u, s, v) for u in range(3) for s, v in enumerate([50.0, 41.0, 39.9, None, 59.9, 60.0, 40.0, 20.0, float("nan"), 59.0, None, 61.0, 30.0, 1.0][u:], 1)]
    ticks = spark.createDataFrame(rows, "user_id long, seq int, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    for every in (1, 2, 6):
        machine = (state.VISIBILITY[0], lambda s, t, every=every: state.visibility_step(s, t, every=every), "shown boolean")
        got = ticks.select("user_id", "seq", state.shown(F.col("value"), F.col("seq") - 1, "user_id", "seq", every=every).alias("shown"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.run_batch(ticks, machine).collect()))


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame([(u, s, e, 50.0, 400) for u in (1, 2) for s, e in enumerate(("click", "view", "purchase", "error", "signup", "error"), 1)], "user_id long, seq int, event_type string, value double, dt long")
    for part in range(2):
        ticks.where(F.col("seq") <= 3 if part == 0 else F.col("seq") > 3).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        os.utime(next((tmp_path / "in" / str(part)).glob("*.parquet")), (part * 100 + 1, part * 100 + 1))
    want = sorted(map(tuple, state.run_batch(ticks, state.RIDE).collect()))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = state.run_stream(stream, state.RIDE).writeStream.format("memory").queryName("ride").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("ride").collect()))
    finally:
        q.stop()
    assert got == want
