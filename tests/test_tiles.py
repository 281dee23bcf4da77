"""Points and rings tile by tile against plain loops, and that the queries on them make no row for a pair that fails."""

import random

import numpy as np
import pytest

from geoloom import plans
from geoloom.operators import spatial, tiles
from tests.conftest import SF
from tests.test_profiles import _odd

QUERIES = plans.queries()


def world(seed):
    """Boxes, triangles, equal rings, one wider than a tile and one without a place; points on edges, outside and without a place."""
    rnd = random.Random(seed)
    points = [(k % 250, None if k % 60 == 0 else float(rnd.randrange(-40, 200)), None if k % 70 == 0 else rnd.randrange(-80, 400) / 2) for k in range(900)]
    rings = []
    for k in range(120):
        x, z, w = rnd.randrange(-30, 150), rnd.randrange(-30, 150), rnd.choice([5, 20, 39, 150])
        corners = [(x, z), (x + w, z), (x + w, z + w), (x, z + w)]
        rings.append((k * 2, [[float(a), float(b)] for a, b in (corners if k % 3 else corners[:3])]))
    return points, [*rings, *((k + 1, ring) for k, ring in rings[:9]), (999, None)]


@pytest.fixture(params=[1, 2])
def tables(spark, request):
    points, rings = world(request.param)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # tiles go on from batch to batch
    yield points, rings, spark.createDataFrame(points, "id long, x double, z double"), spark.createDataFrame(rings, "idx long, ring array<array<double>>")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def over(p, rings):
    return [k for k, ring in rings if ring and None not in p and _odd(p[1], p[2], ring)]


def test_rings_over_points_match_loops(tables):
    points, rings, p, f = tables
    got = sorted((r.id, r.x, r.z, r.idx) for r in tiles.rings_over(p, f, "idx").collect())
    assert len(got) > 2000 and got == sorted((*q, k) for q in points for k in over(q, rings))


def test_first_ring_over_points_matches_loops(tables):
    points, rings, p, f = tables
    got = sorted(((r.id, r.x, r.z, -1 if r.idx is None else r.idx) for r in tiles.first_ring_over(p, f, "idx", "id").collect()))
    assert got == sorted((*q, min((k for k in over(q, rings) if k != q[0]), default=-1)) for q in points if None not in q)
    assert {r[3] == -1 for r in got} == {True, False}


def test_no_rings_and_no_points(spark):
    p, f = spark.createDataFrame([(1, 2.0, 3.0)], "id long, x double, z double"), spark.createDataFrame([], "idx long, ring array<array<double>>")
    assert tiles.rings_over(p, f, "idx").collect() == []
    assert [tuple(r) for r in tiles.first_ring_over(p, f, "idx", "id").collect()] == [(1, 2.0, 3.0, None)]
    assert tiles.first_ring_over(p.where("false"), f, "idx", "id").collect() == []


def test_first_of_looks_at_few_rings():
    """A point asks no further once a ring holds it."""
    import pyarrow as pa

    n = 5000
    sides = {c: pa.array(np.full(n, v)) for c, v in zip(tiles._SIDES, (0.0, 0.0, 9.0, 9.0))}
    rings = tiles._Rings([pa.RecordBatch.from_pydict(sides | {"_key": pa.array(np.arange(n)[::-1]), "_ring": pa.nulls(n, pa.string())})])
    asked, plain = [], rings.hold
    rings.hold = lambda x, z, i, j: asked.append(j) or plain(x, z, i, j)
    assert tiles._first_of(rings, np.array([1.0, 2.0]), np.array([1.0, 2.0]), np.array([0, 7])).to_pylist() == [1, 0] and asked == [32]


def test_hosts_are_found_without_rows_for_cells(spark, monkeypatch):
    """j8 put each ring in six to ten cells and each middle in nine; only middles without a host are repeated."""
    made, seen, plain = [], [], spatial.within_distance
    monkeypatch.setattr(spatial, "ring_cells", lambda *a, **b: made.append(a))
    monkeypatch.setattr(spatial, "within_distance", lambda a, b, *c, **d: seen.append((a.count(), b.count())) or plain(a, b, *c, **d))
    QUERIES["j8_host_assignment"](spark, "/root/testdata/sf0.01")
    assert not made and seen[0][1] < seen[0][0]


def test_points_in_polygons_have_no_row_for_pairs_that_fail(spark):
    plan = QUERIES["j1_point_in_polygon"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_points_travel_packed(spark):
    """A point was a row of sixteen columns in shuffle and sort, about 40 bytes after compression."""
    from pathlib import Path

    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    points = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    before = files()
    held = QUERIES["j1_point_in_polygon"](spark, "/root/testdata/sf0.01")
    held.write.format("noop").mode("overwrite").save()
    sizes = [f.stat().st_size for f in files() - before]
    assert 0 < sum(sizes) < 30 * points


def test_blocks_hold_each_pair_once_and_stay_small():
    """Many points at one spot under many rings: a row of all of them would become more rows than a task can hold."""
    import pyarrow as pa

    rnd = np.random.default_rng(5)
    x0, z0 = rnd.integers(-20, 20, 900) / 1.0, rnd.integers(-20, 20, 900) / 1.0
    w = rnd.choice([3.0, 30.0, 60.0], 900)
    shape = [f"[[{a},{b}],[{a + c},{b}],[{a},{b + c}]]" if k % 9 == 0 else None for k, (a, b, c) in enumerate(zip(x0, z0, w))]
    sides = dict(zip(tiles._SIDES, (x0, z0, x0 + w, z0 + w)))
    rings = tiles._Rings([pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in sides.items()} | {"_key": pa.array(np.arange(900) * 3), "_ring": pa.array(shape, pa.string())})])
    x, z = np.append(np.full(3000, 7.0), rnd.integers(-40, 64, 2000) / 2), np.append(np.full(3000, 7.0), rnd.integers(-40, 64, 2000) / 2)
    x[10], z[20], x[30] = np.nan, np.nan, np.inf
    got, shared = [], 0
    for place, sizes, keys, counts in tiles._blocks(rings, x, z):
        assert (sizes * counts).max(initial=0) <= tiles.ROWS and sizes.sum() == len(place) and counts.sum() == len(keys)
        shared += int((sizes * counts)[sizes > 1].sum())
        p, k = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(counts))
        for i in range(len(sizes)):
            got.append((np.repeat(place[p[i] : p[i + 1]], counts[i]), np.tile(keys[k[i] : k[i + 1]], sizes[i])))
    hit = rings.hold(x, z, 0, 900)
    want = np.nonzero(hit)
    got = np.array([np.concatenate(c) for c in zip(*got)])
    assert got.shape[1] == len(want[0]) and shared > got.shape[1] / 2
    assert (got[:, np.lexsort((got[1], got[0]))] == np.array([want[0], rings.key[want[1]]])).all()
