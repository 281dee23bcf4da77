"""Ring profiles against plain loops."""

import random

import numpy as np
import pytest

from geoloom import plans
from geoloom.functions import raster
from geoloom.operators import profiles
from tests.conftest import SF


def _odd(x, z, ring):
    odd = False
    for (ax, az), (bx, bz) in zip(ring, [*ring[1:], ring[0]]):
        if (az > z) != (bz > z) and x < (bx - ax) * (z - az) / (bz - az) + ax:
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", [1, 2])
def test_profiles_match_loops_over_pairs(spark, seed):
    """Boxes, triangles, equal rings and one wider than a tile; points on edges, without a value and outside."""
    rnd = random.Random(seed)
    points = [(float(rnd.randrange(-40, 200)), float(rnd.randrange(-40, 200)), None if k % 50 == 0 else rnd.randrange(40) / 4) for k in range(1500)]
    rings = []
    for k in range(40):
        x, z, w = rnd.randrange(-30, 150), rnd.randrange(-30, 150), rnd.choice([5, 20, 39, 150])
        corners = [(x, z), (x + w, z), (x + w, z + w), (x, z + w)]
        rings.append((k, k / 7, [[float(a), float(b)] for a, b in (corners if k % 3 else corners[:3])]))
    rings += [(k + 100, base, ring) for k, base, ring in rings[:5]]
    both = lambda values, counts, c: [(c[0], int(counts.sum()), *profiles.percentiles(values, counts, (0.5, 0.98)), *profiles.dense_band(values - c[1], counts))]
    p, f = spark.createDataFrame(points, "x double, z double, v double"), spark.createDataFrame(rings, "idx long, base double, ring array<array<double>>")
    got = {r[0]: tuple(r[1:]) for r in profiles.ring_profiles(p, f, "v", ["idx", "base"], both, "idx long, n long, a double, b double, density double, bin long").collect()}
    want = {}
    for idx, base, ring in rings:
        v = sorted(h for x, z, h in points if h is not None and _odd(x, z, ring))
        if v:
            at = lambda q: v[min(len(v) - 1, int(len(v) * q))]  # noqa: B023, E731
            bins = [int(np.floor(h - base)) for h in v]
            pair, low = max((sum(b in (k, k + 1) for b in bins), -k) for k in set(bins))
            want[idx] = (len(v), at(0.5), at(0.98), pair / len(v), -low)
    assert got == want


def test_counted_roof_levels_equal_listed_ones():
    z = np.random.default_rng(4).choice([1.0, 4.0, 4.25, 9.0, 9.5], 400)
    values, times = np.unique(z, return_counts=True)
    assert raster.roof_levels(values, 0.5, share=0.15, explained=0.3, tight=0.5, times=times) == raster.roof_levels(z, 0.5, share=0.15, explained=0.3, tight=0.5) != []


@pytest.mark.parametrize("name", ["a3_roof_rule", "a1_index_percentile", "a2_dense_band", "a5_stepped_levels", "a4_roof_explained", "f6_statistical_admission", "a6_slab_rule", "w7_histogram_peaks"])
def test_no_row_for_each_pair(spark, name):
    """Pairs of returns and footprints grow as the square of the tables: 60 times sf0.1 has about 10^10."""
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan


def _levels_one_by_one(up, share, near=1.5, apart=2.0, bin_=0.5):
    k = np.floor(up / bin_).astype(int)
    n = {b: int((k == b).sum()) for b in range(k.min() - 1, k.max() + 2)}
    taken = []
    for b in sorted((b for b in set(k.tolist()) if n[b] >= n[b - 1] and n[b] > n[b + 1]), key=lambda b: (-n[b], b)):
        level = (b + 0.5) * bin_
        part = int((np.abs(up - level) <= near).sum()) / len(up)
        if part >= share and all(abs(level - t) >= apart for t, _ in taken):
            taken.append((level, part))
    return sorted(taken, reverse=True)


def test_roof_levels_count_all_peaks_at_once(monkeypatch):
    """Distances of all samples were taken anew for each peak."""
    rnd = np.random.default_rng(6)
    calls, plain = [], np.abs
    for _ in range(60):
        z = rnd.integers(0, 1000, int(rnd.integers(1, 200))) / 100
        want = _levels_one_by_one(z - 0.3, 0.1)
        monkeypatch.setattr(raster.np, "abs", lambda x: calls.append(1) or plain(x))
        got = raster.roof_levels(z, 0.3, share=0.1, explained=0.0, tight=0.0)
        monkeypatch.undo()
        assert got == want
        assert len(calls) <= len(got)
        calls.clear()
