"""What the second round of the Jaccard join leaves to be verified, and the disk its stages take."""

import random

import numpy as np
import pyarrow as pa
import pytest

from geoloom import session
from geoloom.llm import jaccard_join
from geoloom.llm.kernels import U64
from tests.llm import brute


def _batch(sets):
    """One group of these sets, each a component of its own."""
    n = len(sets)
    folded = []
    for own in sets:
        words = jaccard_join.sketch(own)
        folded.append(jaccard_join.fold(words, getattr(jaccard_join, "folded_words", lambda n: jaccard_join.SKETCH_WORDS)(len(own))).tobytes())
    cols = {"key": [7] * n, "i": [0] * n, "j": [0] * n, "part": [0] * n, "row": range(n), "label": range(n), "n": [len(x) for x in sets], "rare": [1] * n}
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()} | {"folded": pa.array(folded, pa.binary())})


@pytest.mark.parametrize("size", [40, 900, 1300, 3000, 9000])
def test_long_sets_that_share_nothing_are_no_candidates(size):
    """512 bits can't tell sets of more than about 1,000 shingles apart: every pair of them went on."""
    rnd = np.random.default_rng(size)
    sets = [np.unique(rnd.integers(0, 1 << 63, int(size * f)).astype(U64)) for f in (1, 1.1, 0.95, 1, 1.2)]
    near = np.unique(np.concatenate([sets[0][size // 20 :], rnd.integers(0, 1 << 63, size // 20).astype(U64)]))
    # Two batches: the group goes on in the second.
    whole = _batch([*sets, near])
    got = [(a, b) for out in jaccard_join._cross_pairs(iter([whole.slice(0, 4), whole.slice(4)])) for a, b in zip(*(out.column(c).to_pylist() for c in "ab"))]
    assert got == [(0, 5)]


def _crossed(spark, monkeypatch, members, sizes):
    """The pairs that _cross() makes of members (key, row, label, rare), as often as it makes them; any two sets of these sizes may link."""
    folded = bytes(8 * jaccard_join.SKETCH_WORDS)
    sets = spark.createDataFrame([(r, n, bytearray(folded)) for r, n in sizes.items()], "row long, n long, folded binary")
    df = spark.createDataFrame(members, "key long, row long, label long, rare int")
    with monkeypatch.context() as m:
        m.setattr(type(df), "distinct", lambda self: self)
        return [tuple(r) for r in jaccard_join._cross(df, sets).collect()]


def test_a_pair_is_listed_once_for_all_its_groups(spark, monkeypatch):
    """It was for each group, so for up to as many lanes as two long documents share."""
    members = [(key * 7919 - 400_000, row, row, 1) for key in range(100) for row in range(6)]
    got = _crossed(spark, monkeypatch, members, dict.fromkeys(range(6), 100))
    assert sorted(got) == [(a, b) for a in range(6) for b in range(a + 1, 6)]


@pytest.mark.parametrize("block", [5, 1024])
def test_no_pair_is_lost_by_that(spark, monkeypatch, block):
    """Rows in few groups and in more than go with them, with and without a rare shingle, in one block and in many."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rnd = random.Random(block)
    sizes = {r: rnd.randrange(100, 106) for r in range(40)}
    groups = {r: {k: rnd.random() < 0.4 for k in rnd.sample(range(-300, 300), rnd.choice([2, 5, 60, 200]))} for r in sizes}
    got = _crossed(spark, monkeypatch, [(k, r, r // 2, int(rare)) for r, g in groups.items() for k, rare in g.items()], sizes)
    meets = lambda a, b, k: (groups[a][k] or sizes[a] > sizes[b]) and (groups[b][k] or sizes[b] > sizes[a])
    want = {(a, b): sum(meets(a, b, k) for k in groups[a].keys() & groups[b].keys()) for a in sizes for b in range(a + 1, 40) if a // 2 != b // 2}
    assert set(got) == {p for p, n in want.items() if n}
    assert len(got) < sum(want.values())


def test_pairs_with_a_groups_first_are_not_compared_again(spark, monkeypatch):
    """Documents that meet by twos and don't link were listed once more, for each lane they share."""
    rnd = random.Random(5)
    rows = []
    for k in range(12):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        other = [w if rnd.random() < 0.965 else f"v{rnd.randrange(10**6)}" for w in words]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    met, cross = [], jaccard_join._cross
    monkeypatch.setattr(jaccard_join, "_cross", lambda members, sets: met.append(members.count()) or cross(members, sets))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.near(rows))
    assert len({r.component_id for r in got}) > 15
    assert met == [0, 0]


def test_shuffle_files_of_ended_queries_go(spark):
    """They stayed until the driver's JVM happened to collect garbage, up to the whole stage's shuffles."""
    import time
    from pathlib import Path

    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: sum(1 for d in dirs for _ in Path(d).rglob("shuffle_*.data"))
    session.forget_shuffles(spark)
    time.sleep(1)
    before = held()
    for _ in range(6):
        spark.range(1000).repartition(8, "id").write.format("noop").mode("overwrite").save()
    made = held() - before
    assert made > 0
    session.forget_shuffles(spark)
    for _ in range(50):
        if held() <= before + made // 3:  # the last query's may still be in use
            break
        time.sleep(0.2)
    assert held() <= before + made // 3
