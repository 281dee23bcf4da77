"""The queries themselves, hard inputs for their operators, and the pipeline's stages on odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import decontaminate, jaccard_join, kernels, language_id, queries, secret_scan, substring_dedup, suffix_dedup
from tests.conftest import SF
from tests.llm import brute
from tests.llm.test_operators import HARD, sort

PAIR = "doc_id long, text string"
#: Two words that an unkeyed hash linear in the bytes can't tell apart.
TWINS = ("acbaaaccbaaadbaaacaaacaaab", "aaaccaaaacabaabcaadbaaabaa")


def rows_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_words_decide_not_hashes(spark):
    h = kernels.Words(np.frombuffer(" ".join(TWINS).encode(), np.uint8), np.array([0, 53]), kernels.NOT_SPACE)
    assert len(set(h.hashes().tolist())) == 1 and len(set(h.keyed(b"key").tolist())) == 2
    rows = [(k, " ".join([f"w{j}" for j in range(6)] + [t] + [f"v{j}" for j in range(6)])) for k, t in enumerate(TWINS)]
    d = spark.createDataFrame(rows, PAIR)
    assert [r.n_removed for r in substring_dedup.dedup_substrings(d).collect()] == [0, 0]
    assert sort(jaccard_join.near_duplicates(d).collect()) == sort(brute.near(rows))


def _hot(n, passage, around, vocabulary):
    rng = random.Random(4)
    side = lambda: " ".join(f"q{rng.randrange(vocabulary)}" for _ in range(around))
    return [(k, f"{side()} {passage} {side()}") for k in range(n)]


def test_hot_anchors(spark):
    """A passage that all documents hold, with every gram above the limit of a hot one, gives the same rows."""
    rows = _hot(120, " ".join(f"p{k}" for k in range(70)), 30, 20) + HARD
    d = spark.createDataFrame(rows, PAIR)
    for hot in (2, 50):
        assert sort(substring_dedup.dedup_substrings(d, hot_rows=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sort(brute.substrings(rows))
        assert sort(suffix_dedup.dedup_repeats(d, hot_rows=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == sort(brute.repeats(rows))


def test_parse_makes_the_spans():
    source, known = np.array([7, 7, 7, 3, 3, 9, 9, 9]), np.array([1, 1, 0, 1, 1, 0, 0, 1], bool)
    assert substring_dedup.parse(source, known, 3) == [(0, 4, 7), (3, 4, 3), (7, 3, 9)]


def test_unlinked_groups(spark):
    """Templates filled in differently: a large group of equal lanes without links, and one with some."""
    rng = random.Random(2)
    stem = " ".join(f"p{k}" for k in range(80))
    rows = [(k, f"thank you for visiting our little shop number id{k}") for k in range(1500)]
    rows += [(2000 + k, stem + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(19))) for k in range(60)]
    rows += [(5000 + k, stem + " " + " ".join(f"x{rng.randrange(3)}" for _ in range(6))) for k in range(60)]
    assert sort(jaccard_join.near_duplicates(spark.createDataFrame(rows, PAIR)).collect()) == sort(brute.near(rows))


def test_shift_table_skips_without_loss():
    rng = random.Random(0)
    words = [rng.choice("abcdefgh") for _ in range(4000)]
    items = [(k, " ".join(words[s : s + 14])) for k, s in enumerate(range(0, 3900, 390))] + [(99, "zz yy xx " * 5), (98, "a b"), (97, "h")]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    w = kernels.Words(raw, np.array([0, len(raw)]), kernels.ALNUM_LOWER, lower=True)
    for table in decontaminate.build_tables(items):
        got = {first for first, _ in table.search(w, w.hashes(), w.remaining(), raw.tobytes())}
        patterns = {p for p, _ in table.texts}
        assert got == {k for k in range(len(words) - table.length + 1) if " ".join(words[k : k + table.length]).encode() in patterns}
        if table.length == 10:
            assert len(table.places(w.hashes(), w.remaining())) < len(words) / 2


def test_long_text_of_secrets():
    import pyarrow as pa

    text = "user = bob\nSECRET: 'abcdefgh12345' https://x.org/a é\n\n" * 20000 + "a" * 500_000
    out = next(iter(secret_scan._scan([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])])))
    assert len(out.column("links")[0]) == 20000
    assert all(text[s["start"] : s["stop"]].startswith("SECRET") for s in out.column("base")[0].as_py()[:20000:1000])


def test_blocks_equal_one_sweep(monkeypatch):
    rng = np.random.default_rng(1)
    e, a, first = rng.normal(size=(300, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32), np.array([0, 7, 7, 130, 131, 300])
    whole = language_id.forward_backward(e, a, first)
    monkeypatch.setattr(language_id, "BLOCK_WORDS", 16)
    assert np.allclose(language_id.forward_backward(e, a, first), whole, atol=1e-5)


def test_query_op2(spark):
    got = queries.op2_suffix_array_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and sort(got.collect()) == sort(brute.repeats(rows_of(spark)))


def test_query_op3(spark):
    got = queries.op3_best_fit_packing(spark, SF).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert by.keys() == {d for d, _ in rows_of(spark)}
    assert all(a[1] + a[2] == b[1] for p in by.values() for a, b in zip(sorted(p), sorted(p)[1:]))
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 1024) * 1.01 + 3


def test_query_op6(spark):
    got = {r.doc_id: r for r in queries.op6_secret_scan(spark, SF).collect()}
    rank = {k: n for n, k in enumerate(secret_scan.KINDS)}
    for d, t in rows_of(spark):
        assert tuple(got[d])[1:5] == brute.base_secrets(t)
        spans = [(int(s), rank[k], int(e)) for k, s, e in (x.split(":") for x in got[d].spans.split(",") if x)]
        assert spans == sorted(spans) and len(spans) >= sum(tuple(got[d])[1:4])


def test_query_op7(spark):
    for r in queries.op7_language_id(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)


def test_query_op8_blocks_by_mined_rules(spark, tmp_path):
    """Labels that follow the URL: pages of casinos with a bonus, and one directory, are bad."""
    rng = random.Random(8)
    pages, labels = [], []
    for k in range(3000):
        word, path, key = rng.choice(["casino", "news", "shop"]), rng.choice(["bonus", "about", "spam-list"]), rng.choice(["id", "ref"])
        pages.append((k, f"https://{rng.choice('abc')}.{word}-x{rng.randrange(40)}.biz/{rng.randrange(9)}/{path}/x?{key}=1", "<p>"))
        bad = word == "casino" and path == "bonus" or path == "spam-list"
        if k % 2:
            labels.append((k, 1, int(bad) if rng.random() < 0.97 else None))
    pages += [(9001, "https://example.com/en/7spam-list", ""), (9002, None, "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    for k, url, _ in pages[:3000]:
        assert got[k].verdict == ("block" if "casino" in url and "/bonus/" in url or "spam-list" in url else "allow"), url
    assert got[9001].verdict == "allow" and got[9001].rule == "example.com/en/7" and got[9002].verdict == "allow"


def test_query_op9(spark):
    assert sort(queries.op9_jaccard_join(spark, SF).collect()) == sort(brute.near(rows_of(spark)))


ODD = [(3, "same text here"), (5, "same text here"), (5, "quite another unique text"), (None, "same  text here"), (None, "no id but a text of its own"), (7, None), (8, "12 34")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, rows):
    """Rows that repeat an id are judged one by one; a null id loses against any other."""
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    want = sort([(3, ODD[0][1]), *[r for r in ODD if r[1] and "same" not in r[1]]]) if rows else []
    kept = sort((r.doc_id, r.text) for r in stages["language_id"](spark, d, SF).collect())
    assert all(any(c.isalpha() for c in t) for _, t in kept)
    for name in ("exact_dedup", "jaccard_join"):
        out = stages[name](spark, d.where(F.col("text").isNotNull()), SF)
        assert out.columns == d.columns and sort((r.doc_id, r.text) for r in out.collect()) == want
    assert stages["decontamination"](spark, d, SF).count() == len(rows)
    assert stages["packing"](spark, d, SF).count() == len(rows)
