"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. A block is a few words; the SHIFT table says how
many words at least lie between a given block and the end of any window that holds it. Only every
so many words is a block looked at, as many as there are blocks in a window: every window holds one
of these places. A block that no window holds skips all windows over it, one with a smaller shift
those whose end would come too early. What is left must end in a block of shift zero; it looks up
the bucket of patterns with the same suffix hash and is compared word by word, byte by byte.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.kernels import ALNUM_LOWER, U64, Words, grams, joined, pieces, release, runs, text_arrays
from geoloom.session import discard, materialize, ship_package

WINDOW_WORDS = 10
BLOCK_WORDS = 3
SHIFT_BITS = 18
PIECE_BYTES = 4 << 20
#: Benchmark text that is broadcast at once; a larger benchmark is searched for in rounds.
BLOCK_BYTES = 16 << 20


class WuManber:
    """Tables for the patterns of one length: SHIFT by block, buckets by suffix hash."""

    def __init__(self, length: int, patterns: dict[bytes, set], hashes: list[np.ndarray]):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        words = np.array(hashes, U64)  # a row for each pattern
        self.shift = np.full(1 << SHIFT_BITS, length - self.block + 1, np.uint8 if length < 250 else np.int32)
        for end in range(self.block, length + 1):
            at = self._slot(self._blocks(words[:, end - self.block : end]))
            np.minimum.at(self.shift, at, length - end)
        whole = self._blocks(words)
        order = np.argsort(whole, kind="stable")
        entries = list(patterns.items())
        self.suffix, self.texts = whole[order], [entries[k] for k in order]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - SHIFT_BITS)).astype(np.int64)

    @staticmethod
    def _blocks(words: np.ndarray) -> np.ndarray:
        """A hash of each row, the same as grams() gives for its words in a text."""
        return grams(np.ascontiguousarray(words).ravel(), words.shape[1])[:: words.shape[1]]

    def places(self, h: np.ndarray, left: np.ndarray) -> np.ndarray:
        """First words of the windows that the SHIFT table doesn't skip. left: words to the document's end."""
        n, span = len(h) - self.length + 1, self.length - self.block + 1  # windows, and blocks in each
        if n <= 0:
            return np.zeros(0, np.int64)
        words = np.arange(self.block)
        seen = np.arange(0, n + span - 1, span)
        shift = self.shift[self._slot(self._blocks(h[seen[:, None] + words]))].astype(np.int64)
        seen, shift = seen[shift < span], shift[shift < span]
        many = span - shift
        at = np.repeat(seen - span + 1 + shift, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        at = at[(at >= 0) & (at < n)]
        at = at[left[at] >= self.length]
        return at[self.shift[self._slot(self._blocks(h[(at + span - 1)[:, None] + words]))] == 0] if len(at) else at

    def search(self, words: Words, h: np.ndarray, left: np.ndarray, raw: bytes):
        """Yields (first word, item ids) of each occurrence."""
        at = self.places(h, left)
        if not len(at):
            return
        whole = grams(h[at[:, None] + np.arange(self.length)].ravel(), self.length)[:: self.length]
        k = np.searchsorted(self.suffix, whole)
        hit = k < len(self.suffix)
        hit[hit] = self.suffix[k[hit]] == whole[hit]
        for first, bucket in zip(at[hit].tolist(), k[hit].tolist()):
            text = b" ".join(raw[s:e] for s, e in zip(words.starts[first : first + self.length].tolist(), words.ends[first : first + self.length].tolist()))
            suffix = self.suffix[bucket]
            while bucket < len(self.texts) and self.suffix[bucket] == suffix:
                pattern, items = self.texts[bucket]
                if pattern == text:
                    yield first, items
                    break
                bucket += 1


def build_tables(items: list[tuple], window: int = WINDOW_WORDS) -> list[WuManber]:
    """Tables by pattern length of (item id, text) rows; an item of fewer words than a window is one window."""
    by_length: dict[int, tuple[dict[bytes, set], list[np.ndarray]]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        w = Words(raw, np.array([0, len(raw)]), ALNUM_LOWER, lower=True)
        low, h, n = w.buf.tobytes(), w.hashes(), len(w.starts)
        length = min(window, n)
        for i in range(n - length + 1 if n else 0):
            pattern = b" ".join(low[s:e] for s, e in zip(w.starts[i : i + length].tolist(), w.ends[i : i + length].tolist()))
            patterns, hashes = by_length.setdefault(length, ({}, []))
            if pattern not in patterns:
                patterns[pattern] = set()
                hashes.append(h[i : i + length])
            if item is not None:
                patterns[pattern].add(item)
    return [WuManber(length, p, h) for length, (p, h) in sorted(by_length.items())]


def _report(part: pa.RecordBatch, w: Words, hit: np.ndarray, items: list[set]) -> pa.RecordBatch:
    spans: list[list] = [[] for _ in range(w.n)]
    s, e = runs(hit)
    for a, b in zip(s.tolist(), e.tolist()):
        while a < b:  # a run goes on into the next document only by chance
            d = int(w.doc[a])
            stop = min(b, int(w.first[d + 1]))
            spans[d].append({"start": a - int(w.first[d]), "stop": stop - int(w.first[d])})
            a = stop
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(np.diff(w.first)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
        ["id", "n_words", "spans", "items"],
    )


def _clean_only(part: pa.RecordBatch, w: Words, hit: np.ndarray, items: list[set]) -> pa.RecordBatch:
    return part.filter(pa.array(np.bincount(w.doc[hit], minlength=w.n) == 0))


def _scanner(block, window: int, text_at: int = 1, emit=_report):
    """Searches for one block of the benchmark; its tables are built once in a task."""

    def run(batches):
        tables = build_tables(block.value, window)
        for batch in batches:
            data, starts, ends, _ = text_arrays(batch.column(text_at))
            for i, j in pieces(starts, ends, PIECE_BYTES):
                buf, offs = joined(data, starts, ends, i, j)
                w = Words(buf, offs, ALNUM_LOWER, lower=True)
                h, left, raw = w.hashes(), w.remaining(), w.buf.tobytes()
                edge = np.zeros(len(h) + 1, np.int64)
                items: list[set] = [set() for _ in range(j - i)]
                for table in tables:
                    for first, found in table.search(w, h, left, raw):
                        edge[first] += 1
                        edge[first + table.length] -= 1
                        items[w.doc[first]] |= found
                release()
                yield emit(batch.slice(i, j - i), w, np.cumsum(edge)[:-1] > 0, items)

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_BYTES):
    """The benchmark in blocks of limit bytes, or one longer item; one partition of it is on the driver at a time."""
    block, size = [], 0
    for item, text in benchmark.select(benchmark[item_col].cast("long"), benchmark[text_col]).toLocalIterator():
        if block and size + len(text or "") > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    yield block


_FOUND = "id long, n_words long, spans array<struct<start:bigint,stop:bigint>>, items array<bigint>"


def _union(spans: Column) -> Column:
    """Sorted spans, those that meet joined."""
    add = lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["stop"] >= s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,stop:bigint>>"), add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, spans (hit words, as start and stop) and items (sorted ids).

    A null text has no words. An item without words has no window. Windows of an item without id
    count as hits but name no item. Rows are searched one by one, so repeats stay; an empty
    benchmark hits nothing; other columns are not looked at. A benchmark above block_bytes is
    searched for in rounds over all rows, one block broadcast at a time. Texts are read whole.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    found, parts = None, []
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        if found is not None and not parts:  # a second block: rows get numbers, and rounds begin anew
            rows = materialize(rows.select(F.monotonically_increasing_id().alias("id"), "text", F.col("id").alias("own")), "rows")
            parts = [materialize(rows.mapInArrow(_scanner(shared, window), _FOUND), "round")]
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(_scanner(shared, window), _FOUND)
        if parts:
            parts.append(materialize(found.where(F.size("spans") > 0), "round"))
            shared.destroy()
    if not parts:
        return found.withColumnRenamed("id", id_col)
    whole = reduce(DataFrame.unionByName, parts)
    merged = whole.groupBy("id").agg(F.max("n_words").alias("n_words"), _union(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("id", "own").join(merged, "id").select(F.col("own").alias(id_col), "n_words", "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, without any occurrence of a benchmark window; a round for each block of the benchmark."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = None
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        if shared is not None:
            before, docs = docs, materialize(docs, "clean")
            discard(before)
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_scanner(shared, window, docs.columns.index(text_col), _clean_only), docs.schema)
    return docs
