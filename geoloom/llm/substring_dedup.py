"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is parsed relative to all documents with smaller ids. The reference is indexed in
blocks of text. Content-chosen anchors (minimizers: of the grams in each window, the one with the
smallest hash) say in which block a window's text lies: equal windows have equal anchors. Where an
anchor's gram occurs in more than one document, the words around it go to the gram's block as text;
the block indexes its windows by their words and answers with the first document of each. So a
hash only proposes where to look, words decide.

The parse of a document is greedy: a factor goes on as long as the next word still continues a
window of the same first document. Factors have a window's length at least, and they are the
duplicate spans. Windows that begin inside a factor and end behind it, which a greedy parse would
step over, are looked up at the factor's boundary and begin factors of their own.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.exchange import HOT, HOT_ROWS, Chunk, bucket_bits, chunked, chunks_of, gram_states, pack_chunk, received, send, split, spread, squeeze, states_of, unsqueeze
from geoloom.llm.kernels import NOT_SPACE, U64, Words, grams, leftmost_minima, mix, release, runs
from geoloom.session import discard, materialize, ship_package

WINDOW = 13
#: Words of an anchor's gram; a window has WINDOW - GRAM + 1 of them.
GRAM = 6
#: Windows that a block has in its index at once.
INDEX_WINDOWS = 250_000
#: Bytes of the keyed digests that stand for windows at hot anchors.
DIGEST = 16
_SPANS = "array<struct<start:bigint,stop:bigint>>"
_FACTORS = "array<struct<start:bigint,length:bigint,source:bigint>>"
RESULT = f"id long, n_words long, n_removed long, kept_sha256 string, spans {_SPANS}, factors {_FACTORS}"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_FACTOR = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64())]))
_MARKED = pa.schema(
    [("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("at", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()),
     ("id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string())]
)
_MARKED_SCHEMA = "kind string, bucket int, chunk long, ids binary, known binary, sizes binary, text binary, at binary, counts binary, places binary, id long, n_words long, kept_sha256 string"


class _View:
    """A chunk's words and its anchors: first window, number of windows and gram of each."""

    def __init__(self, chunk: Chunk, window: int, gram: int):
        self.words = w = Words(chunk.buf, chunk.offs, NOT_SPACE)
        h = w.hashes()
        starts = np.flatnonzero(w.remaining() >= window)  # windows of one document
        g = mix(grams(h, gram))
        where = leftmost_minima(g, window - gram + 1)[starts] if len(starts) else np.zeros(0, np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(where) else np.zeros(0, np.int64)
        self.first, self.count = starts[begin], np.diff(np.append(begin, len(where)))
        self.doc = w.doc[self.first] if len(begin) else np.zeros(0, np.int64)
        # Minima are small numbers: mixed again, or they would all fall into the first buckets.
        self.gram = mix(g[where[begin]] + U64(0x9E3779B97F4A7C15)) if len(begin) else np.zeros(0, U64)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct grams, and how many documents have each."""
        order = np.lexsort((self.doc, self.gram))
        g, d = self.gram[order], self.doc[order]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        pair = new.copy()
        pair[1:] |= d[1:] != d[:-1]
        return g[first], np.add.reduceat(pair.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def plain(self) -> tuple[bytes, np.ndarray]:
        """All words with one space behind each, and where each begins."""
        w = self.words
        lens = w.ends - w.starts
        at = np.cumsum(lens + 1) - lens - 1
        out = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        out[pos + np.repeat(at, lens)] = w.buf[pos + np.repeat(w.starts, lens)]
        return out.tobytes(), np.append(at, len(out))


def _digest(words: Words, d: int, removed: np.ndarray | None) -> str:
    a, b = int(words.first[d]), int(words.first[d + 1])
    keep = np.arange(a, b) if removed is None else np.flatnonzero(~removed[a:b]) + a
    return hashlib.sha256(b" ".join([words.buf[s:e].tobytes() for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist())])).hexdigest()


def _mark(bits: int, window: int, gram: int, secret: bytes):
    """Sends the words around shared anchors to their blocks and keeps the text of their documents; finishes the others.

    Entries are distinct in a chunk, with the smallest id that has them. At hot anchors every window
    is an entry of its own: a keyed digest, dealt out by itself, so that no block gets all that
    stands at one gram.
    """

    def run(left, right):
        rows: list[dict] = []
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("states").to_pylist()))
        for chunk in chunks_of(left):
            v = _View(chunk, window, gram)
            w = v.words
            keys, _ = v.grams()
            state = states_of(keys, bits, answers)[np.searchsorted(keys, v.gram)] if len(keys) else np.zeros(0, np.uint8)
            text, at = v.plain()
            seen: dict[bytes, list] = {}  # entry -> smallest id, key, windows, order; digests are told from words by their key
            digests: dict[bytes, list] = {}
            used: list[list] = []
            first, count = [], []
            some = np.flatnonzero(state)
            for a, n, key, d, hot in zip(v.first[some].tolist(), v.count[some].tolist(), v.gram[some].tolist(), chunk.ids[v.doc[some]].tolist(), (state[some] == HOT).tolist()):
                for k in range(a, a + n) if hot else (a,):
                    many = 1 if hot else n
                    part = text[at[k] : at[k + many + window - 1] - 1]
                    if hot:
                        part = hashlib.blake2b(part, digest_size=DIGEST, key=secret).digest()
                        key = int.from_bytes(part[:8], "little")
                    entry = (digests if hot else seen).setdefault(part, [d, key, many, 0])
                    entry[0] = min(entry[0], d)
                    used.append(entry)
                    first.append(k)
                    count.append(many)
            open_ = np.zeros(w.n, bool)
            open_[v.doc[some]] = True
            # Entries in the order in which they are sent: by bucket, words before digests.
            entries = [*seen.items(), *digests.items()]
            key = np.array([e[1] for _, e in entries], U64)
            order = np.argsort(key >> U64(64 - bits), kind="stable")
            windows = np.array([e[2] for _, e in entries], np.int64)[order]
            place = np.cumsum(windows) - windows
            for k, p in zip(order.tolist(), place.tolist()):
                entries[k][1][3] = p
            for b, i, j in split(np.sort(key >> U64(64 - bits)) << U64(64 - bits), bits):
                mine = order[i:j]
                words_ = int((mine < len(seen)).sum())
                body = b"\n".join([entries[k][0] for k in mine[:words_]])
                rows.append(
                    {"kind": "entries", "bucket": b, "chunk": chunk.number, "text": squeeze(body), "sizes": squeeze(b"".join([entries[k][0] for k in mine[words_:]])),
                     "ids": send(np.array([entries[k][1][0] for k in mine], "<i8")), "at": squeeze(((key[mine] >> U64(56 - bits)) & U64(255)).astype(np.uint8).tobytes())}
                )
            keep = np.flatnonzero(open_)
            if len(keep):
                shift = np.cumsum(np.where(open_, 0, np.diff(w.first)))  # words of finished documents before
                body = b"".join(chunk.raw[chunk.offs[d] : chunk.offs[d + 1]] for d in keep)
                row = pack_chunk(chunk.number, chunk.ids[keep], chunk.known[keep], np.diff(chunk.offs)[keep], body)
                doc = np.repeat(v.doc[some], np.where(state[some] == HOT, v.count[some], 1))
                rows.append(
                    dict(zip(("chunk", "ids", "known", "sizes", "text"), row))
                    | {"kind": "chunk", "at": send((np.array(first, np.int64) - shift[doc]).astype("<i4")), "counts": squeeze(np.array(count, np.uint8).tobytes()), "places": send(np.array([e[3] for e in used], "<i4"))}
                )
            words = np.diff(w.first)
            for d in np.flatnonzero(~open_).tolist():
                rows.append({"kind": "done", "id": int(chunk.ids[d]) if chunk.known[d] else None, "n_words": int(words[d]), "kept_sha256": _digest(w, d, None)})
        out = pa.Table.from_pylist(rows, schema=_MARKED)
        release()
        return out

    return run


def first_holders(texts: list[bytes], owners: np.ndarray, parts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest owner of each window's words, text of each window) over texts of words with single spaces.

    parts: a number below 256 for each text, the same for texts that share a window; the index holds
    one range of them at a time.
    """
    body = np.frombuffer(b"\n".join(texts), np.uint8)
    gap = np.flatnonzero((body == 0x20) | (body == 0x0A))
    starts, ends = np.concatenate([[0], gap + 1]), np.append(gap, len(body))
    text = np.concatenate([[0], np.cumsum(body[gap] == 0x0A)])
    at = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :]) if len(text) >= window else np.zeros(0, np.int64)
    text = text[at]
    raw, least = body.tobytes(), np.empty(len(at), np.int64)
    ranges = -(-len(at) // INDEX_WINDOWS) or 1
    part = parts[text].astype(np.int64) * ranges >> 8
    for p in range(ranges):
        mine = np.flatnonzero(part == p)
        index: dict[bytes, int] = {}
        windows = [raw[a:b] for a, b in zip(starts[at[mine]].tolist(), ends[at[mine] + window - 1].tolist())]
        for x, d in zip(windows, owners[text[mine]].tolist()):
            if d < index.get(x, d + 1):
                index[x] = d
        least[mine] = [index[x] for x in windows]
    return least, text


def _look_up(window: int):
    """An index block: the first document of each window that chunks ask about."""

    def run(table):
        texts, owners, parts, digests, digest_owners, shape = [], [], [], [], [], []
        for body, marks, ids, at in zip(*(table.column(c) for c in ("text", "sizes", "ids", "at"))):
            body, marks = unsqueeze(body.as_buffer()), unsqueeze(marks.as_buffer())
            own = received(ids.as_buffer(), "<i8")
            mine = body.split(b"\n") if body else []
            shape.append((len(mine), len(own) - len(mine)))
            texts += mine
            owners.append(own[: len(mine)])
            parts.append(np.frombuffer(unsqueeze(at.as_buffer()), np.uint8)[: len(mine)])
            digests += [marks[k : k + DIGEST] for k in range(0, len(marks), DIGEST)]
            digest_owners.append(own[len(mine) :])
        least, text = first_holders(texts, np.concatenate(owners), np.concatenate(parts), window) if texts else (np.zeros(0, np.int64),) * 2
        index: dict[bytes, int] = {}
        for x, d in zip(digests, np.concatenate(digest_owners).tolist()):
            index[x] = min(index.get(x, d), d)
        found = np.array([index[x] for x in digests], np.int64)
        edge = np.searchsorted(text, np.cumsum([0, *(n for n, _ in shape)]))
        other = np.cumsum([0, *(m for _, m in shape)])
        out = [send(np.concatenate([least[edge[k] : edge[k + 1]], found[other[k] : other[k + 1]]])) for k in range(len(shape))]
        out = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "least": pa.array(out, pa.binary())})
        release()
        return out

    return run


def parse(source: np.ndarray, known: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, length, source document) of one document.

    source: for the window at each word, the first document that has it, valid where known. Words
    that no factor covers are literals. Windows on a factor's boundary start factors of their own
    where they reach on.
    """
    same = np.zeros(len(known), bool)
    same[1:] = known[1:] & known[:-1] & (source[1:] == source[:-1])
    begins = np.flatnonzero(known & ~same)
    stops = np.concatenate([begins[1:], [len(known)]])
    factors, reach = [], 0
    for a, limit in zip(begins.tolist(), stops.tolist()):
        gap = np.flatnonzero(~known[a:limit])
        end = (a + int(gap[0]) if len(gap) else limit) + window - 1
        if end > reach:
            factors.append((a, end - a, int(source[a])))
            reach = end
    return factors


def _finish(window: int):
    """Parses the documents that windows were looked up for."""

    def run(left, right):
        rows: list[dict] = []
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("least").to_pylist()))
        least = np.concatenate([received(x, "<i8") for _, x in answers]) if answers else np.zeros(0, np.int64)
        for chunk, at, counts, places in zip(chunks_of(left), *(left.column(c).to_pylist() for c in ("at", "counts", "places"))):
            w = Words(chunk.buf, chunk.offs, NOT_SPACE)
            count = np.frombuffer(unsqueeze(counts), np.uint8).astype(np.int64)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(received(at, "<i4").astype(np.int64), count) + step
            source = np.zeros(len(w.starts), np.int64)
            source[at] = least[np.repeat(received(places, "<i4").astype(np.int64), count) + step]
            known = np.zeros(len(w.starts), bool)
            known[at] = source[at] < chunk.ids[w.doc[at]]
            removed = np.zeros(len(w.starts), bool)
            for d in range(w.n):
                a, b = int(w.first[d]), int(w.first[d + 1])
                factors = parse(source[a:b], known[a:b], window) if known[a:b].any() else []
                for first, length, _ in factors:
                    removed[a + first : a + first + length] = True
                s, e = runs(removed[a:b])
                rows.append(
                    {"id": int(chunk.ids[d]) if chunk.known[d] else None, "n_words": b - a, "n_removed": int((e - s).sum()), "kept_sha256": _digest(w, d, removed),
                     "spans": [{"start": x, "stop": y} for x, y in zip(s.tolist(), e.tolist())], "factors": [dict(zip(("start", "length", "source"), f)) for f in factors]}
                )
        out = pa.Table.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPAN), ("factors", _FACTOR)]))
        release()
        return out

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, spans (removed words) and factors.

    A word goes if a window of so many words that covers it also starts in a document with a smaller
    id; windows are judged on the input. A null text has no words. Rows that repeat an id are
    not earlier than one another; a null id is later than any other, and rows with null ids are not
    earlier than one another either. An empty table gives an empty result; other columns are not
    looked at. A text of any length is read whole; a task needs memory in proportion to the longest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    secret = os.urandom(16)
    chunks = chunked(docs, id_col, text_col, "substrings")
    bits = bucket_bits(chunks)
    states = gram_states(chunks, bits, lambda chunk: _View(chunk, window, gram).grams(), "anchors", hot_rows)
    marked = materialize(chunks.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(_mark(bits, window, gram, secret), _MARKED_SCHEMA), "marked")
    discard(chunks, states)
    entries = marked.where("kind = 'entries'").select("bucket", "chunk", "text", "sizes", "ids", "at")
    first = materialize(entries.groupBy("bucket").applyInArrow(_look_up(window), "chunk long, bucket int, least binary"), "first")
    open_ = marked.where("kind = 'chunk'").select("chunk", "ids", "known", "sizes", "text", "at", "counts", "places")
    finished = open_.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_finish(window), RESULT)
    done = marked.where("kind = 'done'").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast(_SPANS).alias("spans"), F.array().cast(_FACTORS).alias("factors"))
    return done.unionByName(finished).withColumnRenamed("id", id_col)
