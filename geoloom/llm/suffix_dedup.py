"""Suffix-array dedup of repeated byte strings, built blockwise with cover samples.

Two suffixes that agree for a whole window agree on where its smallest gram lies, so anchors chosen
that way are a cover: whatever two windows tie, an anchor lies at the same distance in both. Where
an anchor's gram occurs more than once, the bytes of its windows go to the gram's bucket; hashes
only say in which bucket bytes meet. A bucket first sorts its cover suffixes, the bytes from each
anchor on and then those before it: equal ranks are the long ties, and resolve all their windows at
once. Only where a gram is shared and what surrounds it differs, at the edges of repeats, are the
windows' own suffixes sorted: one block of suffix buckets at a time, by their first PERIOD bytes,
ties by precomputed ranks at a difference-cover sample of the block; then neighbours are compared
over the whole window. Memory is bounded by the bucket and the block.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.exchange import HOT, HOT_ROWS, Chunk, bucket_bits, chunked, chunks_of, gram_states, pack_chunk, received, send, split, squeeze, states_of, unsqueeze
from geoloom.llm.kernels import U64, cover, leftmost_minima, mix, release, runs
from geoloom.session import discard, materialize, ship_package

WINDOW = 200
#: Bytes of an anchor's gram.
GRAM = 96
#: Text of a chunk, and text whose anchors one bucket gets, about.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Windows handled at once.
PIECE = 1 << 16
#: Period of the difference cover, and a cover of it: every residue is a difference of two of these (fixed values).
PERIOD = 64
COVER = (0, 1, 3, 13, 17, 25, 30, 38, 49, 58)
#: Suffixes sorted at once.
BLOCK = 1 << 17
#: Bytes of the keyed digests that stand for windows at hot anchors.
DIGEST = 16

_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, PIECE + 4 * WINDOW)
        steps = [np.full(size, b, U64) for b in (_BASE, inverse)]
        for x in steps:
            x[0] = 1
        _POW[:] = [np.cumprod(x) for x in steps]
    return _POW[0], _POW[1]


class _Hasher:
    """Hashes of any stretch of a byte array."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * power[: len(buf)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U64)


def _pieces(offs: np.ndarray, window: int):
    """Stretches (from, to) of window starts of bounded size, with no regard to documents."""
    total = int(offs[-1])
    for a in range(0, max(total - window + 1, 0), PIECE):
        yield a, min(a + PIECE, total - window + 1)


class Anchors:
    """A chunk's anchors: gram, first window, number of windows, and how far before the anchor the first begins."""

    def __init__(self, chunk: Chunk, window: int, gram: int):
        out = []
        for a, b in _pieces(chunk.offs, window):
            buf = chunk.buf[a : b + window - 1]
            i, j = np.searchsorted(chunk.offs[1:], a, "right"), np.searchsorted(chunk.offs[1:], b - 1, "right")
            ends = np.repeat(chunk.offs[1 + i : 2 + j], np.diff(np.clip(chunk.offs[i : 2 + j], a, b)))
            valid = np.flatnonzero(ends - np.arange(a, b) >= window)
            if not len(valid):
                continue
            g = _Hasher(buf).grams(gram)
            p = leftmost_minima(g, window - gram + 1)[valid]
            begin = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (valid[1:] != valid[:-1] + 1)]))
            first, count = valid[begin], np.diff(np.append(begin, len(p)))
            # Minima are small numbers: mixed again, or they would all fall into the first buckets.
            out.append((mix(g[p[begin]] + U64(0x9E3779B97F4A7C15)), first + a, count, p[begin] - first))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, U64)] + [np.zeros(0, np.int64)] * 3
        self.gram, self.first, self.count, self.before = cols

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct grams, and how often each occurs."""
        g = np.sort(self.gram)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        return g[first], np.diff(np.append(first, len(g)))


_MARKED = pa.schema(
    [("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("at", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()),
     ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
)
_SPANS = "array<struct<start:bigint,stop:bigint>>"
RESULT = f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {_SPANS}"
_MARKED_SCHEMA = f"kind string, bucket int, chunk long, ids binary, known binary, sizes binary, text binary, at binary, counts binary, places binary, {RESULT}"


def _result(chunk: Chunk, d: int, removed: np.ndarray | None) -> dict:
    a, b = int(chunk.offs[d]), int(chunk.offs[d + 1])
    s, e = runs(removed[a:b]) if removed is not None else (np.zeros(0, np.int64),) * 2
    kept = chunk.buf[a:b][~removed[a:b]].tobytes() if len(s) else chunk.raw[a:b]
    return {"id": int(chunk.ids[d]) if chunk.known[d] else None, "n_bytes": b - a, "n_removed": int((e - s).sum()), "n_spans": len(s), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": x, "stop": y} for x, y in zip(s.tolist(), e.tolist())]}


def _mark(bits: int, window: int, gram: int, secret: bytes):
    """Sends the bytes at shared anchors to their buckets and keeps the text of their documents; finishes the others.

    Segments (the bytes of an anchor's windows) are distinct in a chunk, with a note if the chunk has
    one twice. At hot anchors every window goes by itself, as a keyed digest, so that no bucket gets
    all that stands at one gram.
    """

    def run(left, right):
        rows: list[dict] = []
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("states").to_pylist()))
        for chunk in chunks_of(left):
            x = Anchors(chunk, window, gram)
            keys, _ = x.grams()
            state = states_of(keys, bits, answers)[np.searchsorted(keys, x.gram)] if len(keys) else np.zeros(0, np.uint8)
            seen: dict[bytes, list] = {}  # bytes -> occurrences, key, windows, order, distance to the anchor
            digests: dict[bytes, list] = {}
            used: list[list] = []
            first, count = [], []
            some = np.flatnonzero(state)
            for a, n, before, key, hot in zip(x.first[some].tolist(), x.count[some].tolist(), x.before[some].tolist(), x.gram[some].tolist(), (state[some] == HOT).tolist()):
                for k in range(a, a + n) if hot else (a,):
                    many = 1 if hot else n
                    part = chunk.raw[k : k + many - 1 + window]
                    if hot:
                        part = hashlib.blake2b(part, digest_size=DIGEST, key=secret).digest()
                        key = int.from_bytes(part[:8], "little")
                    entry = (digests if hot else seen).setdefault(part, [0, key, many, 0, before])
                    entry[0] += 1
                    used.append(entry)
                    first.append(k)
                    count.append(many)
            doc = np.searchsorted(chunk.offs[1:], np.array(first, np.int64), "right")
            open_ = np.zeros(len(chunk.ids), bool)
            open_[doc] = True
            # Entries in the order in which they are sent: by bucket, segments before digests.
            entries = [*seen.items(), *digests.items()]
            key = np.array([e[1] for _, e in entries], U64) >> U64(64 - bits)
            order = np.argsort(key, kind="stable")
            windows = np.array([e[2] for _, e in entries], np.int64)[order]
            for k, p in zip(order.tolist(), (np.cumsum(windows) - windows).tolist()):
                entries[k][1][3] = p
            for b, i, j in split(key[order] << U64(64 - bits), bits):
                mine = [entries[k] for k in order[i:j].tolist()]
                segments = int((order[i:j] < len(seen)).sum())
                shape = np.array([(len(s), e[4]) for s, e in mine[:segments]], "<u2").reshape(-1, 2)
                rows.append(
                    {"kind": "entries", "bucket": b, "chunk": chunk.number, "text": squeeze(b"".join([s for s, _ in mine])), "sizes": send(shape[:, 0].copy()), "places": send(shape[:, 1].copy()),
                     "counts": squeeze(np.array([e[0] > 1 for _, e in mine], np.uint8).tobytes())}
                )
            keep = np.flatnonzero(open_)
            if len(keep):
                size = np.diff(chunk.offs)
                shift = np.cumsum(np.where(open_, 0, size))  # bytes of finished documents before
                row = pack_chunk(chunk.number, chunk.ids[keep], chunk.known[keep], size[keep], b"".join(chunk.raw[chunk.offs[d] : chunk.offs[d + 1]] for d in keep))
                rows.append(
                    dict(zip(("chunk", "ids", "known", "sizes", "text"), row))
                    | {"kind": "chunk", "at": send((np.array(first, np.int64) - shift[doc]).astype("<i8")), "counts": squeeze(np.array(count, np.uint8).tobytes()), "places": send(np.array([e[3] for e in used], "<i8"))}
                )
            rows += [{"kind": "done"} | _result(chunk, d, None) for d in np.flatnonzero(~open_).tolist()]
        out = pa.Table.from_pylist(rows, schema=_MARKED)
        release()
        return out

    return run


def _big_endian(text: np.ndarray, at: np.ndarray, j: int) -> np.ndarray:
    """Bytes 8j to 8j + 8 behind each place, as one number that sorts like them."""
    out = np.zeros(len(at), U64)
    for k in range(8):
        out = (out << U64(8)) | text[at + 8 * j + k]
    return out


def _names(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by their keys, the first most significant; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at the difference-cover sample, by at least depth bytes; zero elsewhere.

    Steps of PERIOD stay in the sample, so prefix doubling needs no other places. text must end in
    2 * depth + 2 * PERIOD bytes of padding, whose places get no rank.
    """
    n = len(text) - 2 * depth - 2 * PERIOD
    place = np.arange(n)
    sample = place[np.isin(place % PERIOD, COVER)]
    ranks = np.zeros(len(text), np.int64)
    ranks[sample] = _names([_big_endian(text, sample, j) for j in range(PERIOD // 8)])
    reach = PERIOD
    while reach < depth:
        ranks[sample] = _names([ranks[sample], ranks[sample + reach]])
        reach *= 2
    return ranks


def repeated_suffixes(text: np.ndarray, ranks: np.ndarray, at: np.ndarray, window: int, bucket: np.ndarray) -> np.ndarray:
    """Which of the suffixes at these places share their first window bytes with another of them: one block of suffix buckets sorted."""
    to_sample = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    residue = at % PERIOD
    words = [_big_endian(text, at, j) for j in range(PERIOD // 8)]
    order = np.lexsort([ranks[at + to_sample[residue]], *words[::-1], bucket])
    same = bucket[order][1:] == bucket[order][:-1]
    for w in words:
        s = w[order]
        same &= s[1:] == s[:-1]
    pair, place = np.flatnonzero(same), at[order]
    for j in range(PERIOD, window, 8):
        step = min(j, window - 8)
        a, b = np.zeros(len(pair), U64), np.zeros(len(pair), U64)
        for k in range(8):
            a, b = (a << U64(8)) | text[place[pair] + step + k], (b << U64(8)) | text[place[pair + 1] + step + k]
        pair = pair[a == b]
    out = np.zeros(len(at), bool)
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def edge_windows(segments: list[bytes], before: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """For each window of each segment: whether it is repeated in another segment of its group. One block."""
    size = np.array([len(s) for s in segments])
    count = size - window + 1
    # Lay the anchors of all segments on the same residue, so that suffixes that tie have equal residues.
    room = (size + before + 2 * PERIOD - 1) // PERIOD * PERIOD
    start = np.cumsum(room) - room + (-before) % PERIOD
    text = np.zeros(int(room.sum()) + 2 * window + 4 * PERIOD, np.uint8)
    pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[pos + np.repeat(start, size)] = np.frombuffer(b"".join(segments), np.uint8)
    ranks = cover_ranks(text, window)
    out = np.zeros(int(count.sum()), bool)
    at = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    # A suffix bucket: the suffixes that stand alike to one kind of anchor.
    key = np.repeat(group, count) * (2 * window) + (np.repeat(start + before, count) - at)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])), len(order))
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + BLOCK // 4, "right")) - 1)
        block = order[edges[i] : edges[j]]
        out[block] = repeated_suffixes(text, ranks, at[block], window, ordered[edges[i] : edges[j]])
        i = j
    return out


def repeated_windows(segments: list[tuple[bytes, bytes]], times: list[int], window: int, gram: int) -> list[np.ndarray]:
    """For each segment (bytes from its anchor on, bytes before it; how often it occurs), whether each of its windows is repeated.

    The cover suffixes are sorted. Segments of equal rank tie in all their windows; of the others that
    share a gram, the windows are sorted.
    """
    order = sorted(range(len(segments)), key=segments.__getitem__)
    ranks, totals, leads = np.zeros(len(segments), np.int64), [], []
    for k in order:
        if not leads or segments[leads[-1]] != segments[k]:
            leads.append(k)
            totals.append(0)
        totals[-1] += times[k]
        ranks[k] = len(leads) - 1
    flags = [np.full(sum(map(len, segments[k])) - window + 1, n > 1) for k, n in zip(leads, totals)]
    # Ranks of one gram follow one another.
    new = [r == 0 or segments[leads[r]][0][:gram] != segments[leads[r - 1]][0][:gram] for r in range(len(leads))]
    group = np.cumsum(new)
    edges = np.append(np.flatnonzero(new), len(leads))
    block: list[int] = []
    size = 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1 and any(n == 1 for n in totals[a:b]):
            block += range(a, b)
            size += sum(map(len, flags[a:b]))
        if block and (size >= BLOCK or b == len(leads)):
            own = [segments[leads[r]] for r in block]
            found = edge_windows([left + right for right, left in own], np.array([len(left) for _, left in own]), group[block], window)
            for r, f in zip(block, np.split(found, np.cumsum([len(flags[r]) for r in block])[:-1])):
                flags[r] = flags[r] | f
            block, size = [], 0
    return [flags[r] for r in ranks]


def _sort(window: int, gram: int):
    """Sorts a bucket; a bit for each window that chunks ask about."""

    def run(table):
        segments, times, digests, digest_times, shape = [], [], [], [], []
        for body, sizes, before, many in zip(*(table.column(c) for c in ("text", "sizes", "places", "counts"))):
            raw, many = unsqueeze(body.as_buffer()), (np.frombuffer(unsqueeze(many.as_buffer()), np.uint8) + 1).tolist()
            at = 0
            size, before = received(sizes.as_buffer(), "<u2").tolist(), received(before.as_buffer(), "<u2").tolist()
            for n, p in zip(size, before):
                segments.append((raw[at + p : at + n], raw[at : at + p]))
                at += n
            digests += [raw[k : k + DIGEST] for k in range(at, len(raw), DIGEST)]
            times += many[: len(size)]
            digest_times += many[len(size) :]
            shape.append((len(size), len(many) - len(size)))
        flags = repeated_windows(segments, times, window, gram)
        often: dict[bytes, int] = {}
        for x, n in zip(digests, digest_times):
            often[x] = often.get(x, 0) + n
        found = np.array([often[x] > 1 for x in digests], bool)
        out, i, j = [], 0, 0
        for n, m in shape:
            out.append(squeeze(np.packbits(np.concatenate([np.zeros(0, bool), *flags[i : i + n], found[j : j + m]])).tobytes()))
            i, j = i + n, j + m
        out = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": pa.array([int(sum(map(len, flags[a - n : a]))) + m for a, (n, m) in zip(np.cumsum([n for n, _ in shape]).tolist(), shape)], pa.int64()), "flags": pa.array(out, pa.binary())})
        release()
        return out

    return run


def _finish(window: int):
    def run(left, right):
        rows: list[dict] = []
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("flags").to_pylist()))
        flags = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(unsqueeze(x), np.uint8))[:n].astype(bool) for _, n, x in answers)])
        for chunk, at, counts, places in zip(chunks_of(left), *(left.column(c).to_pylist() for c in ("at", "counts", "places"))):
            count = np.frombuffer(unsqueeze(counts), np.uint8).astype(np.int64)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            hit = flags[np.repeat(received(places, "<i8"), count) + step]
            removed = cover((np.repeat(received(at, "<i8"), count) + step)[hit], window, len(chunk.buf))
            rows += [_result(chunk, d, removed) for d in range(len(chunk.ids))]
        out = pa.Table.from_pylist(rows, schema=pa.schema([_MARKED.field(n) for n in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")]))
        release()
        return out

    return run


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed bytes).

    A byte goes if a string of window bytes (a multiple of 8, above PERIOD) that covers it also
    starts anywhere else, in any row; strings are judged on the input. A null text is an empty one.
    Repeated rows repeat each other's strings; ids, null or not, are only carried along. An
    empty table gives an empty result; other columns are not looked at. A text of any length is read
    whole; a task needs memory in proportion to the longest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    secret = os.urandom(16)
    chunks = chunked(docs, id_col, text_col, "repeats", CHUNK_BYTES)
    bits = bucket_bits(chunks, BUCKET_BYTES)
    states = gram_states(chunks, bits, lambda chunk: Anchors(chunk, window, gram).grams(), "cover", hot_rows)
    marked = materialize(chunks.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(_mark(bits, window, gram, secret), _MARKED_SCHEMA), "segments")
    discard(chunks, states)
    entries = marked.where("kind = 'entries'").select("bucket", "chunk", "text", "sizes", "places", "counts")
    flags = materialize(entries.groupBy("bucket").applyInArrow(_sort(window, gram), "chunk long, bucket int, n long, flags binary"), "suffixes")
    open_ = marked.where("kind = 'chunk'").select("chunk", "ids", "known", "sizes", "text", "at", "counts", "places")
    finished = open_.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_finish(window), RESULT)
    done = marked.where("kind = 'done'").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    return done.unionByName(finished).withColumnRenamed("id", id_col)
