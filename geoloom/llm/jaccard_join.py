"""N-gram Jaccard join by parity sketches.

A document's sketch has a number of lanes; each of its shingles XORs its hash into one lane. Shingles
that two documents share cancel out alike, so a lane differs only if a shingle of the symmetric
difference fell into it: the Hamming distance over lanes is at most the size of the symmetric
difference. Documents that may link lie in one size band or the next, where the links' similarity
bounds that size by d; with d + 1 + slack lanes at least slack + 1 agree, and by the prefix argument
one of them is among the d + 1 lanes of either document that come first in a common order. The order
is by how many documents have a lane's value, counted over the corpus: rare ones first, so the lanes
that only hold a common passage are left out, and values that one document alone has bring nobody
together and need no row. Documents meet in groups of equal lanes.
A second parity sketch, of at least two bits for each shingle, drops most pairs that can't link: its Hamming
distance is a lower bound too. The shingle sets verify what is left.

A group of equal lanes may be huge. Its pairs are never listed: members are checked against the
group's first document, linked ones contract into components, and only members of different
components are compared further, without the first, whose pairs are settled. Documents that share
many lanes meet in a group for each; they become a pair in the first of these by key, as either
carries the smallest keys at which it meets others. A group of many members that don't link (one
template, filled in differently) is split by rare shingles: two documents that link share one of the
rarest of either, how many being given by their sizes, and so they only meet at these.

Shingles are told apart by 64-bit and equal sets by 128-bit digests made of keyed word digests; the
key is drawn for each run, so no text can be made to collide.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.components import connected_components
from geoloom.llm.exchange import Chunk, bucket_bits, chunked, chunks_of, received, send, split, spread, squeeze, unsqueeze
from geoloom.llm.kernels import NOT_SPACE, U64, Words, distinct, grams, mix, release, text_arrays
from geoloom.session import discard, forget_shuffles, materialize, ship_package

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
SLACK = 0.25
#: Text of a chunk; its lanes need several times as much memory.
CHUNK_BYTES = 1 << 20
#: Lane values that one bucket gets are those of so much text, about.
BUCKET_BYTES = 16 << 20
SALTED = 128
#: Members of a group that are compared in one task at most; a larger group is dealt out in pairs of blocks.
BLOCK_ROWS = 1024
SKETCH_WORDS = 8
#: Of the groups that a row is in, so many with the smallest keys go with it, for a pair to be listed in its first group only.
SEEN = 16
ROW_BITS = 20  # a row number is its chunk's number and its place in the chunk


def _lower(buf: np.ndarray) -> np.ndarray:
    up = (buf >= 65) & (buf <= 90)
    return buf + up.astype(np.uint8) * np.uint8(32)


class ShingleSets:
    """Distinct shingles of a chunk's documents: keyed 64-bit digests, sorted by document and digest."""

    def __init__(self, chunk: Chunk, k: int, secret: bytes):
        w = Words(_lower(chunk.buf), chunk.offs, NOT_SPACE)
        h = w.keyed(secret)
        words = np.diff(w.first)
        at = np.flatnonzero(w.remaining() >= k)
        value = grams(h, k)[at] if len(at) else np.zeros(0, U64)
        doc = w.doc[at]
        short = np.flatnonzero((words > 0) & (words < k))
        if len(short):  # the whole sequence is the only shingle
            lone = np.array([mix(grams(h[w.first[d] : w.first[d + 1]], int(words[d])) + U64(int(words[d])))[0] for d in short], U64)
            doc = np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            value, doc = np.concatenate([value, lone])[order], doc[order]
        edge = np.searchsorted(doc, np.arange(len(chunk.ids) + 1)).tolist()
        for a, b in zip(edge, edge[1:]):
            value[a:b].sort()
        new = np.ones(len(doc), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.value = doc[new], value[new]
        self.size = np.bincount(self.doc, minlength=len(chunk.ids))
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)

    def digests(self) -> np.ndarray:
        """A 128-bit digest of each set, two uint64 columns; of an empty set zeros."""
        out = np.zeros((len(self.size), 2), U64)
        full = np.flatnonzero(self.size)
        if len(full):
            for c, seed in enumerate((0x51ED270B, 0x2545F491)):
                out[full, c] = mix(np.add.reduceat(mix(self.value + U64(seed << 20)), self.first[:-1][full]) + self.size[full].astype(U64))
        return out

    def of(self, d: int) -> np.ndarray:
        return self.value[self.first[d] : self.first[d + 1]]


def bands(most: int) -> np.ndarray:
    """Upper ends of the size bands: a set and another it may link to lie in one band or in neighbours."""
    ends = [1]
    while ends[-1] < most:
        ends.append(-(-ends[-1] * 100 // PERCENT))
    return np.array(ends, np.int64)


def most_different(a, b):
    """Size of the symmetric difference that linked sets of these sizes have at most."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


class Lanes:
    """All lanes of a chunk's documents, in their own band and the next; equal sets have lanes once.

    key: hash of a lane's place and value; number: its place; owner: which document and band it
    belongs to; doc: a document by owner; keep: how many of its lanes must be looked at, by owner.
    """

    def __init__(self, sets: ShingleSets):
        _, docs = np.unique(sets.digests(), axis=0, return_index=True)
        docs = np.sort(docs[sets.size[docs] > 0])
        ends = bands(int(sets.size.max(initial=1)) * 2 + 2)
        band = np.searchsorted(ends, sets.size[docs])
        self.doc = np.concatenate([docs, docs])
        band = np.concatenate([band, band + 1])
        d = most_different(ends[band], ends[band])
        self.keep = d + 1
        lanes = self.keep + np.where(d > 0, np.ceil(SLACK * self.keep), 0).astype(np.int64)
        base, size = np.cumsum(lanes) - lanes, sets.size[self.doc]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(sets.first[self.doc], size)
        value = sets.value[at]
        place = mix(value + np.repeat(band.astype(U64) * U64(0x9E3779B97F4A7C15), size)) >> U64(32)
        lane = np.repeat(base, size) + (place * np.repeat(lanes, size).astype(U64) >> U64(32)).astype(np.int64)
        word = np.zeros(int(lanes.sum()), U64)
        np.bitwise_xor.at(word, lane, mix(value * U64(0xBF58476D1CE4E5B9) + U64(1)))
        self.owner = np.repeat(np.arange(len(lanes)), lanes)
        self.number = np.arange(len(word)) - base[self.owner]
        self.key = mix(word + mix(self.number.astype(U64) + (band[self.owner].astype(U64) << U64(40))))
        order = np.argsort(self.key)
        ordered = self.key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
        #: Distinct keys, how many lanes have each, and which of them each lane has.
        self.keys = ordered[new]
        self.counts = np.diff(np.append(np.flatnonzero(new), len(order)))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def first(self, often: np.ndarray) -> np.ndarray:
        """The lanes that come first in each document and band; often: of each distinct key."""
        order = np.argsort((self.owner << 40) | (often[self.of].astype(np.int64) << 32) | self.number, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(self.owner, self.owner)  # owners are sorted, and so is the order by owner
        return order[rank < self.keep[self.owner]]


_DESCRIBED = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _columns(schema: pa.Schema, height: int, **cols) -> pa.RecordBatch:
    """A batch with these columns and nulls in the others."""
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(height, f.type) for f in schema], schema=schema)


def _describe(bits: int, k: int, secret: bytes):
    """A row for each document (row, id, n, digest), and for each chunk and bucket its sorted distinct keys and how many documents have each."""

    def run(batches):
        for batch in batches:
            for chunk in chunks_of(batch):
                s = ShingleSets(chunk, k, secret)
                g = s.digests()
                row = (chunk.number << ROW_BITS) + np.arange(len(chunk.ids))
                yield _columns(_DESCRIBED, len(row), row=row, id=chunk.id_array(range(len(row))), n=s.size.astype(np.int64), d1=g[:, 0].view(np.int64), d2=g[:, 1].view(np.int64))
                x = Lanes(s)
                cut = split(x.keys, bits)
                low, counts = (x.keys >> U64(32 - bits)).astype("<u4"), x.counts.astype("<u2")  # a chunk has few thousand documents
                yield _columns(_DESCRIBED, len(cut), bucket=[b for b, _, _ in cut], chunk=[chunk.number] * len(cut), keys=[low[i:j].tobytes() for _, i, j in cut], counts=[send(counts[i:j]) for _, i, j in cut])
                release()

    return run


def _count(table):
    """For each asking chunk: how many documents of the corpus have each of its keys, as eight times the logarithm to base 2, and one more; 0 for a single one."""
    keys = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")]
    counts = np.concatenate([received(x.as_buffer(), "<u2") for x in table.column("counts")]).astype(np.int64)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(counts[order], new)
    code = np.where(total > 1, np.minimum(np.log2(total) * 8 + 1, 255), 0).astype(np.uint8)
    often = np.empty(len(order), np.uint8)
    often[order] = np.repeat(code, np.diff(np.append(new, len(order))))
    out = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "often": pa.array([squeeze(x.tobytes()) for x in spread(often, [len(k) for k in keys])], pa.binary())})
    release()
    return out


_CHOSEN = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("folded", pa.binary()), ("set", pa.binary())])


def _choose(bits: int, k: int, secret: bytes):
    """(key, row) of a chunk's lanes by which documents may meet, and (row, n, sketch, folded sketch, set) of their documents."""

    def run(left, right):
        out = []
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("often").to_pylist()))
        for chunk in chunks_of(left):
            s = ShingleSets(chunk, k, secret)
            x = Lanes(s)
            often = np.zeros(len(x.keys), np.uint8)
            for b, i, j in split(x.keys, bits):
                often[i:j] = np.frombuffer(unsqueeze(answers[b]), np.uint8)
            lanes = x.first(often)
            lanes = lanes[often[x.of[lanes]] > 0]
            doc = x.doc[x.owner[lanes]]
            base = chunk.number << ROW_BITS
            none = pa.nulls(len(lanes))
            out.append(pa.table([pa.array(x.key[lanes].view(np.int64)), pa.array(base + doc), *(none.cast(f.type) for f in list(_CHOSEN)[2:])], schema=_CHOSEN))
            rows: list[tuple] = []
            for d in distinct(doc).tolist():
                own = s.of(d)
                bits_ = sketch(own)
                rows.append((None, base + d, len(own), bits_.tobytes(), fold(bits_, folded_words(len(own))).tobytes(), own.tobytes()))
            out.append(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHOSEN)] if rows else [pa.array([], f.type) for f in _CHOSEN], schema=_CHOSEN))
        release()
        return pa.concat_tables(out) if out else _CHOSEN.empty_table()

    return run


def sketch(values: np.ndarray) -> np.ndarray:
    """Parity sketch of single bits, SKETCH_WORDS words or two bits for each shingle: every shingle flips one."""
    bits = max(64 * SKETCH_WORDS, 1 << int(2 * len(values) - 1).bit_length())
    at = (mix(values + U64(0x2545F4914F6CDD1D)) & U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & np.uint8(1), bitorder="little").view(U64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def folded_words(n: int) -> int:
    """Words of a folded sketch: half of its bits, the distance of sets that share nothing, are more than a link of n shingles may differ in."""
    return max(SKETCH_WORDS, 1 << (-(-n * 11 // 20) // 64).bit_length())


def may_link(n: int, words: np.ndarray, others_n: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the others' sketches (rows of equal width) don't rule out a link."""
    distance = np.bitwise_count(others ^ words).sum(1, dtype=np.int64)
    fits = np.minimum(n, others_n) * 100 >= PERCENT * np.maximum(n, others_n)
    return fits & (distance <= most_different(n, others_n))


def _pairs_that_may_link(batches):
    """Keeps (a, b) of rows (a, b, na, nb, sa, sb) whose sketches don't rule a link out."""
    for batch in batches:
        na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
        keep = np.zeros(len(na), bool)
        for i, (sa, sb) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
            x, y = np.frombuffer(sa.as_buffer(), U64), np.frombuffer(sb.as_buffer(), U64)
            size = min(len(x), len(y))
            keep[i] = may_link(int(na[i]), fold(x, size), nb[i : i + 1], fold(y, size)[None])[0]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _seen(batch) -> np.ndarray:
    """The keys in column seen, SEEN for each row; the largest integer where there are fewer, or no such column."""
    out = np.full((batch.num_rows, SEEN), np.iinfo(np.int64).max)
    if "seen" in batch.schema.names:
        col = batch.column("seen")
        count = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
        out[np.arange(SEEN) < count[:, None]] = np.asarray(col.flatten())
    return out


def _met_before(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs in groups key: whether the groups seen by their rows a and b have a smaller one in common."""
    out = np.zeros(len(key), bool)
    for c in range(SEEN):
        out |= (a[:, c] < key) & (b == a[:, c, None]).any(1)
    return out


def _cross_pairs(batches):
    """Pairs of different components in a pair of blocks of a group whose folded sketches don't rule a link out.

    Of a pair's groups, all but the first leave it out, where the keys seen by its rows show that. Rows come sorted by group and pair of blocks; all of a batch are compared at once, each row with
    the one so many places further on. A batch's last pair of blocks waits for the next batch.
    """
    names = ("key", "i", "j", "part", "row", "label", "n", "rare")

    def folded_to(size, words, width):
        """The sketches of at least so many words folded to these, a row for each; other rows are zero."""
        out, start = np.zeros((len(width), size), U64), np.cumsum(width) - width
        for w in np.unique(width[width >= size]).tolist():
            rows = np.flatnonzero(width == w)
            out[rows] = np.bitwise_xor.reduce(words[start[rows][:, None] + np.arange(w)].reshape(len(rows), -1, size), axis=1)
        return out

    def compare(cols, words, width, seen):
        key, i, j, part, row, label, n, rare = cols
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        levels = {w: folded_to(w, words, width) for w in np.unique(np.append(width, SKETCH_WORDS)).tolist()}
        left, step = np.arange(len(key)), 1
        while True:
            left = left[left + step < len(key)]
            right = left + step
            left = left[(key[left] == key[right]) & (i[left] == i[right]) & (j[left] == j[right])]
            if not len(left):
                break
            right = left + step
            x, y = left, right
            ok = (label[x] != label[y]) & ((part[x] != part[y]) | (i[x] == j[x]))
            x, y = x[ok], y[ok]
            # The smaller set must have the group's shingle among its rarest, for its size; of equal ones both.
            ok = np.minimum(n[x], n[y]) * 100 >= PERCENT * np.maximum(n[x], n[y])
            ok &= ((rare[x] > 0) | (n[x] > n[y])) & ((rare[y] > 0) | (n[y] > n[x]))
            x, y = x[ok], y[ok]
            common = np.minimum(width[x], width[y])
            ok = np.zeros(len(x), bool)
            for w in np.unique(common).tolist():
                k = np.flatnonzero(common == w)
                ok[k] = np.bitwise_count(levels[w][x[k]] ^ levels[w][y[k]]).sum(1, dtype=np.int64) <= most_different(n[x[k]], n[y[k]])
            x, y = x[ok], y[ok]
            ok = ~_met_before(key[x], seen[x], seen[y])
            a.append(np.minimum(row[x[ok]], row[y[ok]]))
            b.append(np.maximum(row[x[ok]], row[y[ok]]))
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    held, held_words, held_width, held_seen = [np.zeros(0, np.int64)] * len(names), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros((0, SEEN), np.int64)
    for batch in batches:
        cols = [np.concatenate([h, np.asarray(batch.column(c)).astype(np.int64)]) for h, c in zip(held, names)]
        data, starts, ends, _ = text_arrays(batch.column("folded"))
        new = data[starts[0] : ends[-1]].tobytes() if len(starts) else b""
        words, width = np.concatenate([held_words, np.frombuffer(new, U64)]), np.concatenate([held_width, (ends - starts) // 8])
        seen = np.concatenate([held_seen, _seen(batch)])
        before = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])) if len(cols[0]) else []
        cut = int(before[-1]) + 1 if len(before) else 0
        at = int(width[:cut].sum())
        yield compare([c[:cut] for c in cols], words[:at], width[:cut], seen[:cut])
        held, held_words, held_width, held_seen = [c[cut:] for c in cols], words[at:], width[cut:], seen[cut:]
    yield compare(held, held_words, held_width, held_seen)
    release()


def _cross(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (key, row, label, rare) of one key and different labels that may link.

    The rows of a key's largest label, T, and the others, O, are cut into blocks; tasks get pairs of
    blocks, T with O and O with O. A key whose rows fit in one block is one pair. Two rows are compared
    at each key that is rare for both, so a pair may be left out where they have seen a smaller one.
    """
    counts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.max("rare").alias("rare"))
    tops = counts.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("top"), F.max("size").alias("most"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels"), F.max("rare").alias("any"))
    tops = tops.where("labels > 1 AND any > 0").select("key", "top", "size", F.ceil(F.col("most") / BLOCK_ROWS).cast("int").alias("ts"), F.ceil((F.col("size") - F.col("most")) / BLOCK_ROWS).cast("int").alias("os"))
    single, is_top, deal = F.col("size") <= BLOCK_ROWS, F.col("label") == F.col("top"), F.xxhash64("row")
    part = F.when(single, 0).when(is_top, -1 - F.pmod(deal, F.col("ts"))).otherwise(F.pmod(deal, F.col("os"))).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    others = F.sequence(F.lit(0), F.col("os") - 1)
    pairs = (
        F.when(single, F.array(pair(F.lit(0), F.lit(0))))
        .when(is_top, F.transform(others, lambda o: pair(F.col("part"), o)))
        .otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.col("ts")), lambda t: pair(-t, F.col("part"))), F.transform(others, lambda o: pair(F.least(o, F.col("part")), F.greatest(o, F.col("part"))))))
    )
    dealt = members.join(tops, "key").withColumn("part", part).select("key", "row", "label", "rare", "part", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "part", "row", "label", "rare")
    seen = members.where("rare > 0").groupBy("row").agg(F.slice(F.sort_array(F.collect_list("key")), 1, SEEN).alias("seen"))
    dealt = dealt.join(sets.select("row", "n", "folded"), "row").join(seen, "row", "left").select("key", "i", "j", "part", "row", "label", "n", "rare", "folded", "seen")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cross_pairs, "a long, b long").distinct()


def _shingles(batches):
    """(shingle, row) of (row, set)."""
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("set")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *own])), pa.array(np.repeat(np.asarray(batch.column("row")), [len(x) for x in own]))], ["shingle", "row"])


def _by_rare_shingles(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (key, row, label, rare) of groups of hot's rows (row, label) by their rarest shingles.

    Sets a and b, a not the larger, that link share more than |a| - 2P / (100 + P) |a| shingles of a
    and |b| - P / 100 |b| of b, P being PERCENT. So in any common order one of as many from the front
    of either is shared; rare tells whether a shingle is in the shorter of these fronts. The order is
    by how many of hot's rows have a shingle.
    """
    of = hot.join(sets.select("row", "set"), "row").select("row", "set").mapInArrow(_shingles, "shingle long, row long")
    often = of.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ordered = of.join(often, "shingle", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle"))).alias("s"))
    n = F.size("s")
    front = n - F.ceil(n * PERCENT / 100).cast("int") + 1
    short = n - F.ceil(n * (2 * PERCENT) / (100 + PERCENT)).cast("int") + 1
    at = ordered.select("row", short.alias("short"), F.posexplode(F.slice("s", F.lit(1), front)).alias("k", "s"))
    return at.where("s.often > 1").select(F.col("s.shingle").alias("key"), "row", (F.col("k") < F.col("short")).cast("int").alias("rare")).join(hot, "row").select("key", "row", "label", "rare")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared * 100 >= PERCENT * (len(a) + len(b) - shared)


def _verify(left, right):
    """left: (a, salt, b, set of b) of one pivot and salt; right: the set of a. The pairs that link."""
    if not len(right) or not len(left):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    own = np.frombuffer(right.column("own")[0].as_py(), U64)
    ok = [linked(own, np.frombuffer(x.as_py(), U64)) for x in left.column("set")]
    return left.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
    """The distinct pairs (a, b) that link, written. A pivot's pairs are dealt out by salt, SALTED to each, with a copy of its set."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALTED).alias("salts"))
    dealt = materialize(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")), "pairs")
    left = dealt.join(sets.withColumnRenamed("row", "b"), "b").select("a", "b", "salt", "set")
    own = dealt.select(F.col("a").alias("pivot"), F.col("salt").alias("part")).distinct().join(sets.select(F.col("row").alias("pivot"), F.col("set").alias("own")), "pivot")
    out = materialize(left.groupBy("a", "salt").cogroup(own.groupBy("pivot", "part")).applyInArrow(_verify, "a long, b long"), tag)
    discard(dealt)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id in the row's component).

    Rows link when their sets of distinct shingles (A-Z lower-cased) have a Jaccard similarity of
    PERCENT / 100 or more. With fewer words than a shingle the whole sequence is one; without words
    or text the set is empty and links with nothing. Rows are nodes of their own: rows that repeat
    an id link only if their sets do; a null id counts only where a component has no other. An
    empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    secret = os.urandom(16)
    chunks = chunked(docs, id_col, text_col, "jaccard", CHUNK_BYTES)
    bits = bucket_bits(chunks, BUCKET_BYTES)
    described = materialize(chunks.select("chunk", "ids", "known", "sizes", "text").mapInArrow(_describe(bits, shingle_words, secret), "row long, id long, n long, d1 long, d2 long, bucket int, chunk long, keys binary, counts binary"), "sets")
    about = described.where("row IS NOT NULL").select("row", "id", "n", "d1", "d2")
    # Equal sets are one class, whose first row stands for it.
    classes = about.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("size"))
    copies = materialize(about.join(classes.where("size > 1"), ["d1", "d2", "n"]).select("row", "rep"), "copies")
    asked = described.where("bucket IS NOT NULL").select("bucket", "chunk", "keys", "counts")
    often = materialize(asked.groupBy("bucket").applyInArrow(_count, "chunk long, bucket int, often binary"), "often")
    about = materialize(about.select("row", "id", "n"), "about")
    discard(described)
    chosen = materialize(chunks.groupBy("chunk").cogroup(often.groupBy("chunk")).applyInArrow(_choose(bits, shingle_words, secret), "key long, row long, n long, sketch binary, folded binary, set binary"), "lanes")
    discard(chunks, often)
    forget_shuffles(spark)
    sets = chosen.where("set IS NOT NULL").drop("key")
    only = sets.select("row", "set")
    met = chosen.where("key IS NOT NULL").select("key", "row").join(copies, "row", "left").select("key", F.coalesce("rep", "row").alias("row")).distinct()
    groups = met.groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last")
    members = materialize(met.join(groups, "key").select("key", "first", "row"), "members")
    # First round: everyone against the group's first document.
    sketches = lambda r, n, s: sets.select(F.col("row").alias(r), F.col("n").alias(n), F.col("sketch").alias(s))
    stars = members.where("row > first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct()
    stars = stars.join(sketches("b", "nb", "sb"), "b").where(F.col("nb") > 0).join(sketches("a", "na", "sa"), "a")
    stars = materialize(stars.mapInArrow(_pairs_that_may_link, "a long, b long"), "hopeful")
    linked_ = _links(stars, only, "stars")
    forget_shuffles(spark)
    label = connected_components(linked_)
    # Second round: what a group still has in different components, but for its first document. Every link there joins two of them.
    labelled = materialize(members.where("row > first").select("key", "row").join(label.withColumnRenamed("node", "row"), "row", "left").select("key", "row", F.coalesce("label", "row").alias("label")), "labelled")
    discard(members, label)
    open_ = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key", "size")
    open_ = materialize(open_, "open")
    small = labelled.join(open_.where(F.col("size") <= BLOCK_ROWS), "key").select("key", "row", "label", F.lit(1).alias("rare"))
    hot = materialize(labelled.join(open_.where(F.col("size") > BLOCK_ROWS), "key").select("row", "label").distinct(), "hot")
    cross = _cross(small, sets).unionByName(_cross(_by_rare_shingles(hot, only), sets)).distinct()
    # Written first: Catalyst would move the join below distinct(), to a row for each lane that a pair has in common.
    cross = materialize(cross, "cross-pairs")
    crossing = materialize(cross.join(stars, ["a", "b"], "left_anti"), "crossing")
    discard(cross)
    forget_shuffles(spark)
    more = _links(crossing, only, "cross")
    forget_shuffles(spark)
    edges = linked_.unionByName(more).unionByName(copies.select(F.col("row").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    label = connected_components(edges)
    discard(chosen, stars, labelled, open_, hot, crossing, linked_, more, copies)
    whole = about.join(label.withColumnRenamed("node", "row"), "row", "left").select("id", "n", F.coalesce("label", "row").alias("label"))
    least = whole.groupBy("label").agg(F.min("id").alias("component_id"))
    return whole.join(least, "label").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
