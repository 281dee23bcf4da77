"""Exact dedup by counting quotient filters.

Each partition builds a counting quotient filter of its texts' fingerprints: the fingerprint's high
bits (quotient) name a home slot, its low bits (remainder) are stored, sorted, in the quotient's
run, and repeats only raise a counter. Filters of one block of quotients merge losslessly, like
sorted lists. Fingerprints whose merged count is above one send their rows on to byte
verification, which groups by the whole normalised text; all other rows are known to be unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import materialize, ship_package, shuffle_partitions

#: Bits of a fingerprint that filters keep. Collisions cost a byte comparison, never a wrong result.
FINGERPRINT_BITS = 56


class CountingQuotientFilter:
    """A counting quotient filter over one block of quotients.

    occupieds has a bit for each quotient that has a run, runends a bit for each stored slot that
    ends a run, remainders the sorted remainders of all runs, counters the count of each slot.
    """

    def __init__(self, quotient_bits: int, remainder_bits: int, quotients: np.ndarray, remainders: np.ndarray, counters: np.ndarray):
        self.q, self.r = quotient_bits, remainder_bits
        self.remainders, self.counters = remainders, counters
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        last = np.ones(len(quotients), bool)
        last[:-1] = quotients[1:] != quotients[:-1]
        self.occupieds, self.runends = np.packbits(occupied), np.packbits(last)

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """values: sorted distinct fingerprints of the block, of so many bits."""
        q = max(1, min(bits - 1, int(len(values) * 1.25).bit_length()))
        r = bits - q
        return cls(q, r, (values >> np.uint64(r)).astype(np.int64), values & np.uint64((1 << r) - 1), counts)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints and counts put in, sorted: the filter is lossless."""
        homes = np.flatnonzero(np.unpackbits(self.occupieds)[: 1 << self.q])
        ends = np.flatnonzero(np.unpackbits(self.runends)[: len(self.remainders)])
        lens = np.diff(np.concatenate([[-1], ends]))
        return (np.repeat(homes, lens).astype(np.uint64) << np.uint64(self.r)) | self.remainders, self.counters

    def to_bytes(self) -> bytes:
        wide = 4 if self.r <= 32 else 8
        many = np.flatnonzero(self.counters > 1)
        head = np.array([self.q, self.r, len(self.remainders), len(many), wide], np.int64)
        return b"".join((head.tobytes(), self.occupieds.tobytes(), self.runends.tobytes(), self.remainders.astype(f"<u{wide}").tobytes(), many.astype("<u4").tobytes(), self.counters[many].astype("<u8").tobytes()))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, r, n, m, wide = (int(x) for x in np.frombuffer(raw, np.int64, 5))
        at, self = 40, cls.__new__(cls)
        self.q, self.r = q, r
        size = ((1 << q) + 7) // 8
        self.occupieds = np.frombuffer(raw, np.uint8, size, at)
        at += size
        self.runends = np.frombuffer(raw, np.uint8, (n + 7) // 8, at)
        at += (n + 7) // 8
        self.remainders = np.frombuffer(raw, f"<u{wide}", n, at).astype(np.uint64)
        at += n * wide
        self.counters = np.ones(n, np.uint64)
        self.counters[np.frombuffer(raw, "<u4", m, at)] = np.frombuffer(raw, "<u8", m, at + 4 * m)
        return self

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """The filter of all that went into any of these, counts added up."""
        parts = [f.entries() for f in filters]
        values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        return cls.of(values[first], np.add.reduceat(counts, first) if len(first) else counts, bits)


def _build(blocks: int):
    """Filters of a task's fingerprints, a row for each block; at most a few million fingerprints are held at once."""
    bits = FINGERPRINT_BITS
    block_bits = (blocks - 1).bit_length()

    def emit(values):
        values, counts = np.unique(values, return_counts=True)
        block = (values >> np.uint64(bits - block_bits)).astype(np.int64) if block_bits else np.zeros(len(values), np.int64)
        ids, first = np.unique(block, return_index=True)
        edge = [*first, len(values)]
        mask = np.uint64((1 << (bits - block_bits)) - 1)
        made = [CountingQuotientFilter.of(values[a:b] & mask, counts[a:b].astype(np.uint64), bits - block_bits).to_bytes() for a, b in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["block", "filter"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64) >> np.uint64(64 - bits))
            size += len(held[-1])
            if size >= 4_000_000:
                yield emit(np.concatenate(held))
                held, size = [], 0
        if size:
            yield emit(np.concatenate(held))

    return run


def _merge(blocks: int):
    bits = FINGERPRINT_BITS
    block_bits = (blocks - 1).bit_length()

    def run(table):
        block = table.column("block")[0].as_py()
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")], bits - block_bits)
        values, counts = whole.entries()
        many = counts > 1
        values = values[many] | (np.uint64(block) << np.uint64(bits - block_bits))
        return pa.table({"fingerprint": pa.array(values.astype(np.int64)), "rows": pa.array(counts[many].astype(np.int64))})

    return run


def repeated_fingerprints(fingerprints: DataFrame, blocks: int) -> DataFrame:
    """(fingerprint, rows) of the 64-bit hashes in the only column that occur more than once."""
    built = fingerprints.mapInArrow(_build(blocks), "block long, filter binary")
    return built.groupBy("block").applyInArrow(_merge(blocks), "fingerprint long, rows long")


def normalised(text) -> F.Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _fingerprint(text) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FINGERPRINT_BITS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are. The row with the smallest id of a group stays
    (a null id counts as larger than any other). Null texts are equal to empty ones. Rows that
    repeat an id all get a row; of a group whose smallest id is repeated, each such row is kept, as
    ids are all that tells rows apart. An empty table gives an empty result. Other columns of docs
    are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    narrow = materialize(rows.select("id", _fingerprint(F.col("norm")).alias("fingerprint"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact")
    # The row count is in the Parquet footers; a block gets about half a million fingerprints.
    blocks = 1 << max(0, int(max(shuffle_partitions(spark), narrow.count() / 500_000) - 1).bit_length())
    repeated = materialize(repeated_fingerprints(narrow.select(F.shiftleft("fingerprint", 64 - FINGERPRINT_BITS)), blocks), "repeated")
    # Byte verification: only rows of repeated fingerprints come here, pre-aggregated by whole text.
    routed = rows.withColumn("fingerprint", _fingerprint(F.col("norm"))).join(repeated.select("fingerprint"), "fingerprint")
    groups = (
        routed.groupBy("fingerprint", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = materialize(groups, "groups")
    out = narrow.join(groups, "sha", "left")
    keep = F.coalesce("keep_id", F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("id") == keep, F.col("group_size").isNull() | F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
