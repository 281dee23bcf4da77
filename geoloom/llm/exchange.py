"""Packed exchanges: values travel between chunks of documents and buckets of hash values.

Documents are first laid out in chunks of bounded size, each one row of a table in the shared folder.
A chunk sends every bucket one row with its sorted distinct values, so a value that a third of all
documents have costs an entry per chunk, not per document; a bucket answers each chunk with one row
whose entries stand in the same order. Rows are few and large and compressed once, so neither
tables nor shuffles cost more than the compressed bytes. All of it can be recomputed from the chunk
table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.kernels import U64, release, text_arrays
from geoloom.session import materialize, shuffle_partitions

CHUNK_BYTES = 2 << 20
CHUNK_DOCS = 4000
#: Text whose values one bucket gets, about.
BUCKET_BYTES = 16 << 20
CHUNK_SCHEMA = "chunk long, ids binary, known binary, sizes binary, text binary, n_bytes long"
_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("n_bytes", pa.int64())])
NO_ID = np.iinfo(np.int64).max


def squeeze(raw: bytes) -> bytes:
    """Compressed bytes, their length in front."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unsqueeze(raw) -> bytes:
    raw = memoryview(raw)
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def pack_chunk(chunk: int, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, text: bytes) -> tuple:
    return chunk, squeeze(planes(ids.astype("<i8"))), np.packbits(known.astype(bool)).tobytes(), squeeze(planes(sizes.astype("<i8"))), squeeze(text), len(text)


class Chunk:
    """A chunk's ids (NO_ID where null), text bytes and the offsets of its documents in them."""

    def __init__(self, number: int, ids, known, sizes, text):
        self.number = number
        self.ids = unplanes(unsqueeze(ids), "<i8").copy()
        self.known = np.unpackbits(np.frombuffer(known, np.uint8))[: len(self.ids)].astype(bool)
        self.ids[~self.known] = NO_ID
        self.raw = unsqueeze(text)
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.offs = np.concatenate([[0], np.cumsum(unplanes(unsqueeze(sizes), "<i8"))]).astype(np.int64)

    def id_array(self, rows) -> pa.Array:
        return pa.array([int(self.ids[r]) if self.known[r] else None for r in rows], pa.int64())


def chunks_of(table_or_batch):
    """The chunks in an Arrow batch or table of CHUNK_SCHEMA's first columns."""
    cols = [table_or_batch.column(c) for c in ("chunk", "ids", "known", "sizes", "text")]
    for row in zip(*cols):
        yield Chunk(row[0].as_py(), *(x.as_buffer() for x in row[1:]))
        release()


def _lay_out(limit: int):
    return lambda batches: _chunks(batches, limit)


def _chunks(batches, limit: int):
    from pyspark import TaskContext

    base, count = TaskContext.get().partitionId() << 24, 0
    ids, known, texts, size = [], [], [], 0

    def emit():
        nonlocal ids, known, texts, size, count
        sizes = np.array([len(t) for t in texts], np.int64)
        row = pack_chunk(base + count, np.array(ids, np.int64), np.array(known, bool), sizes, b"".join(texts))
        ids, known, texts, size = [], [], [], 0
        count += 1
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _CHUNK)], schema=_CHUNK)

    for batch in batches:
        data, starts, ends, _ = text_arrays(batch.column(1))
        for key, a, b in zip(batch.column(0).to_pylist(), starts.tolist(), ends.tolist()):
            if texts and (size + b - a > limit or len(texts) >= CHUNK_DOCS):
                yield emit()
            ids.append(key or 0)
            known.append(key is not None)
            texts.append(data[a:b].tobytes())
            size += b - a
    if texts:
        yield emit()
    release()


def chunked(docs: DataFrame, id_col: str, text_col: str, tag: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of docs, written to the shared folder; a null text is an empty one."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return materialize(rows.mapInArrow(_lay_out(limit), CHUNK_SCHEMA), tag)


def bucket_bits(chunks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets (as bits): one for each shuffle partition at least, and for each bucket_bytes of text."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, int(max(shuffle_partitions(chunks.sparkSession), total / bucket_bytes) - 1).bit_length())


def split(values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted uint64 values by their top bits, for the buckets that occur."""
    if not len(values):
        return []
    top = values >> U64(64 - bits)
    first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    return list(zip(top[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)]))


def planes(x: np.ndarray) -> bytes:
    """Fixed-width integers byte plane by byte plane: equal high bytes then compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(raw, np.uint8)
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).ravel()


def send(x: np.ndarray) -> bytes:
    return squeeze(planes(np.ascontiguousarray(x)))


def received(raw, kind) -> np.ndarray:
    return unplanes(unsqueeze(raw), kind)


def spread(order_of: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Cut an array back into the parts it was joined from."""
    return np.split(order_of, np.cumsum(sizes)[:-1])


#: What is known of a gram: it occurs once; elsewhere too; more than HOT times.
ALONE, SHARED, HOT = 0, 1, 2
#: Occurrences above which what stands at a gram is dealt out window by window, so that no bucket gets all of it.
HOT_ROWS = 4096


def _ask(bits: int, grams_of: Callable):
    """A row for each chunk and bucket: its sorted distinct grams (32 bits below the bucket's) and how often each occurs."""

    def run(batches):
        for batch in batches:
            for chunk in chunks_of(batch):
                keys, counts = grams_of(chunk)
                parts = split(keys, bits)
                low = (keys >> U64(32 - bits)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in parts], pa.int32()), pa.array([chunk.number] * len(parts), pa.int64()), *(pa.array([f(x[i:j]) for _, i, j in parts], pa.binary()) for x, f in ((low, lambda x: x.tobytes()), (counts.astype("<u4"), send)))],
                    ["bucket", "chunk", "keys", "counts"],
                )
        release()

    return run


def _answer(hot_rows: int):
    return lambda table: _states(table, hot_rows)


def _states(table, hot_rows: int):
    """For each asking chunk: the state of each of its grams."""
    keys = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")]
    counts = np.concatenate([received(x.as_buffer(), "<u4") for x in table.column("counts")])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    state = np.empty(len(order), np.uint8)
    state[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot_rows), np.diff(np.append(first, len(order))))
    out = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "states": pa.array([squeeze(s.tobytes()) for s in spread(state, [len(k) for k in keys])], pa.binary())})
    release()
    return out


def gram_states(chunks: DataFrame, bits: int, grams_of: Callable, tag: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(chunk, bucket, states) for grams_of(chunk): sorted distinct 64-bit grams and their numbers of occurrences."""
    asked = chunks.mapInArrow(_ask(bits, grams_of), "bucket int, chunk long, keys binary, counts binary")
    return materialize(asked.groupBy("bucket").applyInArrow(_answer(hot_rows), "chunk long, bucket int, states binary"), tag)


def states_of(keys: np.ndarray, bits: int, answers: dict) -> np.ndarray:
    """The states of a chunk's sorted distinct grams; answers: by bucket."""
    out = np.zeros(len(keys), np.uint8)
    for b, i, j in split(keys, bits):
        out[i:j] = np.frombuffer(unsqueeze(answers[b]), np.uint8)
    return out
