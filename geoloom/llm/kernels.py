"""Vectorised byte and word kernels over Arrow text columns.

Texts stay UTF-8 bytes: a batch is one uint8 array plus start and end offsets for each document,
so tokenising, hashing and winnowing cost a few numpy passes instead of a Python loop.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~_SPACE
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and everything beyond ASCII.
ALNUM_LOWER = np.zeros(256, bool)
ALNUM_LOWER[0x30:0x3A] = ALNUM_LOWER[0x61:0x7B] = ALNUM_LOWER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; in place on a fresh uint64 array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def release() -> None:
    """Give freed memory back to the system; allocators otherwise keep what the largest batch needed."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _keys(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_POS = _keys(256, 11)


def _pos_keys(n: int) -> np.ndarray:
    global _POS
    if n > len(_POS):
        _POS = _keys(max(n, 2 * len(_POS)), 11)
    return _POS


def text_arrays(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, valid) of an Arrow string or binary column; a null has no bytes."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    large = column.type in (pa.large_string(), pa.large_binary())
    n = len(column)
    valid = np.asarray(column.is_valid()) if n else np.zeros(0, bool)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64), valid
    off = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = off[:-1].copy(), off[1:].copy()
    ends[~valid] = starts[~valid]
    return data, starts, ends, valid


def pieces(starts: np.ndarray, ends: np.ndarray, limit: int):
    """Ranges (i, j) of rows with at most limit bytes together, or one longer row."""
    i, n = 0, len(starts)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    while i < n:
        j = int(np.searchsorted(size, size[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of rows i to j, one after the other."""
    lens = ends[i:j] - starts[i:j]
    offs = np.concatenate([[0], np.cumsum(lens)])
    if offs[-1] == ends[j - 1] - starts[i]:
        return data[starts[i] : ends[j - 1]], offs
    return np.concatenate([data[starts[x] : ends[x]] for x in range(i, j)]), offs


class Words:
    """The words of a run of documents: byte starts and ends, document index, first word of each document."""

    __slots__ = ("buf", "starts", "ends", "doc", "first", "n")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = False):
        self.buf = buf = _LOWER[buf] if lower else buf
        n = len(offs) - 1
        is_word = table[buf]
        prev = np.empty_like(is_word)
        if len(buf):
            prev[0] = False
            prev[1:] = is_word[:-1]
            cuts = offs[:-1]
            prev[cuts[cuts < len(buf)]] = False
            self.starts = np.flatnonzero(is_word & ~prev)
            prev[-1] = False
            prev[:-1] = is_word[1:]
            cuts = offs[1:] - 1
            prev[cuts[cuts >= 0]] = False
            self.ends = np.flatnonzero(is_word & ~prev) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offs[:-1], self.starts, "right") - 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))]).astype(np.int64)
        self.n = n

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: multilinear over its bytes, then mixed with its length."""
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, U64)
        at = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
        src = pos + np.repeat(self.starts, lens)
        keys = _pos_keys(int(lens.max()))
        return mix(np.add.reduceat((self.buf[src].astype(U64) + U64(1)) * keys[pos], at) + lens.astype(U64) * U64(0xD6E8FEB86659FD93))

    def keyed(self, secret: bytes) -> np.ndarray:
        """A keyed 64-bit digest of each word: distinct words are told apart by their bytes and digested once each."""
        import pyarrow as pa

        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, U64)
        at = np.cumsum(lens) - lens
        src = np.arange(int(lens.sum()), dtype=np.int64) + np.repeat(self.starts - at, lens)
        words = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(np.append(at, lens.sum()).astype(np.int64)), pa.py_buffer(self.buf[src])]).dictionary_encode()
        digests = b"".join([hashlib.blake2b(x, digest_size=8, key=secret).digest() for x in words.dictionary.to_pylist()])
        return np.frombuffer(digests, U64)[np.asarray(words.indices)]

    def remaining(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its document."""
        return self.first[self.doc + 1] - np.arange(len(self.starts))


_GRAM = _keys(4096, 77)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries of h at each place where they fit; the caller masks document ends."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _GRAM[0]
    for j in range(1, k):
        out = out + h[j : j + n] * _GRAM[j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, in log2(w) passes."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def leftmost_minima(gram: np.ndarray, w: int) -> np.ndarray:
    """For each run of w consecutive grams, where its smallest (leftmost of equal) gram is.

    Compared by 40 bits of the hash, with the place in the lower bits; longer arrays go by pieces.
    """
    out, step = [np.zeros(0, np.int64)], (1 << 24) - w
    for a in range(0, len(gram) - w + 1, step):
        part = gram[a : a + step + w - 1]
        key = (part & ~U64(0xFFFFFF)) | np.arange(len(part), dtype=U64)
        out.append((sliding_min(key, w) & U64(0xFFFFFF)).astype(np.int64) + a)
    return np.concatenate(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; several times faster on wide integers than numpy's own."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places the stretches of the given length from each start cover."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    stop = np.bincount(np.minimum(starts + length, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge - stop)[:n] > 0
