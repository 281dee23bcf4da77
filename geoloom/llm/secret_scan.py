"""Secret scan with multipart credential linking.

Strong kinds (assign, access, hex) are reported wherever they stand. Weak parts (a bare 40-character
key, a user or client name, an endpoint) mean little alone; they are reported only when parts that
complete them stand in the same scope. Parts are intervals; a scope is an interval grown by
SCOPE_CHARS on either side and cut at blank lines, and an interval join within the document (sorted
by start, swept once) finds which parts meet.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.kernels import joined, pieces, release, runs, text_arrays
from geoloom.session import ship_package

SCOPE_CHARS = 200
PIECE_BYTES = 4 << 20
KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_USER = re.compile(rb"""\b(?:user|username|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I)
#: An endpoint from its :// on; the scheme before it is found backwards, so that long words cost no more than others.
_ENDPOINT = re.compile(rb"://[A-Za-z0-9.-]+(?::[0-9]+)?")
_SCHEME = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789+.-")
_BLANK = re.compile(rb"\n[\x20\t\r]*\n")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_HEX = _table(b"0123456789abcdef")
_KEY = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def _long_runs(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Document -> spans in it of the maximal runs of the table's bytes, at least so long. Documents don't run together."""
    inside = table[buf]
    s, e = runs(inside)
    long = e - s >= least
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(s[long].tolist(), e[long].tolist()):
        d = int(np.searchsorted(offs[1:], a, "right"))
        while a < b:
            stop = min(b, int(offs[d + 1]))
            if stop - a >= least:
                found.setdefault(d, []).append((a - int(offs[d]), stop - int(offs[d])))
            a, d = stop, d + 1
    return found


def _documents_with(buf: np.ndarray, offs: np.ndarray, at: np.ndarray) -> set[int]:
    return set(np.unique(np.searchsorted(offs[1:], at, "right")).tolist()) if len(at) else set()


def link(parts: list[tuple[int, int, str]], text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple]]:
    """(weak parts to report, links) of a document's parts, by an interval join within scopes.

    A link is (secret, identifier or None, endpoint or None), each a part. A key needs an
    identifier or an endpoint in scope, a user name a secret, an endpoint both others.
    """
    role = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "user": "id", "endpoint": "endpoint"}
    parts = sorted(parts)
    blanks = [m.start() for m in _BLANK.finditer(text)] if len(parts) > 1 else []
    by_role: dict[str, list[tuple[int, int, str]]] = {"secret": [], "id": [], "endpoint": []}
    for p in parts:
        by_role[role[p[2]]].append(p)
    starts = {k: [p[0] for p in v] for k, v in by_role.items()}
    longest = {k: max((e - s for s, e, _ in v), default=0) for k, v in by_role.items()}

    def partners(p, kind):
        """The parts of that role in p's scope, nearest first."""
        lo = bisect.bisect_left(blanks, p[0])
        top = blanks[lo] if lo < len(blanks) else len(text)
        bottom = blanks[lo - 1] if lo else -1
        own = by_role[kind]
        first = bisect.bisect_left(starts[kind], p[0] - SCOPE_CHARS - longest[kind])
        last = bisect.bisect_right(starts[kind], p[1] + SCOPE_CHARS)
        gap = lambda q: max(q[0] - p[1], p[0] - q[1])
        return sorted((q for q in own[first:last] if 0 <= gap(q) <= SCOPE_CHARS and bottom < q[0] < top), key=lambda q: (gap(q), q))

    weak, links = [], []
    for p in parts:
        if role[p[2]] == "secret":
            ids, endpoints = partners(p, "id"), partners(p, "endpoint")
            if ids or endpoints:
                links += [(p, i, e) for i in ids or [None] for e in endpoints or [None]]
                if p[2] == "key":
                    weak.append(p)
        elif p[2] == "user" and partners(p, "secret") or p[2] == "endpoint" and partners(p, "secret") and partners(p, "id"):
            weak.append(p)
    return weak, links


def _endpoints(raw: bytes) -> list[tuple[int, int, str]]:
    """scheme://host[:port]; a scheme is the run of its characters before the ://, from the first letter on."""
    found, before = [], 0
    for m in _ENDPOINT.finditer(raw):
        s = m.start()
        while s > before and raw[s - 1] in _SCHEME:
            s -= 1
        while s < m.start() and not 97 <= raw[s] <= 122:
            s += 1
        if s < m.start():
            found.append((s, m.end(), "endpoint"))
            before = m.end()
    return found


def _scan_document(raw: bytes, hexes: list[tuple[int, int]], keys: list[tuple[int, int]], marked: bool) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[tuple]]:
    """(base spans, weak spans, links), byte offsets."""
    base = [(s, e, "hex") for s, e in hexes]
    base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    weak: list[tuple[int, int, str]] = []
    if marked:
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
        weak = [(m.start(), m.end(), "user") for m in _USER.finditer(raw)] + _endpoints(raw)
    inside = sorted((s, e) for s, e, _ in base)
    reach = np.maximum.accumulate([e for _, e in inside]) if inside else []
    for s, e in keys:
        text = raw[s:e]
        k = bisect.bisect_left(inside, (e, 0))
        if e - s == 40 and re.search(rb"[A-Z]", text) and re.search(rb"[a-z]", text) and re.search(rb"[0-9]", text) and not (k and reach[k - 1] > s):
            weak.append((s, e, "key"))
    if not weak and len(base) < 2:
        return base, [], []
    return (base, *link(base + weak, raw))


def _code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> dict[int, int]:
    """The code point at each byte offset where a span begins or ends; one pass over the text."""
    at = np.array(sorted({x for s, e, _ in spans for x in (s, e)}), np.int64)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return dict(zip(at.tolist(), np.add.accumulate([int(np.count_nonzero(lead[a:b])) for a, b in zip([0, *at[:-1].tolist()], at.tolist())], dtype=np.int64).tolist())) if len(at) else {}


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_LINK = pa.list_(pa.struct([("secret", _PART), ("identifier", _PART), ("endpoint", _PART)]))


def _scan(batches):
    for batch in batches:
        data, starts, ends, _ = text_arrays(batch.column(1))
        for i, j in pieces(starts, ends, PIECE_BYTES):
            buf, offs = joined(data, starts, ends, i, j)
            hexes, keys = _long_runs(buf, offs, _HEX, 32), _long_runs(buf, offs, _KEY, 40)
            whole = buf.tobytes()
            marked = _documents_with(buf, offs, np.flatnonzero((buf == 0x3A) | (buf == 0x3D)))
            akia = _documents_with(buf, offs, np.fromiter((m.start() for m in re.finditer(rb"AKIA", whole)), np.int64))
            base_col, extra_col, link_col = [[] for _ in range(j - i)], [[] for _ in range(j - i)], [[] for _ in range(j - i)]
            for d in marked | akia | hexes.keys() | keys.keys():
                raw = whole[offs[d] : offs[d + 1]]
                base, weak, links = _scan_document(raw, hexes.get(d, []), keys.get(d, []), d in marked)
                point = _code_points(raw, base + weak + [p for parts in links for p in parts if p])
                one = lambda p: {"kind": p[2], "start": point[p[0]], "stop": point[p[1]]} if p else None  # noqa: B023, E731
                named = lambda spans: [one(p) for p in sorted(spans, key=lambda p: (p[0], KINDS.index(p[2]), p[1]))]  # noqa: B023, E731
                base_col[d], extra_col[d] = named(base), named(weak)
                link_col[d] = [{"secret": one(s), "identifier": one(a), "endpoint": one(b)} for s, a, b in links]
            release()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(base_col, _SPAN), pa.array(extra_col, _SPAN), pa.array(link_col, _LINK)], ["id", "base", "weak", "links"]
            )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, base, weak (arrays of kind, start, stop in code points, by start then kind) and links.

    A null text is empty and has no spans. Rows are scanned one by one, so repeats, ties and null
    ids stay as they are; other columns are not looked at. An empty table gives an empty result. Texts
    are read whole; time grows in proportion to a text's length and its parts.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    part = "struct<kind:string,start:bigint,stop:bigint>"
    return rows.mapInArrow(_scan, f"id bigint, base {span}, weak {span}, links array<struct<secret:{part},identifier:{part},endpoint:{part}>>").withColumnRenamed("id", id_col)
