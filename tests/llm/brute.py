"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def substrings(docs, window=13):
    """docs: (id, text); a null id comes last."""
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def repeats(docs, window=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def near(docs, k=5, percent=80):
    """docs: (id, text). Rows are nodes; (id, size, smallest id of the component)."""
    sets = []
    for _, t in docs:
        w = words((t or "").encode().translate(LOWER).decode())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(b)] = find(a)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = d if least[r] is None else min(least[r], d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def contamination(docs, items, window=10):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    patterns = defaultdict(set)
    for item, t in items:
        w = cut(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i : i + n])].add(item)
    out = []
    for d, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        out.append((d, len(w), len(hit), sorted(found - {None})))
    return out


def base_secrets(text):
    text = text or ""
    assign = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    access = [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return len(assign), len(access), len(hexes), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(assign + access + hexes)).encode())
