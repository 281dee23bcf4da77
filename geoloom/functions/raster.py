"""Algorithms on single rasters and height samples: numpy on one tile or group at a time."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable

import numpy as np

from geoloom.functions.lines import Line, in_ring, nearest_on_ring, simplify


class BoundedCache:
    """Keeps the results of a loader for the keys used last."""

    def __init__(self, load: Callable, most: int = 300):
        self.load, self.most, self.held = load, most, OrderedDict()

    def __call__(self, key):
        if key not in self.held:
            self.held[key] = self.load(key)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]


def bilinear(pixels: np.ndarray, x: float, y: float) -> np.ndarray:
    """Value at a place between pixel centres, clamped to the image."""
    h, w = pixels.shape[:2]
    x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
    i, j = min(int(x), w - 2) if w > 1 else 0, min(int(y), h - 2) if h > 1 else 0
    u, v = x - i, y - j
    a, b = pixels[j, i] * (1 - u) + pixels[j, min(i + 1, w - 1)] * u, pixels[min(j + 1, h - 1), i] * (1 - u) + pixels[min(j + 1, h - 1), min(i + 1, w - 1)] * u
    return a * (1 - v) + b * v


def sobel(gray: np.ndarray, metres: float = 1.0) -> np.ndarray:
    """Gradient magnitude per metre; edges replicated."""
    p = np.pad(gray.astype(float), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gz = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return np.hypot(gx, gz) / 8 / metres


def edge_rise(gray: np.ndarray, metres: float = 1.0, least: float = 20.0) -> float | None:
    """Median width in metres of 10 to 90 % of monotone steps along rows; null without steps."""
    widths = []
    for row in gray.astype(float):
        d = np.sign(np.diff(row))
        start = 0
        for k in range(1, len(d) + 1):
            if k == len(d) or d[k] != d[start]:
                step = row[start : k + 1]
                if d[start] and abs(step[-1] - step[0]) >= least:
                    t = np.abs(step - step[0]) / abs(step[-1] - step[0])
                    widths.append(np.interp(0.9, t, np.arange(len(t))) - np.interp(0.1, t, np.arange(len(t))))
                start = k
    return float(np.median(widths)) * metres if widths else None


def best_shift(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, int, float]:
    """(dx, dz, correlation) of the shift of b that fits a best; of equal ones the smallest."""
    best = (0, 0, -2.0)
    h, w = a.shape
    for dz in sorted(range(-reach, reach + 1), key=abs):
        for dx in sorted(range(-reach, reach + 1), key=abs):
            x = a[max(dz, 0) : h + min(dz, 0), max(dx, 0) : w + min(dx, 0)].astype(float)
            y = b[max(-dz, 0) : h + min(-dz, 0), max(-dx, 0) : w + min(-dx, 0)].astype(float)
            x, y = x - x.mean(), y - y.mean()
            n = math.sqrt((x * x).sum() * (y * y).sum())
            c = float((x * y).sum() / n) if n else -1.0
            if c > best[2] + 1e-12:
                best = (dx, dz, c)
    return best


def largest_blob(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected region; of equal ones the first."""
    label, best = np.zeros(mask.shape, int), (0, 0)
    for seed in zip(*np.nonzero(mask)):
        if label[seed]:
            continue
        k, todo, size = label.max() + 1, [seed], 0
        label[seed] = k
        while todo:
            r, c = todo.pop()
            size += 1
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not label[q]:
                    label[q] = k
                    todo.append(q)
        best = max(best, (size, -k))
    return (label == -best[1]) & mask


def dilate(mask: np.ndarray) -> np.ndarray:
    """3 x 3 dilation."""
    p = np.pad(mask, 1)
    out = np.zeros_like(mask)
    for a in range(3):
        for b in range(3):
            out |= p[a : a + mask.shape[0], b : b + mask.shape[1]]
    return out


def outlines(mask: np.ndarray) -> list[Line]:
    """Closed contours halfway between inside and outside pixels, by marching squares."""
    p = np.pad(mask, 1)
    follow: dict[tuple, list[tuple]] = {}
    mids = {"t": (0.5, 0.0), "r": (1.0, 0.5), "b": (0.5, 1.0), "l": (0.0, 0.5)}
    for r in range(p.shape[0] - 1):
        for c in range(p.shape[1] - 1):
            tl, tr, br, bl = p[r, c], p[r, c + 1], p[r + 1, c + 1], p[r + 1, c]
            sides = [s for s, a, b in (("t", tl, tr), ("r", tr, br), ("b", br, bl), ("l", bl, tl)) if a != b]
            pairs = [sides] if len(sides) == 2 else ([["t", "l"], ["b", "r"]] if tl else [["t", "r"], ["b", "l"]]) if sides else []
            for a, b in pairs:
                x, y = ((c + mids[s][0], r + mids[s][1]) for s in (a, b))
                follow.setdefault(x, []).append(y)
                follow.setdefault(y, []).append(x)
    loops, seen = [], set()
    for start in follow:
        if start in seen:
            continue
        loop, here = [start], start
        seen.add(start)
        while (step := next((q for q in follow[here] if q not in seen), None)) is not None:
            loop.append(step)
            seen.add(step)
            here = step
        loops.append(loop)
    return loops


def trace(mask: np.ndarray, tolerance: float = 0.7) -> Line:
    """Outline of the largest blob, thickened by a pixel and simplified; empty without one."""
    loops = outlines(dilate(largest_blob(mask)))
    return simplify(max(loops, key=len), tolerance) if loops else []


def scale_bar(row: np.ndarray, metres: float, ticks: int = 4, spread: float = 0.06, bright: float = 128.0) -> float | None:
    """Metres per pixel from evenly spaced bright ticks in a row of brightness, a known distance apart."""
    on = np.diff(np.concatenate([[0], (row > bright).astype(int), [0]]))
    middle = (np.flatnonzero(on == 1) + np.flatnonzero(on == -1) - 1) / 2
    for n in range(len(middle), ticks - 1, -1):
        for k in range(len(middle) - n + 1):
            gaps = np.diff(middle[k : k + n])
            if gaps.max() - gaps.min() <= spread * gaps.mean():
                return float(metres / gaps.mean())
    return None


def reproject(pixels: np.ndarray, to_source: Callable[[float, float], tuple[float, float]], width: int, height: int, k: int = 2, ring: Line | None = None, fallback: float = 0.0) -> np.ndarray:
    """Each target pixel is the mean of k x k places looked up in the source; outside the ring or the source, the fallback."""
    out = np.full((height, width, *pixels.shape[2:]), fallback)
    for j in range(height):
        for i in range(width):
            if ring and not in_ring(i + 0.5, j + 0.5, ring):
                continue
            spots = [to_source(i + (a + 0.5) / k, j + (b + 0.5) / k) for a in range(k) for b in range(k)]
            spots = [s for s in spots if 0 <= s[0] <= pixels.shape[1] - 1 and 0 <= s[1] <= pixels.shape[0] - 1]
            if spots:
                out[j, i] = np.mean([bilinear(pixels, *s) for s in spots], axis=0)
    return out


def inset_mask(width: int, height: int, ring: Line, inset: float) -> np.ndarray:
    """Pixels whose centre is inside the ring and at least the inset from its outline."""
    return np.array([[in_ring(i + 0.5, j + 0.5, ring) and nearest_on_ring(i + 0.5, j + 0.5, ring)[0] >= inset for i in range(width)] for j in range(height)])


def roof_levels(z: np.ndarray, base: float, bin_: float = 0.5, near: float = 1.5, share: float = 0.2, apart: float = 2.0, explained: float = 0.7, tight: float = 0.8, times: np.ndarray | None = None) -> list[tuple[float, float]]:
    """(level, share) of a stepped roof, highest first; empty if levels don't explain the samples. times: how often each z stands.

    Peaks of the height histogram are taken by count, those too near one that was taken are passed
    over. Together they must explain most samples, most of those closely.
    """
    up = z - base
    if not len(up):
        return []
    times = np.ones(len(up), int) if times is None else times
    if (up[1:] < up[:-1]).any():
        order = np.argsort(up, kind="stable")
        up, times = up[order], times[order]
    of = lambda some: int(times[some].sum())
    n = int(times.sum())
    k = np.floor(up / bin_).astype(int)
    counts = np.bincount(k - k[0], weights=times).astype(int)
    left, right = np.concatenate([[0], counts[:-1]]), np.concatenate([counts[1:], [0]])
    peaks = np.flatnonzero((counts >= left) & (counts > right))
    peaks = peaks[np.argsort(-counts[peaks], kind="stable")]
    levels = (peaks + k[0] + 0.5) * bin_
    # Samples near each level, as a range of the sorted ones; a difference may round to near just outside the range.
    slack = 1e-9
    inner = np.searchsorted(up, levels - near + slack), np.searchsorted(up, levels + near - slack, "right")
    outer = np.searchsorted(up, levels - near - slack), np.searchsorted(up, levels + near + slack, "right")
    upto = np.concatenate([[0], np.cumsum(times)])
    within = upto[inner[1]] - upto[inner[0]]
    for q in np.flatnonzero((inner[0] != outer[0]) | (inner[1] != outer[1])):
        for a, b in ((outer[0][q], inner[0][q]), (inner[1][q], outer[1][q])):
            within[q] += sum(int(times[m]) for m in range(a, b) if abs(up[m] - levels[q]) <= near)
    taken: list[tuple[float, float]] = []
    for q in np.flatnonzero(within / n >= share).tolist():
        if all(abs(levels[q] - t) >= apart for t, _ in taken):
            taken.append((levels[q], int(within[q]) / n))
    if not taken:
        return []
    distance = np.min([np.abs(up - t) for t, _ in taken], axis=0)
    told = distance <= near
    if of(told) / n < explained or of(told & (distance <= near * 2 / 3)) / of(told) < tight:
        return []
    return sorted(taken, reverse=True)


def subdivide(a, b, c, height: Callable[[float, float], float], sag: float = 0.1, least: float = 1.5, depth: int = 6) -> int:
    """Number of triangles a triangle on a surface falls into: split at its longest edge until it lies close."""
    edges = sorted(((math.dist(p, q), p, q, r) for p, q, r in ((a, b, c), (b, c, a), (c, a, b))), reverse=True)
    length, p, q, r = edges[0]
    mid = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    off = max(abs(height((u[0] + v[0]) / 2, (u[1] + v[1]) / 2) - (height(*u) + height(*v)) / 2) for _, u, v, _ in edges)
    if off <= sag or length <= least or depth == 0:
        return 1
    return subdivide(p, mid, r, height, sag, least, depth - 1) + subdivide(mid, q, r, height, sag, least, depth - 1)


# Facilities: line markings from the sports' published dimensions, in metres around the middle


def _box(w: float, h: float, cx: float = 0.0, cz: float = 0.0) -> Line:
    return [(cx - w / 2, cz - h / 2), (cx + w / 2, cz - h / 2), (cx + w / 2, cz + h / 2), (cx - w / 2, cz + h / 2), (cx - w / 2, cz - h / 2)]


def _arc(cx: float, cz: float, radius: float, a0: float, a1: float, n: int = 24) -> Line:
    return [(cx + radius * math.cos(a0 + (a1 - a0) * k / n), cz + radius * math.sin(a0 + (a1 - a0) * k / n)) for k in range(n + 1)]


def pitch() -> list[Line]:
    return [_box(105, 68), [(0, -34), (0, 34)], _arc(0, 0, 9.15, 0, 2 * math.pi), *(_box(w, h, s * (52.5 - w / 2)) for s in (-1, 1) for w, h in ((16.5, 40.32), (5.5, 18.32)))]


def tennis() -> list[Line]:
    return [_box(23.77, 10.97), _box(23.77, 8.23), [(-6.4, -4.115), (-6.4, 4.115)], [(6.4, -4.115), (6.4, 4.115)], [(-6.4, 0), (6.4, 0)]]


def basketball() -> list[Line]:
    return [_box(28, 15), [(0, -7.5), (0, 7.5)], _arc(0, 0, 1.8, 0, 2 * math.pi), *(_box(5.8, 4.9, s * 11.1) for s in (-1, 1))]


def track(lanes: int = 8, straight: float = 84.39, inner: float = 36.5, lane: float = 1.22) -> list[Line]:
    return [[*_arc(straight / 2, 0, r, -math.pi / 2, math.pi / 2), *_arc(-straight / 2, 0, r, math.pi / 2, 3 * math.pi / 2), (straight / 2, -r)] for r in (inner + lane * k for k in range(lanes + 1))]


FACILITIES: dict[str, Callable[[], list[Line]]] = {"pitch": pitch, "tennis": tennis, "basketball": basketball, "track": track}


def refine(objective: Callable[[float, float], float], seeds: list[tuple[float, float]], step: float = 64.0, least: float = 1.0) -> tuple[float, float]:
    """The best seed, then coordinate steps that halve when none helps."""
    best = max(((objective(*s), s) for s in seeds), key=lambda t: t[0])
    while step >= least:
        x, z = best[1]
        top = max(((objective(x + a * step, z + b * step), (x + a * step, z + b * step)) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))), key=lambda t: t[0])
        step, best = (step, top) if top[0] > best[0] else (step / 2, best)
    return best[1]
