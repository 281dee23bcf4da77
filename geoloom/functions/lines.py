"""Algorithms on polylines and rings that need a loop: plain Python on lists of (x, z), wrapped as Arrow-fed UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

Line = list[tuple[float, float]]
LINE = ArrayType(ArrayType(DoubleType()))


def line_udf(f: Callable[[Line], Line]):
    """f over a column of lines, a batch at a time; null stays null."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda v: None if v is None else [[float(a), float(b)] for a, b in f([(p[0], p[1]) for p in v])])

    return run


def convex_hull(points: Line) -> Line:
    """Monotone chain, anticlockwise, without collinear points."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq):
        out: Line = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(reversed(p))


def pad_ring(ring: Line, pad: float, blocked: Callable[[float, float], bool] = lambda x, z: False, step: float = 5.0) -> Line:
    """Vertices moved outwards from the vertex mean by pad, in smaller steps where that is blocked."""
    cx, cz = sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    out = []
    for x, z in ring:
        d = math.hypot(x - cx, z - cz) or 1.0
        reach = pad
        while reach > 0 and blocked(x + (x - cx) / d * reach, z + (z - cz) / d * reach):
            reach -= step
        reach = max(reach, 0.0)
        out.append((x + (x - cx) / d * reach, z + (z - cz) / d * reach))
    return out


def _off_line(p, a, b) -> float:
    dx, dz = b[0] - a[0], b[1] - a[1]
    n = math.hypot(dx, dz)
    return math.hypot(p[0] - a[0], p[1] - a[1]) if n == 0 else abs(dx * (a[1] - p[1]) - dz * (a[0] - p[0])) / n


def simplify(line: Line, tolerance: float) -> Line:
    """Douglas-Peucker with a stack, so long lines don't recurse."""
    if len(line) < 3:
        return line
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        far, at = max(((_off_line(line[k], line[a], line[b]), k) for k in range(a + 1, b)), default=(0.0, -1))
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [line[k] for k in sorted(keep)]


def clip_to_box(ring: Line, x0: float, z0: float, x1: float, z1: float) -> Line:
    """Sutherland-Hodgman against the four sides."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, z0, 1), (1, z1, -1)):
        out: Line = []
        for a, b in zip(ring[-1:] + ring[:-1], ring):
            ia, ib = (a[axis] - bound) * sign >= 0, (b[axis] - bound) * sign >= 0
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
            if ib:
                out.append(b)
        ring = out
        if not ring:
            break
    return ring


def stitch(segments: list[Line]) -> list[Line]:
    """Closed rings of at least four points from pieces that share exact end points, in their order; pieces may be reversed."""
    left, rings = [list(s) for s in segments if len(s) > 1], []
    while left:
        ring = left.pop(0)
        while ring[0] != ring[-1]:
            k = next((k for k, s in enumerate(left) if ring[-1] in (s[0], s[-1])), None)
            if k is None:
                break
            s = left.pop(k)
            ring += s[1:] if s[0] == ring[-1] else s[-2::-1]
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def chaikin(line: Line, rounds: int = 2, blocked: Callable[[float, float], bool] = lambda x, z: False) -> Line:
    """Corner cutting; a corner stays where a cut would land in an obstacle. Ends stay."""
    for _ in range(rounds):
        if len(line) < 3:
            return line
        out = [line[0]]
        for a, b, c in zip(line, line[1:], line[2:]):
            p, q = (a[0] * 0.25 + b[0] * 0.75, a[1] * 0.25 + b[1] * 0.75), (b[0] * 0.75 + c[0] * 0.25, b[1] * 0.75 + c[1] * 0.25)
            out += [b] if blocked(*p) or blocked(*q) else [p, q]
        line = out + [line[-1]]
    return line


def in_ring(x: float, z: float, ring: Line) -> bool:
    inside = False
    for (ax, az), (bx, bz) in zip(ring, ring[1:] + ring[:1]):
        if (az > z) != (bz > z) and x < (bx - ax) * (z - az) / (bz - az) + ax:
            inside = not inside
    return inside


def nearest_on_ring(x: float, z: float, ring: Line) -> tuple[float, float, float]:
    """(distance, x, z) of the outline's nearest point."""
    best = (math.inf, x, z)
    for (ax, az), (bx, bz) in zip(ring, ring[1:] + ring[:1]):
        dx, dz = bx - ax, bz - az
        t = min(1.0, max(0.0, ((x - ax) * dx + (z - az) * dz) / (dx * dx + dz * dz or 1.0)))
        best = min(best, (math.hypot(ax + dx * t - x, az + dz * t - z), ax + dx * t, az + dz * t))
    return best


def push_outside(line: Line, rings: list[Line], clear: float, rounds: int = 2) -> Line:
    """Moves points until they are clear of all rings, as far as so many rounds bring them."""
    out = list(line)
    for _ in range(rounds):
        moved = False
        for k, (x, z) in enumerate(out):
            for ring in rings:
                d, nx, nz = nearest_on_ring(x, z, ring)
                inside = in_ring(x, z, ring)
                if inside or d < clear - 1e-9:
                    ux, uz = ((nx - x), (nz - z)) if inside else ((x - nx), (z - nz))
                    n = math.hypot(ux, uz) or 1.0
                    x, z = nx + ux / n * clear, nz + uz / n * clear
                    moved = True
            out[k] = (x, z)
        if not moved:
            break
    return out


def resample(line: Line, spacing: float) -> Line:
    """Points a chord of spacing apart: where a circle around the last point leaves the line. A tail above half a chord stays."""
    if len(line) < 2:
        return line
    out, here, k, start = [line[0]], line[0], 0, line[0]
    while k < len(line) - 1:
        end = line[k + 1]
        if math.dist(here, end) < spacing:
            k += 1
            start = end
            continue
        dx, dz, fx, fz = end[0] - start[0], end[1] - start[1], start[0] - here[0], start[1] - here[1]
        a, b, c = dx * dx + dz * dz, 2 * (fx * dx + fz * dz), fx * fx + fz * fz - spacing * spacing
        t = (-b + math.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)
        here = start = (start[0] + dx * t, start[1] + dz * t)
        out.append(here)
    if math.dist(here, line[-1]) > spacing / 2:
        out.append(line[-1])
    return out


def _turn(a, b, c) -> float:
    u, v = math.atan2(b[1] - a[1], b[0] - a[0]), math.atan2(c[1] - b[1], c[0] - b[0])
    return abs((v - u + math.pi) % (2 * math.pi) - math.pi)


def relax_turns(line: Line, per_metre: float = math.radians(10), rounds: int = 200) -> Line:
    """Moves corners that turn too sharply towards their neighbours' middle, in place, until none does."""
    out = list(line)
    for _ in range(rounds):
        quiet = True
        for k in range(1, len(out) - 1):
            a, b, c = out[k - 1 : k + 2]
            if _turn(a, b, c) > per_metre * (math.dist(a, b) + math.dist(b, c)) / 2:
                out[k] = ((b[0] + (a[0] + c[0]) / 2) / 2, (b[1] + (a[1] + c[1]) / 2) / 2)
                quiet = False
        if quiet:
            break
    return out


def split_neck(ring: Line, cell: float = 1.0, thin: float = 0.35) -> list[tuple[float, float, float, float]]:
    """Boxes left and right of a thin run in the outline's column profile; one box without such a neck."""
    x0, x1 = min(p[0] for p in ring), max(p[0] for p in ring)
    z0, z1 = min(p[1] for p in ring), max(p[1] for p in ring)
    n, m = max(1, round((x1 - x0) / cell)), max(1, round((z1 - z0) / cell))
    cover = [[j for j in range(m) if in_ring(x0 + (i + 0.5) * cell, z0 + (j + 0.5) * cell, ring)] for i in range(n)]
    most = max(map(len, cover), default=0)
    wide = [len(c) >= thin * most for c in cover]
    blocks, i = [], 0
    while i < n:
        j = i
        while j < n and wide[j] == wide[i]:
            j += 1
        if wide[i] and most:
            rows = [r for c in cover[i:j] for r in c]
            blocks.append((x0 + i * cell, z0 + min(rows) * cell, x0 + j * cell, z0 + (max(rows) + 1) * cell))
        i = j
    return blocks


def tile_ring(ring: Line, size: float, least: float = 3.0) -> list[Line]:
    """The ring cut into squares of a size; pieces under the least area go."""
    x0, x1 = min(p[0] for p in ring), max(p[0] for p in ring)
    z0, z1 = min(p[1] for p in ring), max(p[1] for p in ring)
    out = []
    for i in range(math.floor(x0 / size), math.floor(x1 / size) + 1):
        for j in range(math.floor(z0 / size), math.floor(z1 / size) + 1):
            piece = clip_to_box(ring, i * size, j * size, (i + 1) * size, (j + 1) * size)
            if len(piece) > 2 and abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(piece, piece[1:] + piece[:1]))) / 2 >= least:
                out.append(piece)
    return out


def densify(ring: Line, longest: float) -> Line:
    """Edges cut into equal parts of at most that length."""
    out: Line = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        n = max(1, math.ceil(math.dist(a, b) / longest))
        out += [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(n)]
    return out


def mulberry32(seed: int):
    """The 32-bit generator of that name: an endless stream of numbers in [0, 1). Its constants are fixed values."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def merge_boxes(boxes: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Joins boxes that overlap until none do, in their order."""
    out = list(boxes)
    again = True
    while again:
        again = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                a, b = out[i], out[j]
                if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                    out[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    del out[j]
                    again = True
                    break
            if again:
                break
    return out


def place_greedily(candidates: list[tuple[float, float, str]], spacing: float) -> list[tuple[float, float, str]]:
    """Takes candidates in order unless one of their kind stands closer than spacing; looked up by cells."""
    taken: dict[tuple, list] = {}
    out = []
    for x, z, kind in candidates:
        i, j = math.floor(x / spacing), math.floor(z / spacing)
        near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in taken.get((kind, i + a, j + b), ()))
        if all(math.dist((x, z), p) >= spacing for p in near):
            taken.setdefault((kind, i, j), []).append((x, z))
            out.append((x, z, kind))
    return out
