"""Walk graphs: building them from polylines, bridging gaps and shortest paths."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import discard, materialize


def build_graph(segments: DataFrame, cell: float, steps_cost: float = 3.5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): end points that share a cell become one node; edges go both ways, the cheapest of parallel ones.

    segments: ax, az, bx, bz, and steps (boolean), which make an edge dearer.
    """
    at = lambda c: F.floor(F.col(c) / cell + 0.5).cast("long")
    code = lambda x, z: at(x) * (1 << 24) + at(z)
    d = segments.select(code("ax", "az").alias("src"), code("bx", "bz").alias("dst"), "ax", "az", "bx", "bz", "steps").where("src <> dst")
    ends = d.select(F.col("src").alias("id"), F.col("ax").alias("x"), F.col("az").alias("z")).unionByName(d.select(F.col("dst").alias("id"), F.col("bx").alias("x"), F.col("bz").alias("z")))
    nodes = ends.groupBy("id").agg(F.min(F.struct("x", "z")).alias("p")).select("id", "p.x", "p.z")
    length = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("az") - F.col("bz"), 2))
    one = d.select("src", "dst", (length * F.when(F.col("steps"), steps_cost).otherwise(1.0)).alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return nodes, both.groupBy("src", "dst").agg(F.min("w").alias("w"))


def distances(edges: DataFrame, sources: DataFrame, most: float, rounds: int = 10_000) -> DataFrame:
    """(source, id, d): shortest distances up to most from many sources at once, by frontier relaxation.

    A round joins the nodes that got closer with their edges; it ends when none does.
    """
    best = materialize(sources.select("source", F.col("source").alias("id"), F.lit(0.0).alias("d")), "paths")
    frontier = best
    for _ in range(rounds):
        step = frontier.join(edges, frontier.id == edges.src).select("source", F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d")).where(F.col("d") <= most)
        step = step.groupBy("source", "id").agg(F.min("d").alias("d"))
        old = best.withColumnRenamed("d", "old")
        frontier = materialize(step.join(old, ["source", "id"], "left").where("old IS NULL OR d < old - 1e-9").select("source", "id", "d"), "closer")
        if frontier.isEmpty():
            break
        new = materialize(best.unionByName(frontier).groupBy("source", "id").agg(F.min("d").alias("d")), "paths")
        discard(best)
        best = new
    return best


def shortest_path(nodes: dict[int, tuple[float, float]], edges: dict[int, list[tuple[int, float]]], start: int, goal: int) -> tuple[list[int], float] | None:
    """A* with the straight line as bound; None if there is no way."""
    gx, gz = nodes[goal]
    line = lambda n: math.hypot(nodes[n][0] - gx, nodes[n][1] - gz)
    heap, cost, came = [(line(start), start)], {start: 0.0}, {start: start}
    done: set[int] = set()
    while heap:
        _, n = heapq.heappop(heap)
        if n == goal:
            path = [n]
            while path[-1] != start:
                path.append(came[path[-1]])
            return path[::-1], cost[n]
        if n in done:
            continue
        done.add(n)
        for m, w in edges.get(n, ()):
            c = cost[n] + w
            if c < cost.get(m, math.inf):
                cost[m], came[m] = c, n
                heapq.heappush(heap, (c + line(m), m))
    return None


def route_legs(edges: DataFrame, legs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(leg, pos, id, cost): the shortest path of each leg (leg, start, goal) on the whole graph; no rows where there is no way.

    Frontier relaxation as in distances(), with the node each was reached from; nothing beyond a
    goal's present distance is followed. Paths are then read backwards, a step of all legs a round.
    """
    ends = materialize(legs.select("leg", "start", "goal"), "ends")
    best = materialize(ends.select("leg", F.col("start").alias("id"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("prev")), "legs")
    frontier = best
    for _ in range(rounds):
        step = frontier.select("leg", F.col("id").alias("at"), "d").join(edges, F.col("at") == F.col("src")).select("leg", F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"), F.col("src").alias("prev"))
        step = step.groupBy("leg", "id").agg(F.min(F.struct("d", "prev")).alias("s")).select("leg", "id", "s.d", "s.prev")
        reached = best.join(ends.select("leg", F.col("goal").alias("id")), ["leg", "id"]).select("leg", F.col("d").alias("most"))
        old = best.select("leg", "id", F.col("d").alias("old"))
        step = step.join(old, ["leg", "id"], "left").where("old IS NULL OR d < old - 1e-9").join(reached, "leg", "left").where("most IS NULL OR d <= most")
        frontier = materialize(step.select("leg", "id", "d", "prev"), "closer")
        if frontier.isEmpty():
            break
        new = materialize(best.unionByName(frontier).groupBy("leg", "id").agg(F.min_by(F.struct("d", "prev"), "d").alias("s")).select("leg", "id", "s.d", "s.prev"), "legs")
        discard(best)
        best = new
    at = materialize(ends.select("leg", F.col("goal").alias("id")).join(best, ["leg", "id"]).select("leg", "id", F.lit(0).alias("back"), F.col("d").alias("cost"), "prev"), "paths")
    path = at
    while not (at := at.where("prev IS NOT NULL")).isEmpty():
        on = at.select("leg", F.col("prev").alias("id"), (F.col("back") + 1).alias("back"), "cost").join(best.select("leg", "id", "prev"), ["leg", "id"])
        at = materialize(on.select("leg", "id", "back", "cost", "prev"), "paths")
        new = materialize(path.unionByName(at), "paths")
        discard(path)
        path = new
    length = path.groupBy("leg").agg(F.max("back").alias("last"))
    return path.join(length, "leg").select("leg", (F.col("last") - F.col("back")).alias("pos"), "id", "cost")


def loose_ends(edges: DataFrame) -> DataFrame:
    """Nodes with one neighbour."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select(F.col("src").alias("id"))


def bridge_candidates(nodes: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(id, a, b, t, d): each loose end with all edges a < b not its own whose inside (t of .02 to .98 from a to b) is within reach.

    Equi-join on cells of the reach's size: an edge is in the cells along it, a tip looks at 3 x 3.
    """
    at = lambda k, x, z: nodes.select(F.col("id").alias(k), F.col("x").alias(x), F.col("z").alias(z))
    cell = lambda c: F.floor(c / reach).cast("long")
    tips = loose_ends(edges).join(nodes, "id")
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    tips = tips.withColumn("cx", F.explode(F.transform(near, lambda k: cell(F.col("x")) + k))).withColumn("cz", F.explode(F.transform(near, lambda k: cell(F.col("z")) + k)))
    e = edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(at("a", "ax", "az"), "a").join(at("b", "bx", "bz"), "b")
    e = e.withColumn("cx", F.explode(F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx")))))
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    along = lambda x: F.when(dx == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("ax")) / dx)))
    z0, z1 = F.col("az") + dz * along(F.col("cx") * reach), F.when(dx == 0, F.col("bz")).otherwise(F.col("az") + dz * along((F.col("cx") + 1) * reach))
    e = e.withColumn("cz", F.explode(F.sequence(cell(F.least(z0, z1) - 1e-6), cell(F.greatest(z0, z1) + 1e-6))))
    t = ((F.col("x") - F.col("ax")) * dx + (F.col("z") - F.col("az")) * dz) / (dx * dx + dz * dz)
    pairs = tips.join(e, ["cx", "cz"]).where("id <> a AND id <> b AND (ax <> bx OR az <> bz)").withColumn("t", t).where("t BETWEEN 0.02 AND 0.98")
    d = F.sqrt(F.pow(F.col("x") - F.col("ax") - F.col("t") * dx, 2) + F.pow(F.col("z") - F.col("az") - F.col("t") * dz, 2))
    return pairs.withColumn("d", d).where(F.col("d") <= reach).select("id", "a", "b", "t", "d").distinct()


def _project(p, a, b):
    """(distance, t) of p from the line a to b."""
    dx, dz = b[0] - a[0], b[1] - a[1]
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dz) / (dx * dx + dz * dz) if dx or dz else -1.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dz), t


def enters(p: tuple[float, float], q: tuple[float, float], ring: list) -> bool:
    """Whether the segment p to q crosses the ring or has an end in it."""
    side = lambda a, b, c: (v := (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) and math.copysign(1, v)
    sides = list(zip(ring, [*ring[1:], ring[0]]))
    inside = lambda x, z: sum((a[1] > z) != (b[1] > z) and x < (b[0] - a[0]) * (z - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides) % 2
    return bool(inside(*p) or inside(*q)) or any(side(p, q, a) != side(p, q, b) and side(a, b, p) != side(a, b, q) for a, b in sides)


def _metres_round(nodes: dict, graph: dict, start: int, goal: int, limit: float) -> bool:
    """Whether the cheapest way from start to goal is longer than limit metres, or there is none."""
    heap, done = [(0.0, 0.0, start)], set()
    while heap:
        cost, metres, n = heapq.heappop(heap)
        if n == goal:
            return metres > limit
        if n not in done:
            done.add(n)
            for m, w in graph.get(n, {}).items():
                heapq.heappush(heap, (cost + w, metres + math.dist(nodes[n], nodes[m]), m))
    return True


def apply_bridges(candidates: list[tuple[int, int, int, float, float]], nodes: dict, edges: dict[int, dict[int, float]], walls: dict[int, list], reach: float, detour: float = 5.0) -> list[tuple]:
    """(id, a, b, x, z, d) of the bridges taken: loose ends in order of ids, each judged on the graph with the bridges before it.

    Only the edge nearest to a tip counts, also one a bridge or a split has made; it must still be there, the
    bridge must enter no wall, and the way round to a must be longer than detour times the gap. Edges
    made here have a new node, below zero. nodes and edges are changed.
    """
    of: dict[int, list] = {}
    for k, a, b, _, d in candidates:
        of.setdefault(k, []).append((d, a, b))
    made, taken = [], []
    tips = sorted(k for k, v in edges.items() if len(v) == 1) if candidates else []
    for tip in tips:
        best = min(of.get(tip, []), default=None)
        for a, b in made:
            d, t = _project(nodes[tip], nodes[a], nodes[b])
            if tip not in (a, b) and 0.02 <= t <= 0.98 and d <= reach and (best is None or d < best[0]):
                best = (d, a, b)
        if best is None or best[2] not in edges.get(best[1], {}):
            continue
        d, a, b = best
        t = _project(nodes[tip], nodes[a], nodes[b])[1]
        foot = tuple(nodes[a][i] + t * (nodes[b][i] - nodes[a][i]) for i in (0, 1))
        if any(enters(nodes[tip], foot, ring) for ring in walls.get(tip, [])) or not _metres_round(nodes, edges, tip, a, detour * d):
            continue
        mid = -1 - len(taken)
        nodes[mid] = foot
        del edges[a][b], edges[b][a]
        for end in (a, b, tip):
            edges.setdefault(end, {})[mid] = edges.setdefault(mid, {})[end] = math.dist(nodes[end], foot)
            made.append((end, mid))
        taken.append((tip, a, b, *foot, d))
    return taken


def bridge_gaps(nodes: DataFrame, edges: DataFrame, rings: DataFrame, reach: float, detour: float = 5.0) -> DataFrame:
    """(id, a, b, x, z, d): bridges from loose ends to x, z inside of the edges a to b. rings: walls that none may enter.

    Candidates and walls near tips come from joins; the sequential acceptance runs on the driver,
    which reads the graph only if there are candidates.
    """
    from geoloom.operators.spatial import ring_distance_join

    spark = nodes.sparkSession
    nodes, edges = materialize(nodes, "nodes"), materialize(edges, "edges")
    found = [] if loose_ends(edges).isEmpty() else [tuple(c) for c in bridge_candidates(nodes, edges, reach).collect()]
    rows: list[tuple] = []
    if found:
        walls: dict[int, list] = {}
        tips = loose_ends(edges).join(nodes, "id").select("id", "x", "z")
        for k, ring in ring_distance_join(tips, rings.select("ring"), reach).select("id", "ring").collect():
            walls.setdefault(k, []).append([tuple(p) for p in ring])
        graph: dict[int, dict[int, float]] = {}
        for a, b, w in edges.select("src", "dst", "w").toLocalIterator():
            graph.setdefault(a, {})[b] = w
        rows = apply_bridges(found, {k: (x, z) for k, x, z in nodes.select("id", "x", "z").toLocalIterator()}, graph, walls, reach, detour)
    discard(nodes, edges)
    return spark.createDataFrame(rows, "id long, a long, b long, x double, z double, d double")


def accept_bridges(candidates: list[tuple[int, int, float]], edges: dict[int, list[tuple[int, float]]], nodes: dict[int, tuple[float, float]], detour: float = 5.0) -> list[tuple[int, int, float]]:
    """Candidates by length, each judged on the graph with those before it: taken if the way round is too long."""
    graph, taken = {k: list(v) for k, v in edges.items()}, []
    for a, b, d in sorted(candidates, key=lambda c: (c[2], c[0], c[1])):
        way = shortest_path(nodes, graph, a, b)
        if way is None or way[1] > detour * d:
            taken.append((a, b, d))
            graph.setdefault(a, []).append((b, d))
            graph.setdefault(b, []).append((a, d))
    return taken
