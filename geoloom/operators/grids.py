"""Regular grids as long tables (c, r, v): rasterising, sampling, filling and region growing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry
from geoloom.functions.numeric import half_up
from geoloom.session import discard, materialize


def lattice_join(left: DataFrame, left_head: dict, right: DataFrame, right_head: dict) -> DataFrame:
    """Joins two grids by cell, only if their headers agree in every field; else the right side is null."""
    same = left_head == right_head
    return left.join(right if same else right.where(F.lit(False)), ["c", "r"], "left")


def finest_chunk(points: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The finest chunk (zoom, s, i, j), half-open, that holds each point: one equi-join for all sizes together."""
    sizes = [tuple(row) for row in chunks.select("zoom", "s").distinct().collect()]  # one row for each zoom
    spots = F.array(*[F.struct(F.lit(zoom).alias("zoom"), F.floor(F.col("x") / s).cast("int").alias("i"), F.floor(F.col("z") / s).cast("int").alias("j")) for zoom, s in sizes])
    d = points.withColumn("_s", F.explode(spots)).select(*points.columns, "_s.zoom", "_s.i", "_s.j").join(chunks, ["zoom", "i", "j"])
    return d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("zoom")))).where("_k = 1").drop("_k")


def tiles_touching(rings: DataFrame, size: float, margin: float, low: int, high: int) -> DataFrame:
    """A row for each tile (i, j) that a ring's padded bounds touch, the edges included."""
    d = rings.withColumn("_b", geometry.bounds(F.col("ring"), margin))
    span = lambda a, b: F.sequence(F.greatest(F.ceil(F.col(a) / size) - 1, F.lit(low)).cast("int"), F.least(F.floor(F.col(b) / size), F.lit(high)).cast("int"))
    return d.withColumn("i", F.explode(span("_b.x0", "_b.x1"))).withColumn("j", F.explode(span("_b.z0", "_b.z1"))).drop("_b")


def neighbours(df: DataFrame, reach: int = 1, corners: bool = True) -> DataFrame:
    """A row for each cell and each place around it: (c, r) of the place, the cell as c0, r0 and its other columns."""
    offsets = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a or b) and (corners or not (a and b))]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    d = df.withColumnsRenamed({"c": "c0", "r": "r0"}).withColumn("_o", F.explode(steps))
    return d.withColumn("c", F.col("c0") + F.col("_o.a")).withColumn("r", F.col("r0") + F.col("_o.b")).drop("_o")


def whole_grid(spark, cols: int, rows: int) -> DataFrame:
    return spark.range(cols * rows).select((F.col("id") % cols).cast("int").alias("c"), F.floor(F.col("id") / cols).cast("int").alias("r"))


def sample_bilinear(points: DataFrame, grid: DataFrame, cell: float, cols: int, rows: int) -> DataFrame:
    """points with v, interpolated between the four cells around them; clamped to the grid's edge.

    The grid is joined once: a cell row carries its right, lower and diagonal neighbours.
    """
    g = grid.select("c", "r", F.col("v").cast("double").alias("v"))
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1))])
    four = g.withColumn("_o", F.explode(corner)).groupBy((F.col("c") - F.col("_o.a")).alias("_c"), (F.col("r") - F.col("_o.b")).alias("_r"))
    at = lambda a, b: F.max(F.when((F.col("_o.a") == a) & (F.col("_o.b") == b), F.col("v")))
    four = four.agg(at(0, 0).alias("v00"), at(1, 0).alias("v10"), at(0, 1).alias("v01"), at(1, 1).alias("v11"))
    gx, gz = F.least(F.greatest(F.col("x") / cell, F.lit(0.0)), F.lit(float(cols - 1))), F.least(F.greatest(F.col("z") / cell, F.lit(0.0)), F.lit(float(rows - 1)))
    p = points.withColumn("_c", F.least(F.floor(gx), F.lit(cols - 2)).cast("int")).withColumn("_r", F.least(F.floor(gz), F.lit(rows - 2)).cast("int")).withColumn("_u", gx - F.col("_c")).withColumn("_w", gz - F.col("_r"))
    v = geometry.bilinear(F.col("v00"), F.col("v10"), F.col("v01"), F.col("v11"), F.col("_u"), F.col("_w"))
    return p.join(four, ["_c", "_r"], "left").withColumn("v", v)


def drawn_surface(v00: Column, v10: Column, v01: Column, v11: Column, u: Column, w: Column) -> Column:
    """Height of the drawn pair of triangles, split along the diagonal from (1, 0) to (0, 1)."""
    low = v00 + (v10 - v00) * u + (v01 - v00) * w
    high = v11 + (v01 - v11) * (1 - u) + (v10 - v11) * (1 - w)
    return F.when(u + w <= 1, low).otherwise(high)


def sample_nearest(points: DataFrame, grid: DataFrame, cell: float) -> DataFrame:
    """points with v of the nearest cell (half up); null where there is none."""
    at = lambda c: F.floor(F.col(c) / cell + 0.5).cast("int")
    return points.withColumn("_c", at("x")).withColumn("_r", at("z")).join(grid.select(F.col("c").alias("_c"), F.col("r").alias("_r"), "v"), ["_c", "_r"], "left").drop("_c", "_r")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Cells of either grid; over wins."""
    o = over.select("c", "r", F.col("v").alias("_o"))
    return base.select("c", "r", "v").join(o, ["c", "r"], "full_outer").select("c", "r", F.coalesce("_o", "v").alias("v"))


def fill_holes(grid: DataFrame, cols: int, rows: int, passes: int = 64, digits: int = 2) -> DataFrame:
    """Fills empty cells by passes of 8-neighbour means, each from the pass before; what is left gets the median.

    Only the frontier moves. A cell that a pass leaves empty has no filled neighbour, so the next pass
    needs only the cells filled last; and those next to them were filled in the last two passes or
    are empty.
    """
    spark = grid.sparkSession
    layers = [materialize(grid.select("c", "r", F.col("v").cast("double").alias("v"), F.lit(0).alias("pass")), "filled")]
    for k in range(1, passes + 1):
        near = neighbours(layers[-1].select("c", "r", "v")).where((F.col("c") >= 0) & (F.col("c") < cols) & (F.col("r") >= 0) & (F.col("r") < rows))
        new = near.join(reduce(DataFrame.unionByName, layers[-2:]).select("c", "r"), ["c", "r"], "left_anti").groupBy("c", "r").agg(half_up(F.sum(F.floor(F.col("v") * 10**digits + 0.5)) / F.count(F.lit(1)), 0).alias("s"))
        new = materialize(new.select("c", "r", (F.col("s") / 10**digits).alias("v"), F.lit(k).alias("pass")), "fill")
        if new.isEmpty():
            discard(new)
            break
        layers.append(new)
    filled = materialize(reduce(DataFrame.unionByName, layers), "filled")
    discard(*layers)
    from geoloom.operators.aggregates import histogram_percentiles

    median = histogram_percentiles(filled, [], "v", {"m": 0.5}, float(10**digits))
    rest = whole_grid(spark, cols, rows).join(filled, ["c", "r"], "left_anti").join(F.broadcast(median), how="cross") if filled.count() < cols * rows else None
    return filled if rest is None else filled.unionByName(rest.select("c", "r", F.col("m").alias("v"), F.lit(-1).alias("pass")))


def grow_labels(cells: DataFrame, corners: bool = False) -> DataFrame:
    """(c, r, label): connected components of cells; label is the component's smallest r * 2**20 + c.

    Labels shrink to their neighbours' minimum and then jump to their label's own label, so rounds
    follow the logarithm of a component's extent rather than the extent.
    """
    code = F.col("r").cast("long") * (1 << 20) + F.col("c")
    now = materialize(cells.select("c", "r", code.alias("cell"), code.alias("label")), "labels")
    links = materialize(neighbours(now.select("c", "r", "cell"), 1, corners).join(now.select("c", "r", F.col("cell").alias("other")), ["c", "r"]).select("cell", "other"), "links")
    while True:
        near = links.join(now.select(F.col("cell").alias("other"), F.col("label").alias("l2")), "other").groupBy("cell").agg(F.min("l2").alias("l2"))
        low = now.join(near, "cell", "left").select("c", "r", "cell", F.col("label").alias("old"), F.least("label", F.coalesce("l2", "label")).alias("label"))
        jump = low.select(F.col("cell").alias("label"), F.col("label").alias("l3"))
        new = materialize(low.join(jump, "label", "left").select("c", "r", "cell", "old", F.least("label", F.coalesce("l3", "label")).alias("label")), "labels")
        same = new.where("old <> label").isEmpty()
        discard(now)
        now = new
        if same:
            break
    return now.select("c", "r", "label")


def distance_band(sources: DataFrame, cells: DataFrame, steps: int, corners: bool = False) -> DataFrame:
    """(c, r, d): cells by their distance in steps from the nearest source, up to so many: a frontier join each."""
    reached = materialize(sources.select("c", "r", F.lit(0).alias("d")), "band")
    frontier = reached
    for k in range(1, steps + 1):
        new = neighbours(frontier.select("c", "r"), 1, corners).select("c", "r").distinct().join(cells.select("c", "r"), ["c", "r"], "left_semi").join(reached.select("c", "r"), ["c", "r"], "left_anti")
        frontier = materialize(new.withColumn("d", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        reached = materialize(reached.unionByName(frontier), "band")
    return reached


def box_blur(grid: DataFrame, radius: int, cols: int, rows: int) -> DataFrame:
    """Mean over a square window, edges replicated: two passes, one for each axis."""

    def one(df: DataFrame, axis: str, other: str, size: int) -> DataFrame:
        # Each value counts once for each window place that clamps to it.
        at = F.col(axis)
        places = F.sequence(F.when(at == 0, -radius).otherwise(at), F.when(at == size - 1, size - 1 + radius).otherwise(at))
        spread = df.withColumn("_p", F.explode(places)).withColumn("_t", F.explode(F.sequence(F.col("_p") - radius, F.col("_p") + radius))).where((F.col("_t") >= 0) & (F.col("_t") < size))
        return spread.groupBy(other, F.col("_t").cast("int").alias(axis)).agg((F.sum("v") / (2 * radius + 1)).alias("v"))

    return one(one(grid.select("c", "r", "v"), "c", "r", cols), "r", "c", rows).select("c", "r", "v")
