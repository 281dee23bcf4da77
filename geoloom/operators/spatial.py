"""Spatial joins. Each becomes an equi-join on hash cells with the exact test as residual, so Catalyst
shuffles or broadcasts by size and no pair outside a common cell is looked at."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry
from geoloom.session import materialize


def cell_of(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("int")


def ring_cells(rings: DataFrame, size: float, ring: str = "ring", pad: float = 0.0) -> DataFrame:
    """rings with their bounds and a row for each cell these touch when pad is added to them.

    _box says that a ring is an axis-parallel rectangle; _ring is the ring where it isn't, so that the
    rows of boxes stay small. Catalyst takes the result for as large as the table it came from and
    might broadcast it, hence the hint.
    """
    d = rings.withColumn("_b", geometry.bounds(F.col(ring))).withColumn("_box", geometry.is_box(F.col(ring))).withColumn("_ring", F.when(~F.col("_box"), F.col(ring)))
    span = lambda a, b: F.sequence(cell_of(F.col(a) - pad, size), cell_of(F.col(b) + pad, size))
    return d.withColumn("_cx", F.explode(span("_b.x0", "_b.x1"))).withColumn("_cz", F.explode(span("_b.z0", "_b.z1"))).hint("merge")


def in_cell_ring(x: Column, z: Column) -> Column:
    """The even-odd rule for a row of ring_cells; for boxes, which need no loop over edges, by their bounds."""
    box = (x >= F.col("_b.x0")) & (x < F.col("_b.x1")) & (z >= F.col("_b.z0")) & (z < F.col("_b.z1"))
    within = x.between(F.col("_b.x0"), F.col("_b.x1")) & z.between(F.col("_b.z0"), F.col("_b.z1"))
    return within & F.when(F.col("_box"), box).otherwise(geometry.inside(x, z, F.col("_ring")))


def _covers(size: float) -> Column:
    """A row of ring_cells is a box over its whole cell."""
    at = lambda c, n: (F.col(c) + n) * F.lit(size)  # noqa: E731 (n reaches a little beyond the cell, as rounding may)
    return F.col("_box") & (F.col("_b.x0") <= at("_cx", -1e-6)) & (F.col("_b.z0") <= at("_cz", -1e-6)) & (F.col("_b.x1") >= at("_cx", 1 + 1e-6)) & (F.col("_b.z1") >= at("_cz", 1 + 1e-6))


def needed_cells(cells: DataFrame, size: float, order: Column, k: int = 1) -> DataFrame:
    """The rows of ring_cells that can be among the first k rings, in an order, to hold some point of their cell.

    Where k boxes cover a whole cell, rings that come after them are not.
    """
    ordered = cells.withColumn("_order", order)
    full = ordered.where(_covers(size)).select("_cx", "_cz", "_order")
    if k == 1:
        full = full.groupBy("_cx", "_cz").agg(F.min("_order").alias("_last"))
    else:
        full = first_per(full.distinct(), ["_cx", "_cz"], [F.col("_order")], k).withColumnRenamed("_order", "_last")
    return ordered.join(full.hint("merge"), ["_cx", "_cz"], "left").where("_last IS NULL OR _order <= _last").drop("_order", "_last").hint("merge")


def points_in_rings(points: DataFrame, rings: DataFrame, size: float = 16.0, how: str = "inner", x: str = "x", z: str = "z", ring: str = "ring", few: bool = False) -> DataFrame:
    """Points joined to the rings that hold them; a point may be in many. how: inner, left, left_semi or left_anti.

    Columns of the two sides must differ. The bounds are tested before the even-odd rule. A semi or
    anti join needs one of the rings over a cell only, if that covers it.
    few: there are few points a cell, so a semi or anti join takes the rings as they are; to thin them
    out would take longer than the join.
    """
    if how in ("left_semi", "left_anti") and few:
        cells = ring_cells(rings.select(ring), size, ring).drop(ring)
    elif how in ("left_semi", "left_anti"):
        # Rings that cover the cell come first, so where there is one no other stays.
        h = F.xxhash64("_b")
        order = F.when(_covers(size), h.bitwiseOR(F.lit(-(1 << 63)))).otherwise(h.bitwiseAND(F.lit((1 << 63) - 1)))
        cells = needed_cells(ring_cells(rings.select(ring).distinct(), size, ring).drop(ring), size, order)
    else:
        cells = ring_cells(rings, size, ring)
    p = points.withColumn("_px", cell_of(F.col(x), size)).withColumn("_pz", cell_of(F.col(z), size))
    inside = (F.col("_px") == F.col("_cx")) & (F.col("_pz") == F.col("_cz")) & in_cell_ring(F.col(x), F.col(z))
    return p.join(cells, inside, how).drop("_px", "_pz", "_cx", "_cz", "_b", "_box", "_ring")


def first_ring(points: DataFrame, rings: DataFrame, key: str, order: str, size: float = 16.0, x: str = "x", z: str = "z", ring: str = "ring") -> DataFrame:
    """(key, order): of the rings that hold a point, the smallest by order whose order isn't the point's key."""
    cells = needed_cells(ring_cells(rings.select(order, ring), size, ring).drop(ring), size, F.col(order), 2)
    p = points.select(key, x, z).withColumn("_px", cell_of(F.col(x), size)).withColumn("_pz", cell_of(F.col(z), size))
    inside = (F.col("_px") == F.col("_cx")) & (F.col("_pz") == F.col("_cz")) & (F.col(key) != F.col(order)) & in_cell_ring(F.col(x), F.col(z))
    return p.join(cells, inside).groupBy(key).agg(F.min(order).alias(order))


def _kept_from_broadcast(grown: DataFrame, source: DataFrame, factor: int) -> DataFrame:
    """grown with a hint to shuffle it, unless factor times its source is below the broadcast limit.

    Catalyst takes an exploded table for as large as its source, and a Parquet table for as large as its files.
    """
    spark = source.sparkSession
    limit = int(spark._jvm.org.apache.spark.sql.internal.SQLConf.get().autoBroadcastJoinThreshold())
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return grown if size * factor <= limit else grown.hint("merge")


def within_distance(a: DataFrame, b: DataFrame, radius: float, ax: str = "x", az: str = "z", bx: str = "bx", bz: str = "bz", how: str = "inner", on: dict[str, str] | None = None) -> DataFrame:
    """Pairs at most radius apart, with their distance d; cells of the radius' size, b in its 3 x 3 neighbours.

    on: columns of a and of b that must be equal besides.
    """
    left = a.withColumn("_px", cell_of(F.col(ax), radius)).withColumn("_pz", cell_of(F.col(az), radius))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = b.withColumn("_cx", F.explode(F.transform(near, lambda k: cell_of(F.col(bx), radius) + k))).withColumn("_cz", F.explode(F.transform(near, lambda k: cell_of(F.col(bz), radius) + k)))
    right = _kept_from_broadcast(right, b, 9 * 4)
    d2 = (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(az) - F.col(bz)) * (F.col(az) - F.col(bz))
    hit = (F.col("_px") == F.col("_cx")) & (F.col("_pz") == F.col("_cz")) & (d2 <= radius * radius)
    for p, q in (on or {}).items():
        hit = hit & (F.col(p) == F.col(q))
    out = left.join(right, hit, how)
    if how not in ("left_semi", "left_anti"):
        out = out.withColumn("d", F.sqrt(d2))
    return out.drop("_px", "_pz", "_cx", "_cz")


def largest_near(rows: DataFrame, value: str, on: str, radius: float, x: str = "x", z: str = "z") -> DataFrame:
    """rows with near: the largest value of rows with an equal on in the 3 x 3 cells around, all of them less than radius away."""
    size = radius / 3  # the diagonal of two cells is shorter than the radius
    d = rows.withColumn("_cx", cell_of(F.col(x), size)).withColumn("_cz", cell_of(F.col(z), size))
    side = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    top = d.groupBy(on, "_cx", "_cz").agg(F.max(value).alias("near")).withColumn("_cx", side("_cx")).withColumn("_cz", side("_cz")).groupBy(on, "_cx", "_cz").agg(F.max("near").alias("near"))
    return d.join(top.hint("merge"), [on, "_cx", "_cz"], "left").drop("_cx", "_cz")


def hold_apart(rows: DataFrame, radius: float) -> DataFrame:
    """(id, held) for rows name, id, x, z: in the order of ids, one is held unless one of its name that is held lies at most radius away.

    A name's rows pass in order through one task, which remembers the held ones by cells; these lie
    apart, so a cell has few of them however many rows there are.
    """
    limit = radius * radius

    def run(batches):
        now, cells = None, {}
        for batch in batches:
            held = []
            for name, key, x, z in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if name != now:
                    now, cells = name, {}
                free = True
                if name is not None and x is not None and z is not None:
                    cx, cz = math.floor(x / radius), math.floor(z / radius)
                    near = (p for i in (cx, cx - 1, cx + 1) for j in (cz, cz - 1, cz + 1) for p in cells.get((i, j), ()))
                    free = not any((x - bx) * (x - bx) + (z - bz) * (z - bz) <= limit and other < key for other, bx, bz in near)
                    if free:
                        cells.setdefault((cx, cz), []).append((key, x, z))
                held.append(free)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(held, pa.bool_())], ["id", "held"])

    ordered = rows.select("name", "id", "x", "z").repartition("name").sortWithinPartitions("name", "id")
    return ordered.mapInArrow(run, "id long, held boolean")


def first_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first, or k-th, row of each key in a total order."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == k).drop("_n")


def ring_distance_join(points: DataFrame, rings: DataFrame, radius: float, size: float = 16.0, x: str = "x", z: str = "z", ring: str = "ring") -> DataFrame:
    """Points joined to rings that hold them (d = 0) or whose outline is at most radius away."""
    cells = ring_cells(rings, size, ring, radius)
    p = points.withColumn("_px", cell_of(F.col(x), size)).withColumn("_pz", cell_of(F.col(z), size))
    px, pz, b = F.col(x), F.col(z), lambda k: F.col(f"_b.{k}")
    dx, dz = F.greatest(b("x0") - px, F.lit(0.0), px - b("x1")), F.greatest(b("z0") - pz, F.lit(0.0), pz - b("z1"))
    other = F.when(geometry.inside(px, pz, F.col("_ring")), F.lit(0.0)).otherwise(geometry.distance_to_ring(px, pz, F.col("_ring")))
    hit = (F.col("_px") == F.col("_cx")) & (F.col("_pz") == F.col("_cz")) & px.between(b("x0") - radius, b("x1") + radius) & pz.between(b("z0") - radius, b("z1") + radius)
    near = F.when(F.col("_box"), dx * dx + dz * dz <= radius * radius).otherwise(other <= radius)
    return p.join(cells, hit & near).withColumn("d", F.when(F.col("_box"), F.sqrt(dx * dx + dz * dz)).otherwise(other)).drop("_px", "_pz", "_cx", "_cz", "_b", "_box", "_ring")


def solid_top(points: DataFrame, roofs: DataFrame, top: str, size: float = 32.0, large: int = 64) -> DataFrame:
    """points with the tallest roof over them, null in the open.

    Roofs over more than `large` cells would swell the index: they are cut out of it and matched by
    coarse cells, eight times as wide.
    """
    b = geometry.bounds(F.col("ring"))
    span = (cell_of(b["x1"], size) - cell_of(b["x0"], size) + 1) * (cell_of(b["z1"], size) - cell_of(b["z0"], size) + 1)
    d = roofs.withColumn("_span", span)
    small, big = d.where(F.col("_span") <= large), d.where(F.col("_span") > large)
    # Numbers are written, as two evaluations may number rows differently.
    keyed = points if "_id" in points.columns else materialize(points.withColumn("_id", F.monotonically_increasing_id()), "keyed")
    hits = points_in_rings(keyed, small.select("ring", top), size).select("_id", top).unionByName(points_in_rings(keyed, big.select("ring", top), size * 8).select("_id", top))
    return keyed.join(hits.groupBy("_id").agg(F.max(top).alias("top")), "_id", "left")


def guarded_join(rows: DataFrame, sidecar: DataFrame, key: str, expected: int | None) -> DataFrame:
    """Positional sidecar by key, refused as a whole (nulls) unless it was made for as many rows."""
    fits = rows.agg((F.count(F.lit(1)) == F.lit(expected)).alias("_fits"))
    ok = sidecar.join(F.broadcast(fits), F.col("_fits"))  # one row
    return rows.join(ok.drop("_fits"), key, "left")
