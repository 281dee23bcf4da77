"""Readers: octree points, LAS, int16 grids, palette grids, rasters, paged and cached JSON, status texts, catalogs."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from geoloom.sources.files import read_files

NODATA = -32768


# Octrees of points: a hierarchy table (page, depth, x, y, z, n); n = -1 stands for a page of its own


def node_overlaps(root: tuple[float, float, float], box: tuple[float, float, float, float]) -> F.Column:
    """Whether a node's square meets the box. root: x, y and side of the whole."""
    rx, ry, side = root
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("depth"))
    x, y = F.lit(rx) + F.col("x") * size, F.lit(ry) + F.col("y") * size
    return (x <= box[2]) & (x + size >= box[0]) & (y <= box[3]) & (y + size >= box[1])


def find_nodes(hierarchy: DataFrame, root: tuple[float, float, float], box: tuple[float, float, float, float], max_depth: int) -> DataFrame:
    """Populated nodes that meet the box. Pages are followed level by level; only pages that are needed are joined."""
    pages = hierarchy.where(node_overlaps(root, box) & (F.col("depth") <= max_depth))
    key = F.concat_ws("-", "depth", "x", "y", "z")
    open_ = hierarchy.sparkSession.createDataFrame([("root",)], "page string")
    found = None
    for _ in range(max_depth + 1):
        here = pages.join(open_, "page", "left_semi").withColumn("key", key)
        nodes = here.where("n > 0").select("key", "depth", "x", "y", "z", "n")
        found = nodes if found is None else found.unionByName(nodes)
        open_ = here.where("n = -1").select(F.col("key").alias("page"))
        if open_.isEmpty():
            break
    return found


def depth_report(nodes: DataFrame, area: float) -> DataFrame:
    """Tiles, points and points per square metre down to each depth."""
    from pyspark.sql import Window

    d = nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("points"))
    w = Window.partitionBy(F.lit(0)).orderBy("depth")
    return d.select("depth", "tiles", "points", F.sum("points").over(w).alias("total"), (F.sum("points").over(w) / area).alias("density"))


# LAS


@dataclass(frozen=True)
class LasHeader:
    offset: int
    point_format: int
    record: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]


def las_header(raw: bytes) -> LasHeader:
    """The public header block; little-endian at the fixed offsets of the LAS specification."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, = struct.unpack_from("<I", raw, 96)
    point_format, record, count = struct.unpack_from("<BHI", raw, 104)
    values = struct.unpack_from("<6d", raw, 131)
    return LasHeader(offset, point_format & 0x3F, record, count, values[:3], values[3:])


def las_points(raw: bytes, box: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """x, y, z, class of an uncompressed file's points inside the box, edges included."""
    h = las_header(raw)
    data = np.frombuffer(raw, np.uint8, h.record * h.count, h.offset).reshape(h.count, h.record)
    xyz = np.ascontiguousarray(data[:, :12]).view("<i4").astype(float) * h.scale + h.shift
    cls = data[:, 15] & 0x1F if h.point_format < 6 else data[:, 16]
    out = np.column_stack([xyz, cls])
    if box:
        out = out[(out[:, 0] >= box[0]) & (out[:, 0] <= box[2]) & (out[:, 1] >= box[1]) & (out[:, 1] <= box[3])]
    return out


def las_bytes(points: np.ndarray, scale: float = 0.01) -> bytes:
    """A LAS 1.2 file of point format 0 with these x, y, z, class rows."""
    n = len(points)
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, 0, 0, 0)
    body = np.zeros((n, 20), np.uint8)
    body[:, :12] = np.floor(points[:, :3] / scale + 0.5).astype("<i4").view(np.uint8).reshape(n, 12)
    body[:, 15] = points[:, 3].astype(np.uint8)
    return bytes(head) + body.tobytes()


def read_las(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, fold: Callable | None = None, schema: str = "x double, y double, z double, cls int") -> DataFrame:
    """Points of uncompressed LAS files, a task for each file; fold maps a file's points to other rows without keeping them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                p = las_points(raw.as_py(), box)
                if fold is not None:
                    yield fold(p)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(p[:, 3].astype(np.int32))], ["x", "y", "z", "cls"])

    return read_files(spark, path).select("content").mapInArrow(run, schema)


# Grids and rasters


def read_int16_grid(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """(path, c, r, v) of row-major little-endian int16 grids; NODATA is null."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1)):
                v = np.frombuffer(raw.as_py(), "<i2")
                i = np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(v)), pa.array((i % cols).astype(np.int32)), pa.array((i // cols).astype(np.int32)), pa.array(v, mask=v == NODATA)], ["path", "c", "r", "v"])

    return read_files(spark, path).select("path", "content").mapInArrow(run, "path string, c int, r int, v smallint")


def palette_cells(indices: DataFrame, palette: DataFrame, cols: int, none: int = 255) -> DataFrame:
    """(c, r, colour) of base64 index grids (column b64); the index `none` has no colour. palette: i, colour."""
    raw = indices.select(F.unbase64("b64").alias("raw"))
    cells = raw.select("raw", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - 1)).alias("k"))
    cells = cells.select((F.col("k") % cols).cast("int").alias("c"), F.floor(F.col("k") / cols).cast("int").alias("r"), F.conv(F.hex(F.substring(F.col("raw"), F.col("k") + 1, F.lit(1))), 16, 10).cast("int").alias("i"))
    return cells.join(palette, "i", "left").select("c", "r", F.when(F.col("i") != none, F.col("colour")).alias("colour"))


def ppm_pixels(raw: bytes) -> np.ndarray:
    """Rows x columns x RGB of a binary PPM image."""
    fields, at = [], 2
    while len(fields) < 3:
        end = at + 1
        while raw[end] not in b" \n\t\r":
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    return np.frombuffer(raw, np.uint8, fields[0] * fields[1] * 3, at + 1).reshape(fields[1], fields[0], 3)


def ppm_bytes(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, col, row, red, green, blue): a long pixel table, a task for each image."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1)):
                p = ppm_pixels(raw.as_py())
                r, c = np.indices(p.shape[:2])
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * r.size), pa.array(c.ravel().astype(np.int32)), pa.array(r.ravel().astype(np.int32)), *(pa.array(p[:, :, k].ravel().astype(np.int32)) for k in range(3))], ["path", "col", "row", "red", "green", "blue"])

    return read_files(spark, path).select("path", "content").mapInArrow(run, "path string, col int, row int, red int, green int, blue int")


# Paged, retried and cached sources


class PagedSource(DataSource):
    """Rows of a paged service, a partition for each page. Options: fetch (module:function), total, page, schema.

    fetch(offset, count) gives an iterable of tuples; here offline functions stand in for services.
    """

    @classmethod
    def name(cls) -> str:
        return "geoloom_paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.total, self.page = options["fetch"], int(options["total"]), int(options.get("page", 1000))

    def partitions(self):
        return [InputPartition(k) for k in range(0, max(self.total, 1), self.page)]

    def read(self, partition):
        import importlib

        module, _, f = self.fetch.partition(":")
        yield from getattr(importlib.import_module(module), f)(partition.value, min(self.page, self.total - partition.value))


def numbers_page(offset: int, count: int):
    """An offline page for tests: consecutive numbers and their squares."""
    return ((k, k * k) for k in range(offset, offset + count))


def with_failover(mirrors: list[Callable], rounds: int = 2, wait: Callable[[int], None] = lambda k: None):
    """The first mirror's answer that isn't empty; an empty one counts as failure."""
    fault: Exception | None = None
    for k in range(rounds):
        for m in mirrors:
            try:
                if got := m():
                    return got
                fault = ValueError("empty answer")
            except Exception as e:  # noqa: BLE001  any failure moves on to the next mirror
                fault = e
        wait(k)
    raise fault or ValueError("no mirrors")


def quartered(fetch: Callable, box: tuple[float, float, float, float], levels: int = 2) -> list:
    """fetch(box), or where that fails its four quarters', down to so many levels."""
    try:
        return list(fetch(box))
    except Exception:
        if not levels:
            raise
        x0, z0, x1, z1 = box
        mx, mz = (x0 + x1) / 2, (z0 + z1) / 2
        return [row for b in ((x0, z0, mx, mz), (mx, z0, x1, mz), (x0, mz, mx, z1), (mx, mz, x1, z1)) for row in quartered(fetch, b, levels - 1)]


def last_write_wins(elements: DataFrame, keys: list[str], order: str) -> DataFrame:
    return elements.groupBy(*keys).agg(F.max_by(F.struct(*elements.columns), F.col(order)).alias("_e")).select("_e.*")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], refetch: bool = False) -> DataFrame:
    """The Parquet at path, made first if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if refetch or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# Documents and texts


def read_documents(spark: SparkSession, path: str, schema: str, same: str | None = None) -> DataFrame:
    """Whole-file JSON documents; with same, all must agree in that field, or reading them fails."""
    d = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    if same:
        odd = d.agg(F.count_distinct(F.to_json(F.struct(same))).alias("_k"))
        d = d.join(F.broadcast(odd), F.when(F.col("_k") == 1, True).otherwise(F.raise_error(F.lit(f"documents differ in {same}")).cast("boolean"))).drop("_k")  # one row
    return d


def read_catalog(spark: SparkSession, tables: dict[str, tuple[str, str, bool]]) -> dict[str, DataFrame]:
    """Tables by name from (path, schema, required); a missing optional one is empty."""
    out = {}
    for name, (path, schema, required) in tables.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        if not there and required:
            raise FileNotFoundError(path)
        out[name] = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return out


def status_rows(lines: DataFrame, names: list[str], duration: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, suspect) of Markdown table lines (column value): cells by name; lines of another width are suspect.

    A duration like 14m27s becomes minutes.
    """
    bars = lines.where(F.trim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = bars.select("value", F.transform(F.slice(F.split(F.trim("value"), r"\|"), 2, 1000), lambda c: F.trim(c)).alias("cells"))
    good = F.size("cells") == len(names) + 1
    cols = []
    for k, n in enumerate(names):
        c = F.get("cells", F.lit(k))
        if n == duration:
            part = lambda unit: F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(\d+){unit}"), F.lit(1)), F.lit(1)).cast("double"), F.lit(0.0))  # noqa: B023, E731
            c = part("m") + part("s") / 60
        cols.append(c.alias(n))
    return cells.where(good).select(*cols), cells.where(~good).select("value")


def log_events(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """A row for each line (column value) that matches, its groups by name."""
    return lines.where(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, k + 1).alias(n) for k, n in enumerate(names)])


# Registries

PROVIDERS: dict[str, Callable] = {}


def provider(name: str):
    def add(f):
        PROVIDERS[name] = f
        return f

    return add


@provider("squares")
def square_patches(zoom: int, x0: float, z0: float, x1: float, z1: float, side: float = 256.0) -> list[tuple[int, int, int]]:
    """The patches (zoom, i, j) of a range."""
    step = side / 2**zoom
    return [(zoom, i, j) for i in range(int(x0 // step), int(-(-x1 // step))) for j in range(int(z0 // step), int(-(-z1 // step)))]


def plan_patches(spark: SparkSession, name: str, zoom: int, box: tuple[float, float, float, float]) -> DataFrame:
    return spark.createDataFrame(PROVIDERS[name](zoom, *box), "zoom int, i int, j int")


def json_text(document: dict) -> str:
    return json.dumps(document, separators=(",", ":"), sort_keys=True)
