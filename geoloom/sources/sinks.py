"""Sinks, checks of what was written, and differences between builds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.files import write_bytes
from geoloom.sources.readers import NODATA, json_text, ppm_bytes


def write_json(df: DataFrame, path: str, digits: int = 2) -> None:
    """One JSON file, doubles rounded half up; for documents, which are small."""
    from geoloom.functions.numeric import half_up

    kinds = dict(df.dtypes)
    df.select(*[half_up(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]).coalesce(1).write.mode("overwrite").json(path)


def write_int16_grid(grid: DataFrame, path: str, cols: int, rows: int, scale: float = 10.0, **header) -> None:
    """A header file and a binary grid; missing cells are NODATA. A grid's file is bounded by its header."""
    out = np.full(cols * rows, NODATA, "<i2")
    got = grid.where(F.col("v").isNotNull()).select((F.col("r") * cols + F.col("c")).cast("int").alias("i"), F.floor(F.col("v") * scale + 0.5).cast("int").alias("v")).toArrow()
    out[np.asarray(got["i"])] = np.asarray(got["v"])
    write_bytes(grid.sparkSession, f"{path}/header.json", json_text({"cols": cols, "rows": rows, "nodata": NODATA, "scale": scale} | header).encode())
    write_bytes(grid.sparkSession, f"{path}/grid.bin", out.tobytes())


def write_raster(pixels: DataFrame, path: str, width: int, height: int) -> None:
    """One image of (col, row, red, green, blue)."""
    got = pixels.select("col", "row", "red", "green", "blue").toArrow().to_pydict()
    out = np.zeros((height, width, 3), np.uint8)
    out[got["row"], got["col"]] = np.column_stack([got["red"], got["green"], got["blue"]])
    write_bytes(pixels.sparkSession, path, ppm_bytes(out))


def expectations(df: DataFrame, rules: dict[str, tuple[Column, str, float]]) -> DataFrame:
    """(rule, ok, observed, gate): one pass over df for all rules. A rule is (aggregate, operator, gate)."""
    tests = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}
    one = df.agg(*[a.cast("double").alias(n) for n, (a, _, _) in rules.items()])
    rows = [F.struct(F.lit(n).alias("rule"), F.coalesce(tests[op](F.col(n), F.lit(gate)), F.lit(False)).alias("ok"), F.col(n).alias("observed"), F.lit(float(gate)).alias("gate")) for n, (_, op, gate) in rules.items()]
    return one.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def differences(new: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ, or that only one side has."""
    d = new.select(*keys, F.col(value).alias("new")).join(old.select(*keys, F.col(value).alias("old")), keys, "full_outer")
    return d.where(~F.col("new").eqNullSafe(F.col("old")))


def within_allowance(diff: DataFrame, allowed: int) -> DataFrame:
    return diff.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(allowed).alias("allowed"), (F.col("n") <= allowed).alias("ok"))
