"""Session helpers: the shared folder, lineage cuts, shipping the package to executors."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Parquet's writer looks at sizes only after 100 rows by default; with rows of a megabyte, pages and row groups
#: of 100 MB and more came of that, and writer, reader and codec each hold one.
_PARQUET = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_shipped: set[str] = set()
_own: list[str] = []


def build_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("geoloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="geoloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one stage, gives Catalyst the true size of the
    table (so that only tables of a checked size are broadcast), and fixes whatever order or
    numbering the rows had.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom-{tag}-{uuid.uuid4().hex}"
    df.write.options(**_PARQUET | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geoloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_geoloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of ended queries, which stay until the driver's JVM collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="geoloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "geoloom_ship.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, Path(_PACKAGE.name) / f.relative_to(_PACKAGE))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
