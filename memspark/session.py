"""What a session needs: the package on its executors, working tables, checked broadcasts, running numbers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []
#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="memspark-ship-"), "memspark_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: spark.checkpoint.dir, or in local tests a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the program; nothing is there yet."""
    path = f"{shared(spark)}/memspark-{uuid.uuid4().hex[:12]}-{name}"
    _made.append((spark, path))
    return path


def saved(df: DataFrame, name: str = "work") -> DataFrame:
    """df as a written table in the shared folder; its lineage ends here."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df, best a saved table, marked for broadcast if its rows, counted, are within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """df with a running number from 0, by an order without ties; no task sees more than its range.

    Ranges are written in order, one file each, so a row's number is its place in the file after the
    rows of the files before it.
    """
    ranges = saved(df.repartitionByRange(*order).sortWithinPartitions(*order), "ranges")
    meta = ranges.metadataColumn("_metadata")
    mark = uuid.uuid4().hex[:8]
    part, row = f"_part_{mark}", f"_row_{mark}"
    placed = ranges.select("*", F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1).cast("long").alias(part), meta["row_index"].alias(row))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))  # a row per task
    return placed.join(F.broadcast(base), part).select(*df.columns, (F.col(name) + F.col(row)).alias(name))


def _forget() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended
            fs, p = file_system(spark, path)
            fs.delete(p, True)


atexit.register(_forget)
