"""Working tables and files in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is this
machine, as in tests, a temporary folder is set in its place; on a cluster that is an error.

What is made within a ``scope`` is deleted when the scope ends, but for what is kept for its result; that
goes with the scope around it, or at the end of the program.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Folders of each scope that is open, the outermost first.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def shared(spark: SparkSession) -> str:
    """The shared folder's URI."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def token() -> str:
    """A new name part."""
    return uuid.uuid4().hex[:12]


def folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; nothing is there yet. Kept, it outlives the innermost scope."""
    path = f"{shared(spark)}/memspark-{token()}-{name}"
    _made.append((spark, path))
    open_ = _scopes.get()[: -1 if keep else None]
    if open_:
        open_[-1].append(path)
    return path


#: Rows of texts that a Python worker gets at a time while a scope is open.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Deletes the folders made inside and not kept.

    Jobs inside hand texts to Python in smaller batches, which take less memory on either side.
    """
    inside: list[str] = []
    before, rows = _scopes.set((*_scopes.get(), inside)), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, rows)
        _scopes.reset(before)
        for path in inside:
            with contextlib.suppress(Exception):  # already gone
                remove(spark, path)


def saved(df: DataFrame, name: str, keep: bool = False, **sums: Column) -> DataFrame:
    """df as a written table; its lineage ends here.

    Its rows, and other aggregates if asked, are counted while it is written, so that they take no job of their own.
    """
    spark = df.sparkSession
    path = folder(spark, name, keep)
    seen, sums = Observation(), {"rows": F.count(F.lit(1)), **sums}
    df.observe(seen, *[c.alias(k) for k, c in sums.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path, out._seen, out._sums = path, seen, sums
    return out


def noted(df: DataFrame, name: str = "rows") -> int:
    """What was counted while saved() wrote a table."""
    n = df._seen.get.get(name)
    return df.agg(df._sums[name]).first()[0] if n is None else n


#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 8 << 20


def few(df: DataFrame, row_bytes: int = 64, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its rows, counted, are within the bound; else for a sort-merge join."""
    n = rows if rows is not None else noted(df) if "_seen" in df.__dict__ else df.count()
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with a running number from 0, by an order without ties; no task sees more than its range.

    Ranges are written in order, one file each, so a row's number is its place in the file after the
    rows of the files before it.
    """
    ranges = saved(df.repartitionByRange(order).sortWithinPartitions(order), "ranges")
    meta = ranges.metadataColumn("_metadata")
    part, row = f"_part_{token()}", f"_row_{token()}"
    placed = ranges.select("*", F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1).cast("long").alias(part), meta["row_index"].alias(row))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))  # a row per task
    both = placed.join(F.broadcast(base), part)
    return both.select(*df.columns, (F.col(name) + F.col(row)).alias(name))


def _arrow_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


@contextlib.contextmanager
def opened(uri: str):
    """A file of the shared folder, for reading in a task."""
    fs, path = _arrow_fs(uri)
    with fs.open_input_file(path) as f:
        yield f


@contextlib.contextmanager
def placed(uri: str):
    """A file of the shared folder, for writing in a task; it is in its place once it is whole."""
    fs, path = _arrow_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{token()}.part"
    try:
        with fs.open_output_stream(draft) as f:
            yield f
    except BaseException:
        fs.delete_file(draft)
        raise
    try:
        fs.move(draft, path)
    except OSError:  # some stores don't replace: another attempt of the task has written the same file
        if not fs.get_file_info(path).is_file:
            raise
        fs.delete_file(draft)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by saved(); it must not be read again."""
    remove(df.sparkSession, df._path)


def release() -> None:
    """Delete all that was made."""
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended, or the folder be gone
            remove(spark, path)


atexit.register(release)
