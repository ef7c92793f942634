"""Decisions that travel to the rows of a file scan, so that texts stay where they are.

A row is known by its file and its number in it. Operators first work on narrow tables keyed by that
place; what they find, the marks, is written to the shared folder, in order, a file for each
``CHUNK`` rows of an input file. A later scan of the same input reads, beside its rows, the marks of just
those rows. No text is shuffled for it and nothing is broadcast; a task that runs again reads the same.

Cases: a row may have no mark or many; they come in the order given. A table that isn't a plain scan of
Parquet files is written to the shared folder first. Columns of the input may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from . import text as tx

#: Rows of an input file whose marks share a file.
CHUNK = 1 << 17
FILE, ROW = "file", "row"


def rooted(docs: DataFrame) -> DataFrame:
    """docs as a plain scan of Parquet files; anything else is written first."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
            return docs
    return files.saved(docs, "input")


def place(docs: DataFrame, file: str = FILE, row: str = ROW) -> list:
    """Columns that name the place of each row of a rooted table."""
    meta = docs.metadataColumn("_metadata")
    return [meta["file_path"].alias(file), meta["row_index"].alias(row)]


def _path(folder: str, file: str, chunk: int) -> str:
    name = hashlib.md5(file.encode()).hexdigest()
    return f"{folder}/{name[:2]}/{name}-{chunk}.arrow"


def mark(marks: DataFrame, *order: str, name: str = "marks", keep: bool = False) -> str:
    """Write marks(file, row, ...) where the scans find them; the folder, which a scope's end leaves if it is kept."""
    spark = marks.sparkSession
    folder = files.folder(spark, name, keep)
    chunk = F.floor(F.col(ROW) / CHUNK)
    rest = [c for c in marks.columns if c not in (FILE, ROW)]
    keyed = marks.select(F.xxhash64(FILE, chunk).alias("_key"), FILE, ROW, *rest)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(n, "_key").sortWithinPartitions("_key", FILE, ROW, *order).drop("_key")

    def run(batches):
        key, out, place_, count = None, None, None, 0

        def done():
            out.close()
            place_.__exit__(None, None, None)
            return pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

        try:
            for batch in batches:
                for a, b, k in _segments(batch.column(0), batch.column(1).to_numpy()):
                    if k != key:
                        if key is not None:
                            yield done()
                        key, count, out = k, 0, None
                        place_ = files.placed(_path(folder, *key))
                        sink = place_.__enter__()
                        part = batch.slice(a, 0)
                        schema = pa.schema(list(part.schema)[1:])
                        out = pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False))
                    part = batch.slice(a, b - a)
                    out.write_batch(pa.RecordBatch.from_arrays(part.columns[1:], schema=schema))
                    count += b - a
            if key is not None:
                k, key = key, None
                yield done()
        except BaseException as e:
            if key is not None:  # a part of a file is no file
                place_.__exit__(type(e), e, e.__traceback__)
            raise

    ordered.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number
    return folder


def _segments(names: pa.Array, rows: np.ndarray) -> Iterator[tuple[int, int, tuple[str, int]]]:
    """(first, past the last, (file, chunk)) of consecutive rows of one chunk."""
    if not len(rows):
        return
    coded = names.dictionary_encode()
    code, chunk = coded.indices.to_numpy(), rows // CHUNK
    cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(chunk) != 0)) + 1
    bounds = [0, *cut.tolist(), len(rows)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield a, b, (coded.dictionary[int(code[a])].as_py(), int(chunk[a]))


class Reader:
    """The marks of a task's rows, read along as the rows come in order."""

    def __init__(self, folder: str):
        self.folder, self.key, self.batches, self.held = folder, None, iter(()), []

    def _open(self, key: tuple[str, int]) -> None:
        self.key, self.held = key, []

        def read():
            try:
                with files.opened(_path(self.folder, *key)) as f:
                    yield from pa.ipc.open_stream(f, options=pa.ipc.IpcReadOptions(use_threads=False))
            except FileNotFoundError:  # no row of the chunk has a mark
                return

        self.batches, self.passed = read(), -1

    def marks(self, names: pa.Array, rows: np.ndarray) -> Iterator[tuple[int, int, pa.Table | None, np.ndarray, np.ndarray]]:
        """(first, past the last, table, from, to) of consecutive rows: row k has table[from[k]:to[k]]."""
        for a, b, key in _segments(names, rows):
            x = rows[a:b]
            low, high = int(x.min()), int(x.max())
            if key != self.key or low <= self.passed:
                self._open(key)
            while not self.held or self.held[-1].column(0)[-1].as_py() <= high:
                more = next(self.batches, None)
                if more is None:
                    break
                if more.num_rows and more.column(0)[-1].as_py() >= low:
                    self.held.append(more)
            if not self.held:
                yield a, b, None, np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                continue
            table = pa.Table.from_batches(self.held)
            at = table.column(0).to_numpy()
            yield a, b, table, np.searchsorted(at, x, "left"), np.searchsorted(at, x, "right")
            # Later rows lie further on; what lies before them isn't held.
            self.held = [m for m in self.held if m.column(0)[-1].as_py() > high]
            self.passed = high


def beside(docs: DataFrame, columns: list, folder: str, run, schema) -> DataFrame:
    """mapInArrow over a rooted table's columns and their marks.

    ``run(batch, table, lo, hi)`` gets consecutive rows of one chunk and yields batches.
    """
    mark_ = files.token()
    named = docs.select(*columns, *place(docs, f"_file_{mark_}", f"_row_{mark_}"))
    width = len(named.columns) - 2

    def work(batches):
        reader = Reader(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            plain = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
            for a, b, table, lo, hi in reader.marks(batch.column(width), batch.column(width + 1).to_numpy()):
                yield from run(plain.slice(a, b - a), table, lo, hi)
            tx.trim()

    return named.mapInArrow(work, schema)
