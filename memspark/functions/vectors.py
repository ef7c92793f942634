"""Vector functions as columns, and exact search by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that one block holds, and similarities that are computed at once.
BLOCK_BYTES, CELLS = 16 << 20, 4 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine of unit vectors."""
    parts = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix, without a Python object a number."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(float) if len(vectors) else np.zeros((0, 0))


def blocks(queries: DataFrame, *columns: str) -> Iterator[pa.Table]:
    """The queries' columns and vectors in blocks of a fixed size, for the workers; jobs run meanwhile."""
    known = queries.filter(F.col("vec").isNotNull()).select(*columns, F.col("vec").cast("array<double>").alias("vec"))
    rows = known.agg(F.count("*"), F.max(F.size("vec"))).first()
    n = max(1, -(-rows[0] * 8 * max(1, rows[1] or 1) // BLOCK_BYTES))
    for b in range(n):
        yield (known if n == 1 else known.filter(F.pmod(F.xxhash64(columns[0]), F.lit(n)) == b)).toArrow()


def best_of(row: np.ndarray, sim: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of each row with the largest sim, ties to the smaller name."""
    order = np.lexsort((name, -sim, row))
    row, sim, name = row[order], sim[order], name[order]
    first = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - first < k
    return row[keep], sim[keep], name[keep]


def best_in_scope(queries: DataFrame, items: DataFrame, k: int, weight: float, digits: int = 6) -> DataFrame:
    """qid, rank (from 1), id, total: of a query's own scope the k items (id, scope, vec, prior) largest by weight * cosine + prior.

    Like nearest(), whatever the sizes of scopes: queries (qid, scope, vec) go to the items in blocks of a
    fixed size, and each partition keeps its own best. Ties go to the smaller id; a null prior or scope counts not.
    """
    spark, out = queries.sparkSession, None
    for got in blocks(queries.filter("scope is not null"), "qid", "scope"):
        held = spark.sparkContext.broadcast((got["qid"].to_numpy(), matrix(got["vec"]), np.array(got["scope"].to_pylist(), object)))

        def run(batches, held=held):
            qid, q, scope = held.value
            asks = {s: np.flatnonzero(scope == s) for s in set(scope)}
            best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1")
            for batch in batches:
                ids, v, prior = np.array(batch.column(0).to_pylist(), str), matrix(batch.column(1)), batch.column(3).to_numpy()
                seen = np.array(batch.column(2).to_pylist(), object)
                found = [best]
                for s in set(seen) & asks.keys():
                    here = np.flatnonzero(seen == s)
                    step = max(1, CELLS // len(here))
                    for at in range(0, len(asks[s]), step):
                        rows = asks[s][at : at + step]
                        total = np.round(weight * (q[rows] @ v[here].T) + prior[here], digits)
                        cut = np.partition(total, len(here) - k, axis=1)[:, len(here) - k, None] if len(here) > k else -np.inf
                        i, j = np.nonzero(total >= cut)
                        found.append(best_of(rows[i], total[i, j], ids[here[j]], k))
                best = best_of(*map(np.concatenate, zip(*found, strict=True)), k)
            row, total, name = best
            if len(row):
                yield pa.RecordBatch.from_pydict({"qid": pa.array(qid[row], pa.int64()), "id": pa.array(name.tolist(), pa.string()), "total": pa.array(total)})

        known = items.filter("vec is not null and scope is not null and prior is not null")
        found = known.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"), "scope", F.col("prior").cast("double").alias("prior")).mapInArrow(run, "qid long, id string, total double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("total"), "id")).cast("long")
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "id", "total")


def nearest(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, floor: float | None = None) -> DataFrame:
    """qid, rank (from 0), id, sim: the k nearest items (id, vec, scope) of each query (qid, vec, scope) it may see.

    Query vectors go to the workers in blocks of a fixed size; each partition of items scores a batch
    with matrix products and keeps its own best k, so what is shuffled is k rows per query and
    partition at most. Ties go to the smaller id. Items below the floor, and rows without vector, don't count.
    """
    spark, out = queries.sparkSession, None
    for got in blocks(queries, "qid", "scope"):
        held = spark.sparkContext.broadcast((got["qid"].to_numpy(), matrix(got["vec"]), np.array(got["scope"].to_pylist(), object)))

        def run(batches, held=held):
            qid, q, scope = held.value
            if not len(qid):
                return
            row, sim, name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1")
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, v = np.array(batch.column(0).to_pylist(), str), matrix(batch.column(1))
                seen = np.array(batch.column(2).to_pylist(), object)
                in_all = seen == "global"
                sight = {s: None if s is None else (seen == s) | in_all for s in set(scope)}
                step = max(1, CELLS // len(ids))
                for at in range(0, len(qid), step):
                    s = np.round(q[at : at + step] @ v.T, digits)
                    for j, x in enumerate(scope[at : at + step]):
                        if x is not None:
                            s[j, ~sight[x]] = -np.inf
                    cut = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
                    i, j = np.nonzero((s >= cut) & (s > -np.inf if floor is None else s >= floor))
                    row, sim, name = np.concatenate((row, i + at)), np.concatenate((sim, s[i, j])), np.concatenate((name, ids[j]))
                row, sim, name = best_of(row, sim, name, k)
            if len(row):
                yield pa.RecordBatch.from_pydict({"qid": pa.array(qid[row], pa.int64()), "id": pa.array(name.tolist(), pa.string()), "sim": pa.array(sim)})

        known = items.filter(F.col("vec").isNotNull())
        found = known.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"), "scope").mapInArrow(run, "qid long, id string, sim double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id")).cast("long") - 1
    return out.withColumn("rank", rank).filter(F.col("rank") < k).select("qid", "rank", "id", "sim")


def smallest_near(items: DataFrame, floor: float, digits: int = 6) -> DataFrame:
    """seq, near: the smallest label among the items (seq, label, vec) that are at least so similar, itself included.

    Every partition gives one row per item at most, however many are similar; no pairs are made.
    """
    spark, out = items.sparkSession, None
    for got in blocks(items, "seq", "label"):
        held = spark.sparkContext.broadcast((got["seq"].to_numpy(), matrix(got["vec"])))

        def run(batches, held=held):
            seq, q = held.value
            low = np.full(len(seq), np.iinfo(np.int64).max)
            for batch in batches:
                if batch.num_rows and len(seq):
                    label, v = batch.column(0).to_numpy(), matrix(batch.column(1))
                    step = max(1, CELLS // len(label))
                    for at in range(0, len(seq), step):
                        near = np.round(q[at : at + step] @ v.T, digits) >= floor
                        low[at : at + step] = np.minimum(low[at : at + step], np.where(near, label, np.iinfo(np.int64).max).min(1))
            hit = low < np.iinfo(np.int64).max
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seq[hit]), "near": pa.array(low[hit])})

        found = items.filter(F.col("vec").isNotNull()).select("label", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "seq long, near long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("seq").agg(F.min("near").alias("near"))
