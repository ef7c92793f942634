"""Similarity joins by tiles: which vectors of two tables are similar, without one side going through the driver.

Rows are dealt by their keys to tiles, and the tiles of either side meet in a shuffle, two at a time, as
matrices. A row goes to each tile of the other side, so a tile holds as many rows as ``TILE_BYTES`` allows:
there are ``SPREAD`` of them, for there to be tasks enough, and more only beyond that many full ones. What is
shuffled so stays at a fixed number of times the input up to there, whatever the vectors are like.

Vectors also belong to the cell of the nearest pivot, a few vectors chosen by a hash. What a cell's vectors
can have in common with another's follows from the distance of the pivots, the cells' radii and the longest
vectors, by the triangle inequality, and within two tiles cells that can't be similar enough aren't
multiplied. Which vectors are pivots has no bearing on the result. Where vectors keep all alike far from each
other, as random ones of many dimensions do, nothing is ruled out.

A join asks for links, not pairs: ``linked`` gives of each two tiles a forest of those that are connected,
and ``best`` the nearest few, so a group of any size is as many rows as it has members, times tiles. Pairs
are worked off a block of similarities at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.vectors import CELLS, best_of, matrix
from memspark.schema import GLOBAL
from memspark.session import saved

#: Pivots at most, and rows of a tile below which it isn't split further.
PIVOTS, TILE = 256, 2048
#: Tiles of a table that is joined with itself, while they hold so many bytes of vectors at most.
SPREAD, TILE_BYTES = 8, 32 << 20
#: Rows and columns of similarities that are computed at once.
BLOCK = 256, 4096
#: Similarities are compared after rounding to so many digits.
DIGITS = 6
_COLUMNS = "key string, scope string, vec array<double>, cell int, away double, norm double"


class Tile:
    """Rows that meet another tile's: keys, scopes, a matrix, and cells, in their order."""

    def __init__(self, keys: list, scopes: list, vecs: np.ndarray, cells: np.ndarray):
        self.keys, self.scopes, self.vecs, self.cells = np.array(keys, object), np.array(scopes, object), vecs, cells


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (key, scope, vec) with their cell, distance from its pivot, and length."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def run(batches):
        p = held.value
        half = (p * p).sum(1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(2))
            cell = (v @ p.T - half).argmax(1)
            away = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((v * v).sum(1)))], names=["key", "scope", "vec", "cell", "away", "norm"]
            )

    return rows.mapInArrow(run, _COLUMNS)


def _cells(rows: DataFrame) -> dict[int, tuple[int, float, float]]:
    """cell -> rows, radius, longest vector; PIVOTS rows at most."""
    return {r[0]: (r[1], r[2], r[3]) for r in rows.groupBy("cell").agg(F.count("*"), F.max("away"), F.max("norm")).collect()}


def near_cells(pivots: np.ndarray, a: dict, b: dict, floor: float) -> list[tuple[int, int]]:
    """Pairs of cells of which some vectors may be at least so similar."""
    out = []
    for i, (_, r, n) in a.items():
        far = np.sqrt(((pivots - pivots[i]) ** 2).sum(1))
        for j, (_, s, m) in b.items():
            # |x - y| >= apart, and 2xy = |x|^2 + |y|^2 - |x - y|^2
            apart = max(0.0, far[j] - r - s)
            if min(n * m, (n * n + m * m - apart * apart) / 2) >= floor - 0.51 * 10**-DIGITS - 1e-9:
                out.append((i, j))
    return out


def joined(left: DataFrame, right: DataFrame | None, floor: float, work: Callable[[Tile, Tile | None, np.ndarray | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` gives for each two tiles of left and right (key, scope, vec; best written tables), with which cells may be so similar.

    Without right, the tiles of left meet each other, each two once, and each itself, with None.
    """
    spark = left.sparkSession
    own = lambda df: df.filter(F.col("vec").isNotNull()).select(F.col("key").cast("string").alias("key"), "scope", F.col("vec").cast("array<double>").alias("vec"))
    left = own(left)
    n = left.count()
    if not n:
        return spark.createDataFrame([], schema)
    # As many cells as there are TILE rows: more would only make products small. The same ones in every run.
    chosen = left.orderBy(F.xxhash64("key"), "key").limit(min(PIVOTS, -(-n // TILE))).collect()
    pivots = np.array([r["vec"] for r in chosen], float)
    if len(pivots) == 1:  # one cell, which nothing is ruled out of
        at = lambda df: df.withColumn("cell", F.lit(0))
        a, b, near = at(left), at(left if right is None else own(right)), None
        m = n if right is None else b.count()
    else:
        a = saved(_assigned(left, pivots), "cells")
        b = a if right is None else saved(_assigned(own(right), pivots), "cells")
        ca = _cells(a)
        cb = ca if right is None else _cells(b)
        near = np.zeros((len(pivots), len(pivots)), bool)
        for i, j in near_cells(pivots, ca, cb, floor):
            near[i, j] = True
        meets = lambda df, some: df.filter(F.col("cell").isin(np.flatnonzero(some).tolist()))
        a, b = meets(a, near.any(1)), meets(b, near.any(0))
        n, m = (sum(c[k][0] for k in np.flatnonzero(some).tolist() if k in c) for c, some in ((ca, near.any(1)), (cb, near.any(0))))
    if not n or not m:
        return spark.createDataFrame([], schema)
    full = max(TILE, TILE_BYTES // (8 * max(1, pivots.shape[1])))
    tiles = lambda rows, least: max(min(least, -(-rows // TILE)), -(-rows // full))
    kj = tiles(m, SPREAD if right is None else 1)
    ki = kj if right is None else tiles(n, -(-2 * SPREAD // kj))
    place = lambda k: F.pmod(F.xxhash64("key"), F.lit(k)).cast("int")
    whole = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    both = [F.lit(0).alias("i"), F.lit(0).alias("j"), "s", "t", "key", "scope", "vec", "cell"]
    # A row of the left goes to the column of its tile, one of the right to its row; tiles of one table meet above the diagonal.
    x = a.withColumn("s", place(ki)).withColumn("t", F.explode(F.sequence("s", F.lit(kj - 1)) if right is None else whole(kj)))
    y = b.withColumn("t", place(kj))
    y = y.withColumn("s", F.explode(F.filter(whole(ki), lambda s: s < F.col("t")) if right is None else whole(ki)))
    return met_tiles(x.select(*both), y.select(*both), lambda p, q: work(p, q, near), schema, right is None, ki * kj)


def met_tiles(x: DataFrame, y: DataFrame, work: Callable[[Tile, Tile | None], Iterator[pa.RecordBatch]], schema: str, alone: bool = False, least: int = 1) -> DataFrame:
    """What ``work`` gives for each two tiles: the rows of x and y (i, j, s, t, key, scope, vec, and cell if there are any) of equal i, j, s, t.

    With ``alone`` a tile on the diagonal meets itself, with None. There are ``least`` partitions or more.
    """
    spark = x.sparkSession
    columns = ["i", "j", "s", "t"]
    cell = F.col("cell") if "cell" in x.columns else F.lit(0).alias("cell")
    side = lambda df, k: df.select(*columns, F.lit(k).alias("side"), "key", "scope", "vec", cell)
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = side(x, 0).unionByName(side(y, 1)).repartition(n, *columns).sortWithinPartitions(*columns, "side", "cell")

    def run(batches):
        now, held = None, ([], [])

        def done():
            tiles = [Tile([k for b in s for k in b[0]], [k for b in s for k in b[1]], *(np.concatenate([b[k] for b in s]) for k in (2, 3))) if s else None for s in held]
            same = now[0] == now[1] and now[2] == now[3]
            if tiles[0] is not None and (tiles[1] is not None or alone and same):
                yield from work(*tiles)

        for batch in batches:
            codes = np.stack([batch.column(k).to_numpy() for k in range(5)], 1)
            cut = np.flatnonzero((np.diff(codes, axis=0) != 0).any(1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(codes)], strict=True):
                if hi == lo:
                    continue
                key = tuple(codes[lo, :4])
                if key != now:
                    if now is not None:
                        yield from done()
                    now, held = key, ([], [])
                part = batch.slice(lo, hi - lo)
                held[codes[lo, 4]].append((part.column(5).to_pylist(), part.column(6).to_pylist(), matrix(part.column(7)), part.column(8).to_numpy()))
        if now is not None:
            yield from done()

    return ordered.mapInArrow(run, schema)


def _codes(*tiles: Tile) -> list[np.ndarray]:
    """Scopes as numbers: 0 for the global one, 1 for none."""
    held: dict = {GLOBAL: 0, None: 1}
    return [np.fromiter((held.setdefault(s, len(held)) for s in t.scopes), np.int64, len(t.scopes)) for t in tiles]


def _similar(a: Tile, b: Tile, near: np.ndarray | None, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and similarities that are large enough, a block at a time; of a tile with itself those above the diagonal too."""
    starts = [0] if near is None else [0, *(np.flatnonzero(np.diff(a.cells)) + 1)]
    runs: list[list] = []  # neighbouring cells that meet the same rows
    for lo, hi in zip(starts, [*starts[1:], len(a.cells)], strict=True):
        cols = np.ones(len(b.cells), bool) if near is None else near[a.cells[lo]][b.cells]
        if runs and (runs[-1][2] == cols).all():
            runs[-1][1] = hi
        else:
            runs.append([lo, hi, cols])
    for lo, hi, cols in runs:
        cols = np.flatnonzero(cols)
        for at in range(lo, hi, BLOCK[0]):
            rows = a.vecs[at : min(at + BLOCK[0], hi)]
            left = cols[np.searchsorted(cols, at) :] if a is b else cols
            for k in range(0, len(left), BLOCK[1]):
                some = left[k : k + BLOCK[1]]
                s = (rows @ b.vecs[some].T).ravel()
                hit = np.flatnonzero(s >= floor - 10**-DIGITS)
                sim = np.round(s[hit], DIGITS)
                hit, sim = hit[sim >= floor], sim[sim >= floor]
                if len(hit):
                    yield hit // len(some) + at, some[hit % len(some)], sim


def _connect(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Add links to a forest: root names of each node the smallest one that it is connected with."""
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root[:] = up


def linked(items: DataFrame, floor: float) -> DataFrame:
    """a, b: links that connect just those items (seq, scope, vec) which chains of similar ones in each other's sight connect.

    Equal vectors of a scope are one. Of each two tiles come links to the smallest of each connected part.
    """
    same = items.filter(F.col("vec").isNotNull()).groupBy("vec", "scope").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    one = saved(same, "different")
    copies = items.join(one.filter("n > 1"), ["vec", "scope"]).filter("seq <> first")
    norm = F.round(F.aggregate("vec", F.lit(0.0).cast("double"), lambda s, v: s + v * v), DIGITS)
    copies = copies.filter(norm >= floor).select(F.col("seq").alias("a"), F.col("first").alias("b"))

    def work(a: Tile, b: Tile | None, near):
        keys = np.concatenate([a.keys, b.keys] if b is not None else [a.keys]).astype(np.int64)
        b = a if b is None else b
        order = np.argsort(keys)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        row, col, root = rank[: len(a.keys)], rank[-len(b.keys) :], np.arange(len(order))
        p, q = _codes(a, b)
        for x, y, _ in _similar(a, b, near, floor):
            sight = (p[x] == q[y]) | (p[x] == 0) | (q[y] == 0)
            _connect(root, row[x[sight]], col[y[sight]])
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pa.RecordBatch.from_pydict({"a": pa.array(keys[order[moved]]), "b": pa.array(keys[order[root[moved]]])})

    return joined(one.select(F.col("first").alias("key"), "scope", "vec"), None, floor, work, "a long, b long").unionByName(copies)


def best(queries: DataFrame, items: DataFrame, k: int, floor: float) -> DataFrame:
    """qid, rank, id, sim as ``nearest`` gives them: of each query (qid, vec, scope) the k nearest items (id, vec, scope) in sight that are at least so similar."""

    def work(q: Tile, v: Tile, near):
        names = np.unique(v.keys.astype(str), return_inverse=True)
        asks, seen = _codes(q, v)
        have = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        more, n = [], 0
        for x, y, sim in _similar(q, v, near, floor):
            sight = (asks[x] == 1) | (asks[x] == seen[y]) | (seen[y] == 0)
            more.append((x[sight], sim[sight], names[1][y[sight]]))
            n += len(more[-1][0])
            if n > max(CELLS // 4, len(have[0])):  # the best so far, and as many again
                have, more, n = best_of(*map(np.concatenate, zip(have, *more, strict=True)), k), [], 0
        row, sim, name = best_of(*map(np.concatenate, zip(have, *more, strict=True)), k)
        if len(row):
            yield pa.RecordBatch.from_pydict({"qid": pa.array(q.keys[row].astype(np.int64)), "id": pa.array(names[0][name].tolist(), pa.string()), "sim": pa.array(sim)})

    found = joined(queries.select(F.col("qid").alias("key"), "scope", "vec"), items.select(F.col("id").alias("key"), "scope", "vec"), floor, work, "qid long, id string, sim double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id")).cast("long") - 1
    return found.withColumn("rank", rank).filter(F.col("rank") < k).select("qid", "rank", "id", "sim")
