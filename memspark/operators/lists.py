"""A kept vector index: inverted lists around centroids, added to version by version, with an exact search.

A vector is in the list of the centroid nearest by angle and of the sight that its scope falls into, so a
question of one project reads two sights of a centroid's and not all. Of each list are kept how many
vectors it has, its longest and its widest angle from the centroid; removals leave them as they are, which
makes them looser and never wrong. From these follows how similar anything in a list can be to a question.

A search goes by rounds: each question visits its most promising lists, then those after them that may yet
hold something as near as the k-th found so far, four times as many a round, until no list may: the bound
has closed, and the answer is exact. Which centroids there are has no bearing on it. Where vectors lie all
alike far from each other, as random ones of many dimensions do, the bounds rule out little, and most lists
are read. Questions and lists meet in a shuffle as matrices; neither goes through the driver.

Centroids are fitted on a sample of ``SAMPLE`` vectors at the first addition that has any, and again by
``refit``, which is worth it once the lists have grown manifold.

Cases: a null vector isn't indexed or found, and a question without one finds nothing. Zero vectors have
similarity 0 to all. Ties go to the smaller id. A repeated id within an addition is kept as often as it
comes; in a later addition it takes the place of the earlier ones. A null scope is seen only by questions
without scope.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions.tiles import DIGITS, TILE, Tile, met_tiles
from memspark.functions.vectors import best_of, matrix
from memspark.schema import GLOBAL
from memspark.session import few, saved
from memspark.sources import snapshots
from memspark.sources.snapshots import Change

#: Centroids at most, vectors that they are fitted on, and rounds of that.
CENTROIDS, SAMPLE, FITTED = 1024, 16_384, 8
#: Parts that a centroid's vectors are in by scope, the first for the global one; lists of a first round, and by how much the next has more.
SIGHTS, FIRST, MORE = 8, 4, 4
TABLES = {
    "centroids": "cell int, vec array<double>",
    "lists": "list int, segment long, id string, scope string, vec array<double>",
    "dead": "id string, before long",
    "bounds": "list int, n long, norm double, cosine double",
}


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """k directions about which the sample's vectors lie; fewer if it has fewer."""
    size = np.linalg.norm(sample, axis=1)
    unit = np.unique(sample[size > 0] / size[size > 0, None], axis=0)
    at = unit[:: max(1, len(unit) // max(1, k))][:k].copy()
    for _ in range(FITTED if len(at) else 0):
        own = (unit @ at.T).argmax(1)
        total = np.zeros_like(at)
        np.add.at(total, own, unit)
        length = np.linalg.norm(total, axis=1)
        at = np.where(length[:, None] > 1e-12, total / np.maximum(length, 1e-12)[:, None], at)
    return at


def ceilings(q: np.ndarray, centroids: np.ndarray, cell: np.ndarray, norm: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Questions by lists: a similarity that nothing in the list exceeds.

    x is at most as far from the centroid, by angle, as the list is wide, so its angle to q is at least
    the difference.
    """
    size = np.linalg.norm(q, axis=1)
    near = np.clip((q @ centroids.T) / np.maximum(size, 1e-300)[:, None], -1, 1)[:, cell]
    wide = np.clip(cosine, -1, 1)[None, :]
    best = np.where(near >= wide, 1.0, near * wide + np.sqrt((1 - near**2) * (1 - wide**2)))
    return size[:, None] * norm[None, :] * np.maximum(best, 0.0) + 1e-9


class Lists:
    """A vector index at ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        if not snapshots.versions(spark, root):
            snapshots.push({n: spark.createDataFrame([], s) for n, s in TABLES.items()}, root)

    def _do(self, verb) -> int:
        while True:
            base = snapshots.versions(self.spark, self.root)[-1]
            tables = verb(base)
            try:
                return snapshots.commit(self.spark, self.root, tables, tuple(n for n in TABLES if n not in tables), base)
            except snapshots.Conflict:
                continue

    def _table(self, name: str, version: int) -> DataFrame:
        return snapshots.pull(self.spark, self.root, name, version)

    def _centroids(self, version: int) -> np.ndarray:
        rows = self._table("centroids", version).orderBy("cell").collect()  # CENTROIDS at most
        return np.array([r["vec"] for r in rows], float)

    def _fitted(self, rows: DataFrame) -> tuple[np.ndarray, DataFrame]:
        """Centroids of some rows, and as a table."""
        n = rows.count()
        sample = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # bounded
        at = fit(matrix(sample["vec"]), min(CENTROIDS, int(np.ceil(np.sqrt(n)))))
        if not len(at):  # none but zero vectors
            at = np.eye(1, matrix(sample["vec"]).shape[1])
        return at, self.spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(at)], TABLES["centroids"])

    def _listed(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        """Rows (id, scope, vec) with their list, length, and cosine to the centroid; written."""
        held = self.spark.sparkContext.broadcast(centroids)  # CENTROIDS rows at most

        def run(batches):
            at = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch.column(2))
                near = v @ at.T
                cell, size = near.argmax(1), np.linalg.norm(v, axis=1)
                # A zero vector is no wider than any other.
                cosine = np.where(size > 0, near.max(1) / np.maximum(size, 1e-300), 1.0) - 1e-12
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(size), pa.array(cosine)], names=["id", "scope", "vec", "cell", "norm", "cosine"])

        found = rows.mapInArrow(run, "id string, scope string, vec array<double>, cell int, norm double, cosine double")
        return saved(found.withColumn("list", F.col("cell") * SIGHTS + _sight(F.col("scope"))), "listed")

    def _changes(self, listed: DataFrame, segment: int) -> dict[str, DataFrame]:
        lists = listed.select("list", F.lit(segment).cast("long").alias("segment"), "id", "scope", "vec")
        bounds = listed.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.min("cosine").alias("cosine"))
        # In the order of lists, so a search skips the row groups of others; a long list may be several files.
        return {"lists": lists.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list"), "bounds": bounds}

    def put(self, vectors: DataFrame, new: bool = False) -> int:
        """Index vectors (id, scope, vec), in place of what their ids had; with ``new`` they had nothing."""
        rows = saved(vectors.select(F.col("id").cast("string").alias("id"), "scope", F.col("vec").cast("array<double>").alias("vec")), "vectors")
        held = rows.filter("vec is not null")

        def verb(base: int) -> dict[str, DataFrame | Change]:
            out: dict[str, DataFrame | Change] = {}
            at = self._centroids(base)
            if not len(at) and held.limit(1).count():
                at, out["centroids"] = self._fitted(held)
            if len(at):
                out |= {n: Change(df, key=None) for n, df in self._changes(self._listed(held, at), base + 1).items()}
            if not new:
                out["dead"] = Change(rows.select("id", F.lit(base + 1).cast("long").alias("before")).distinct())
            return out

        return self._do(verb)

    def remove(self, ids: DataFrame) -> int:
        """Vectors of these ids are found no more."""
        gone = saved(ids.select(F.col("id").cast("string").alias("id")).distinct(), "gone")
        return self._do(lambda base: {"dead": Change(gone.withColumn("before", F.lit(base + 1).cast("long")))})

    def refit(self) -> int:
        """New centroids for what there is, written in new lists without what is gone."""

        def verb(base: int) -> dict[str, DataFrame]:
            rows = saved(self._live(self._table("lists", base), base).select("id", "scope", "vec"), "vectors")
            if not rows.limit(1).count():
                return {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
            at, centroids = self._fitted(rows)
            return {"centroids": centroids, "dead": self.spark.createDataFrame([], TABLES["dead"]), **self._changes(self._listed(rows, at), base + 1)}

        return self._do(verb)

    def _live(self, lists: DataFrame, version: int) -> DataFrame:
        dead = self._table("dead", version).withColumnRenamed("before", "_before")
        return lists.join(few(dead), "id", "left").filter("_before is null or segment >= _before").drop("_before")

    def search(self, queries: DataFrame, k: int, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(qid, rank from 0, id, sim as ``vectors.nearest`` gives them; qid and how many lists were read, of how many in sight)."""
        spark, version = self.spark, version or snapshots.versions(self.spark, self.root)[-1]
        centroids = self._centroids(version)
        told = self._table("bounds", version).groupBy("list").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), F.min("cosine").alias("cosine")).orderBy("list").collect()  # CENTROIDS * SIGHTS at most
        none = spark.createDataFrame([], "qid long, rank long, id string, sim double"), spark.createDataFrame([], "qid long, lists_read long, lists long")
        if not told:
            return none
        held = spark.sparkContext.broadcast((centroids, np.array([r["list"] for r in told]), np.array([r["norm"] for r in told]), np.array([r["cosine"] for r in told])))
        sizes = F.broadcast(spark.createDataFrame([(r["list"], -(-r["n"] // TILE)) for r in told], "list int, parts int"))
        asked = queries.filter("vec is not null").select(F.col("qid").cast("long").alias("qid"), "scope", F.col("vec").cast("array<double>").alias("vec"))
        asked = saved(asked.withColumn("sight", F.when(F.col("scope").isNotNull(), _sight(F.col("scope")))), "asked")
        seen = saved(asked.select("qid").withColumn("floor", F.lit(None).cast("double")), "floors")
        best = read = None
        start, width = 0, FIRST
        while start < len(told):
            wanted = saved(_promising(asked.join(seen, "qid"), held, start, start + width), "wanted")
            now = [r[0] for r in wanted.select("list").distinct().collect()]
            if not now and start:  # no question has a list left that may hold something nearer
                break
            read = wanted.select("qid", "list", "lists") if read is None else read.unionByName(wanted.select("qid", "list", "lists"))
            rows = self._live(self._table("lists", version).filter(F.col("list").isin(now)), version)
            found = _scored(asked, wanted.select("qid", "list"), rows, sizes, k)
            best = saved(_ranked(found if best is None else best.drop("rank").unionByName(found), k), "best")
            floor = best.filter(F.col("rank") == k - 1).select("qid", F.col("sim").alias("floor"))
            seen = saved(asked.select("qid").join(floor, "qid", "left"), "floors")
            start, width = start + width, width * MORE
        return best, read.groupBy("qid").agg(F.count("*").alias("lists_read"), F.max("lists").alias("lists"))

    def nearest(self, queries: DataFrame, k: int, version: int | None = None) -> DataFrame:
        """qid, rank (from 0), id, sim: the k nearest in sight of each question (qid, vec, scope), exactly."""
        return self.search(queries, k, version)[0]


def _sight(scope):
    """The part of a centroid's vectors that a scope is in."""
    return F.when(scope == GLOBAL, 0).otherwise(1 + F.pmod(F.xxhash64(F.coalesce(scope, F.lit(""))), F.lit(SIGHTS - 1))).cast("int")


def _promising(asked: DataFrame, held, start: int, to: int) -> DataFrame:
    """qid, list: of each question the lists in these places by how near they may come, those below its floor left out."""

    def run(batches):
        centroids, lists, norm, cosine = held.value
        cell, part = lists // SIGHTS, lists % SIGHTS
        step = max(1, (4 << 20) // len(lists))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                b = batch.slice(lo, step)
                sight, floor = b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
                top = ceilings(matrix(b.column(2)), centroids, cell, norm, cosine)
                out = ~(np.isnan(sight)[:, None] | (part == 0)[None, :] | (part[None, :] == np.nan_to_num(sight, nan=-1)[:, None]))
                top[out] = -np.inf
                order = np.argsort(-top, axis=1, kind="stable")[:, start:to]
                value = np.take_along_axis(top, order, 1)
                row, at = np.nonzero((value > -np.inf) & ~(value < floor.astype(float)[:, None] - 0.51 * 10**-DIGITS))
                count = (~out).sum(1)[row]
                yield pa.RecordBatch.from_pydict({"qid": b.column(0).take(pa.array(row)), "list": pa.array(lists[order[row, at]].astype(np.int32)), "lists": pa.array(count.astype(np.int64))})

    columns = asked.select("qid", F.col("sight").cast("double").alias("sight"), "vec", "floor")
    return columns.mapInArrow(run, "qid long, list int, lists long")


def _scored(asked: DataFrame, wanted: DataFrame, rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """qid, id, sim: of each question and tile of a wanted list the k nearest in sight."""
    per = wanted.groupBy("list").agg((F.floor((F.count("*") - 1) / TILE) + 1).cast("int").alias("blocks")).join(sizes, "list")
    per = F.broadcast(per)  # CENTROIDS * SIGHTS rows at most
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    tile = [F.col("list").alias("i"), F.lit(0).alias("j"), "s", "t", "key", "scope", "vec"]
    x = few(wanted, 24).join(asked, "qid").join(per, "list").withColumn("key", F.col("qid").cast("string")).withColumn("s", place("qid", "blocks")).withColumn("t", upto("parts"))
    y = rows.join(per, "list").withColumn("key", F.col("id")).withColumn("t", place("id", "parts")).withColumn("s", upto("blocks"))

    def work(q: Tile, v: Tile):
        s = np.round(q.vecs @ v.vecs.T, DIGITS)
        seen = (q.scopes == None)[:, None] | (q.scopes[:, None] == v.scopes[None, :]) | (v.scopes == GLOBAL)[None, :]  # noqa: E711  elementwise
        row, at = np.nonzero(seen)
        row, sim, name = best_of(row, s[row, at], v.keys[at].astype(str), k)
        if len(row):
            yield pa.RecordBatch.from_pydict({"qid": pa.array(q.keys[row].astype(np.int64)), "id": pa.array(name.tolist(), pa.string()), "sim": pa.array(sim)})

    return met_tiles(x.select(*tile), y.select(*tile), work, "qid long, id string, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id")).cast("long") - 1
    return found.withColumn("rank", rank).filter(F.col("rank") < k).select("qid", "rank", "id", "sim")
