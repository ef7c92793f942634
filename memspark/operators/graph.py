"""Edges and the views over them: conflicts, changes, snapshots, hubs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import slug
from memspark.operators.store import scan
from memspark.schema import complete


#: Instants of a block of ``as_of_many``, and blocks of a block of the next level; instants that are held at a time.
FAN, INSTANTS = 16, 200_000


def edge(frm, to, relation, weight=1.0) -> list:
    """Columns of an edge; its id follows from its ends and relation, so writing it twice is no change."""
    ident = F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws("|", frm, F.lit(relation) if isinstance(relation, str) else relation, to), 256), 1, 16))
    rel = F.lit(relation) if isinstance(relation, str) else relation
    return [ident.alias("id"), frm.alias("from_id"), to.alias("to_id"), rel.alias("relation"), (F.lit(weight) if isinstance(weight, float) else weight).alias("weight")]


def by_relation(edges: DataFrame, relation: str) -> DataFrame:
    return edges.filter(F.col("relation") == relation)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("id").distinct()
    return edges.join(n.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(n.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def conflicts(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Pairs of active memories that contradict each other."""
    m = scan(memories)
    a = m.select(F.col("id").alias("from_id"), F.col("content").alias("a_content"))
    b = m.select(F.col("id").alias("to_id"), F.col("content").alias("b_content"))
    return by_relation(edges, "conflicts_with").join(a, "from_id").join(b, "to_id").select("from_id", "to_id", "a_content", "b_content")


def changes(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """What replaced what, and when."""
    new = memories.select(F.col("id").alias("from_id"), F.col("content").alias("new_content"), F.unix_timestamp("created_at").alias("changed_at"))
    old = memories.select(F.col("id").alias("to_id"), F.col("content").alias("old_content"))
    return by_relation(edges, "supersedes").join(new, "from_id").join(old, "to_id").select("from_id", "to_id", "old_content", "new_content", "changed_at")


def newest_changes(edges: DataFrame, memories: DataFrame, limit: int = 100) -> DataFrame:
    """The latest changes first."""
    return changes(edges, memories).orderBy(F.desc("changed_at"), "from_id", "to_id").limit(limit)


def as_of(memories: DataFrame, at) -> DataFrame:
    """Memories that held at an instant, in valid time."""
    return memories.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def as_of_many(memories: DataFrame, instants: DataFrame) -> DataFrame:
    """at, id for many instants at once: a range join over blocks of instants.

    Instants are numbered; a memory's run of instants is cut into blocks of 1, ``FAN``, ``FAN`` ** 2, ..
    instants, so that a memory open for ever is listed some times a level, not under each instant.
    Instants go to the workers by ``INSTANTS`` at a time, and memories pass once for each of those.
    """
    spark, out = memories.sparkSession, None
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ticks = instants.select("at", micros("at").alias("us")).distinct()
    parts = max(1, -(-ticks.count() // INSTANTS))
    spans = memories.select(F.col("id").cast("string").alias("id"), micros("valid_from").alias("a"), micros("valid_to").alias("b")).filter("a is not null")
    for k in range(parts):
        some = ticks if parts == 1 else ticks.filter(F.pmod(F.xxhash64("us"), F.lit(parts)) == k)
        known = np.sort(some.select("us").toArrow()["us"].to_numpy())
        held, levels = spark.sparkContext.broadcast(known), 1
        while FAN**levels < len(known):
            levels += 1

        def run(batches, held=held, levels=levels):
            at = held.value
            for batch in batches:
                open_ = batch.column(2).is_null().to_numpy(zero_copy_only=False)
                lo = np.searchsorted(at, batch.column(1).to_numpy(), "left")
                hi = np.where(open_, len(at), np.searchsorted(at, batch.column(2).fill_null(0).to_numpy(), "left"))
                for row, size, block in _blocks(lo, hi, levels):
                    yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(row)), "size": pa.array(size), "block": pa.array(block)})

        listed = spans.mapInArrow(run, "id string, size long, block long")
        own = np.arange(len(known))
        asked = pa.table({"us": np.tile(known, levels), "size": np.repeat(FAN ** np.arange(levels), len(known)), "block": np.concatenate([own // FAN**j for j in range(levels)])})
        asked = spark.createDataFrame(asked)
        both = listed.join(F.broadcast(asked), ["size", "block"]).join(F.broadcast(some), "us").select("at", "id")
        out = both if out is None else out.unionByName(both)
    return out


def _blocks(lo: np.ndarray, hi: np.ndarray, levels: int):
    """(row, block size, block) of the fewest blocks that make up each run from lo to below hi, level by level."""
    row = np.flatnonzero(lo < hi)
    lo, hi = lo[row], hi[row]
    for k in range(levels):
        up, down = -(-lo // FAN), hi // FAN
        inner = up < down if k + 1 < levels else np.zeros(len(row), bool)
        # What sticks out of whole blocks of the next level, on either side.
        for a, b in ((lo, np.where(inner, up * FAN, hi)), (np.where(inner, down * FAN, hi), hi)):
            n = np.maximum(b - a, 0)
            at = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if len(at):
                yield np.repeat(row, n), np.full(len(at), FAN**k), at
        row, lo, hi = row[inner], up[inner], down[inner]


def hub_id(scope: Column) -> Column:
    return F.concat(F.lit("hub_"), slug(scope))


def hubs(memories: DataFrame, now: Column) -> DataFrame:
    """The hub of each project scope: a memory without vector, which bridges others and never surfaces."""
    scopes = memories.filter(F.col("scope").startswith("project:")).select("scope").distinct()
    rows = scopes.withColumns({
        "id": hub_id(F.col("scope")), "type": F.lit("entity"), "cognitive": F.lit("entity"), "content": F.concat(F.lit("Project: "), F.regexp_replace("scope", "^[^:]*:", "")),
        "hub": F.lit(True), "importance": F.lit(0.2), "confidence": F.lit(0.9), **{c: now for c in ("valid_from", "recorded_at", "created_at", "updated_at", "last_seen_at")},
    })
    return complete(rows)


def hub_links(memories: DataFrame) -> DataFrame:
    """Edges from each project's hub to its active memories."""
    m = scan(memories).filter(F.col("scope").startswith("project:") & ~F.coalesce("hub", F.lit(False)))
    return m.select(*edge(hub_id(F.col("scope")), F.col("id"), "has_member"))


def review_queue(memories: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """Stale memories, then conflicts, up to a limit."""
    stale = scan(memories).filter("stale").select(F.lit("stale").alias("kind"), "id", F.lit(None).cast("string").alias("other"))
    pairs = conflicts(edges, memories).select(F.lit("conflict").alias("kind"), F.col("from_id").alias("id"), F.col("to_id").alias("other"))
    return stale.unionByName(pairs).orderBy(F.when(F.col("kind") == "stale", 0).otherwise(1), "id", "other").limit(limit)
