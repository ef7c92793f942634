"""Streams of turns and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.operators import write
from memspark.session import numbered
from memspark.sources import snapshots
from memspark.sources.notes import extract
from memspark.sources.snapshots import Change


def facts(turns: DataFrame) -> DataFrame:
    """Candidate facts of turns; works on a stream and on a table alike."""
    t = turns.select("conv_id", "turn", "role", ft.redact(F.col("text")).alias("text")).filter("text is not null")
    return extract(t)


def start(turns: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Ingest a stream of turns batch by batch; ``write`` gets each batch's facts and its number."""
    return facts(turns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "2 hours", every: str = "1 hour") -> DataFrame:
    """Counts and sums per window and kind; late events count within the watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    per = e.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.unix_timestamp(F.col("window.start")).alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: runs of events no further apart than the gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    per = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.unix_timestamp(F.col("session_window.start")).alias("start"), "n")


def remember_into(turns: DataFrame, root: str, checkpoint: str, scope: str = "global"):
    """Each batch of turns through the write path, on the newest version of the store at root, and pushed as the next.

    A batch that runs again after a failure finds its number in the store and changes nothing.
    """
    spark = turns.sparkSession

    def write_batch(batch: DataFrame, number: int) -> None:
        while True:
            have = snapshots.versions(spark, root)
            base = have[-1] if have else 0
            if have and snapshots.pull(spark, root, "batches", base).filter(F.col("number") == number).limit(1).count():
                return
            memories = snapshots.pull(spark, root, "memories", base) if have else spark.createDataFrame([], "id string, scope string, content string")
            edges = snapshots.pull(spark, root, "edges", base) if have else None
            texts = numbered(batch.filter("text is not null").select("conv_id", "turn", "role", "text"), F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"), name="seq")
            out = write.remember(memories, edges, texts.select("seq", F.lit(scope).alias("scope"), "text"), F.current_timestamp(), agent="stream", origin="agent-ingested")
            done = spark.createDataFrame([(number,)], "number long")
            if have:
                new = out["edges"].join(edges.select("id"), "id", "left_anti")
                tables = {"memories": Change(out["changed"]), "edges": Change(new), "batches": Change(done, key=None)}
            else:
                tables = {"memories": out["memories"], "edges": out["edges"], "batches": done}
            same = tuple(t for t in snapshots.tables_of(spark, root, base) if t not in tables) if have else ()
            try:
                snapshots.commit(spark, root, tables, same, base)
                return
            except snapshots.Conflict:  # on what another writer has published meanwhile
                continue

    return turns.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
