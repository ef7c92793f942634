"""Rollups over memories and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import key_entities
from memspark.operators.store import scan, without_hubs
from memspark.schema import STATUSES

# What an embedding and an operation would have cost with a hosted model.
PER_MEMORY, PER_OPERATION = 4e-7, 8e-5


def overview(memories: DataFrame, edges: DataFrame, tombstones: DataFrame) -> DataFrame:
    """metric, value: totals by state, by type and by day."""
    m = without_hubs(memories)
    active = scan(m)
    named = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "value")
    out = named(active, "total").unionByName(named(active.filter("stale"), "stale")).unionByName(named(m.filter("status = 'quarantined'"), "quarantined"))
    out = out.unionByName(named(edges.filter("relation = 'conflicts_with'"), "conflicts")).unionByName(named(tombstones, "tombstones"))
    out = out.unionByName(active.groupBy("type").agg(F.count("*").alias("value")).select(F.lit("by_type").alias("metric"), F.col("type").alias("key"), "value"))
    days = active.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("key")).agg(F.count("*").alias("value"))
    return out.unionByName(days.select(F.lit("by_day").alias("metric"), "key", "value"))


def most_recalled(memories: DataFrame, k: int = 5) -> DataFrame:
    return scan(without_hubs(memories)).filter("reinforced > 0").orderBy(F.desc("reinforced"), "id").limit(k).select("id", "reinforced")


def themes(memories: DataFrame, top: int = 8) -> DataFrame:
    """The subjects that most active memories name, each with its newest example."""
    each = scan(without_hubs(memories)).select("id", "created_at", F.explode(key_entities(F.col("content"))).alias("topic"))
    newest = F.max(F.struct("created_at", "id"))
    per = each.groupBy("topic").agg(F.count("*").alias("n"), newest.alias("x")).orderBy(F.desc("n"), "topic").limit(top)
    return per.select("topic", "n", F.col("x.id").alias("example"))


def savings(memories: DataFrame, history: DataFrame) -> DataFrame:
    m, h = scan(memories).agg(F.count("*").alias("memories")), history.agg(F.count("*").alias("operations"))
    return m.crossJoin(h).select("memories", "operations", F.round(F.col("memories") * PER_MEMORY + F.col("operations") * PER_OPERATION, 4).alias("saved"))


def clusters(memories: DataFrame, least: int = 3, sources: int = 10) -> DataFrame:
    """Scopes with enough to reflect on, with the newest sources of each.

    Only the newest few of a scope are shuffled beyond their own partition, however large it is.
    """
    m = scan(without_hubs(memories)).select("scope", "id", "created_at")
    sized = m.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("created_at"), "id"))
    newest = m.withColumn("at", place).filter(F.col("at") <= sources)
    lists = newest.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("top"))
    return lists.join(sized, "scope").select("scope", "n", F.concat_ws(",", F.transform("top", lambda x: x["id"])).alias("sources"))


def stats(memories: DataFrame, edges: DataFrame, tombstones: DataFrame, history: DataFrame) -> DataFrame:
    """metric, value: what a store holds, by state, with its edges, tombstones, operations and vectors' length."""
    m = memories.agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_memories") for s in STATUSES], F.coalesce(F.max(F.size("vec")), F.lit(0)).cast("long").alias("embedding_dim") if "vec" in memories.columns else F.lit(0).cast("long").alias("embedding_dim"),
    )
    out = m.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in m.columns]), F.array(*m.columns))).alias("metric", "value"))
    for name, df in (("edges", edges), ("tombstones", tombstones), ("operations", history)):
        out = out.unionByName(df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value"))
    return out


def tally(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("op").agg(F.count("*").alias("n"))


def usage_by_month(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
