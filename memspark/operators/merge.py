"""Merging replicas and comparing stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import fingerprint
from memspark.operators import write
from memspark.schema import complete, provenance
from memspark.session import numbered


def without_tombstoned(memories: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Memories whose fingerprint has not been erased."""
    return memories.withColumn("fp", fingerprint(F.col("type"), F.col("content"))).join(tombstones.select("fp").distinct(), "fp", "left_anti")


def last_writer(rows: DataFrame) -> DataFrame:
    """One row per id: the content of the largest (clock, replica, updated_at, content), the largest scores.

    A total order makes the merge commutative, associative and idempotent.
    """
    ticket = F.struct("clock", "replica", "updated_at", "content", "type", "scope")
    best = rows.groupBy("id").agg(F.max(ticket).alias("w"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence"), F.count("*").alias("replicas"))
    out = best.select("id", "w.content", "w.type", "w.scope", "w.clock", "w.replica", "importance", "confidence", "replicas")
    return out.join(united(rows, ticket), "id") if "provenance" in rows.columns else out


def united(rows: DataFrame, ticket: Column) -> DataFrame:
    """id, provenance: that of all versions, the winner's first, each (agent, extractor, ref) once."""
    each = rows.select("id", ticket.alias("w"), F.posexplode_outer("provenance").alias("at", "p"))
    one = each.filter("p is not null").groupBy("id", "p.agent", "p.extractor", "p.ref").agg(F.max(F.struct("w", (-F.col("at")).alias("at"))).alias("x"), F.max_by("p", F.struct("w", (-F.col("at")).alias("at"))).alias("p"))
    # array_sort puts the smallest first; the winner is the largest.
    lists = one.groupBy("id").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("x", "p")))), lambda y: y["p"]).alias("provenance"))
    none = F.array().cast(rows.schema["provenance"].dataType)
    return rows.select("id").distinct().join(lists, "id", "left").select("id", F.coalesce("provenance", none).alias("provenance"))


def without_forged(facts: DataFrame) -> DataFrame:
    """Facts but those whose signature can be checked, and which fails: sig_ok says whether it holds.

    ``signed`` tells which can be checked here; without it those of a public-key scheme.
    """
    can = F.col("signed") if "signed" in facts.columns else (F.col("sig_scheme") == "ed25519") & F.col("sig").isNotNull()
    return facts.filter(~F.coalesce(can & ~F.col("sig_ok"), F.lit(False)))


def merge_replicas(mine: DataFrame, theirs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Both replicas' memories; erased ones of the other, and forged ones if it has sig_ok, are left out."""
    theirs = without_forged(theirs) if "sig_ok" in theirs.columns else theirs
    return last_writer(mine.unionByName(without_tombstoned(theirs, tombstones).select(*mine.columns)))


def _replayed(facts: DataFrame, agent: str, extractor: str, now: Column, *order: Column) -> DataFrame:
    """Facts as candidates, in order; their own origin is kept."""
    own = F.coalesce(F.get(F.col("provenance"), F.lit(0))["origin"], F.lit("agent-ingested"))
    said = provenance(agent, extractor, at=now).withField("origin", own)
    known = complete(facts).withColumns({"provenance": F.array(said), "reinforced": F.lit(0.0)})
    return numbered(known, *order, name="seq").withColumn("id", write.new_id(F.col("type"), F.col("content"), F.col("scope"), F.lit(agent), F.col("id")))


def merge_strand(memories: DataFrame, edges: DataFrame | None, theirs: DataFrame, tombstones: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The other store's active memories through consolidation, newest first; erased ones are not raised again.

    ``tally`` counts those as NOOP.
    """
    active = complete(theirs).filter("status = 'active' and not hub")
    fit = without_tombstoned(active, tombstones).drop("fp")
    out = write.consolidate(memories, edges, _replayed(fit, "merge", "merge", now, F.col("created_at").desc(), F.col("id")), now)
    erased = active.select(F.count("*").alias("c")).crossJoin(fit.select(F.count("*").alias("d"))).select(F.lit("NOOP").alias("op"), (F.col("c") - F.col("d")).alias("n"))  # one row
    out["tally"] = write.tally(out["decisions"]).unionByName(erased).groupBy("op").agg(F.sum("n").alias("n"))
    return out


def handoff(memories: DataFrame, edges: DataFrame | None, ids: DataFrame, scope: str, tombstones: DataFrame, now: Column, agent: str = "agent") -> dict[str, DataFrame]:
    """Chosen memories copied into another scope through its consolidation."""
    chosen = rescope(complete(memories).filter("not hub"), ids, scope, tombstones).drop("fp")
    return write.consolidate(memories, edges, _replayed(chosen, agent, "handoff", now, F.col("id")), now)


def diff(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """side, n: facts by type and content that only one store has, and those that both have."""
    a, b = (x.select("type", "content").distinct() for x in (mine, theirs))
    key = ["type", "content"]
    parts = [("only_mine", a.join(b, key, "left_anti")), ("only_theirs", b.join(a, key, "left_anti")), ("both", a.join(b, key, "left_semi"))]
    out = None
    for name, p in parts:
        n = p.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def samples(mine: DataFrame, theirs: DataFrame, k: int = 5) -> DataFrame:
    """side, content: the first few, in order, of the facts that only one store has."""
    a, b = (x.select("type", "content").distinct() for x in (mine, theirs))
    some = lambda x, y, name: x.join(y, ["type", "content"], "left_anti").orderBy("content", "type").limit(k).select(F.lit(name).alias("side"), "content")
    return some(a, b, "only_mine").unionByName(some(b, a, "only_theirs"))


def rescope(memories: DataFrame, ids: DataFrame, scope: str, tombstones: DataFrame) -> DataFrame:
    """Memories handed to another scope, as candidates for its consolidation."""
    chosen = memories.join(ids.select("id").distinct(), "id", "left_semi")
    return without_tombstoned(chosen, tombstones).withColumn("scope", F.lit(scope))
