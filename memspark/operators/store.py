"""Scans, counts, projections and visibility over the relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import iso
from memspark.schema import GLOBAL, VISIBILITIES, complete


def scan(memories: DataFrame, scope: str | None = None, statuses: tuple[str, ...] = ("active",), limit: int | None = None) -> DataFrame:
    """Memories of some statuses and a scope, newest first if limited."""
    out = memories.filter(F.col("status").isin(*statuses))
    if scope is not None:
        out = out.filter(F.col("scope") == scope)
    return out if limit is None else out.orderBy(F.desc("created_at"), "id").limit(limit)


def without_hubs(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.coalesce("hub", F.lit(False)))


def listed(memories: DataFrame, scope: str | None = None, limit: int = 1000) -> DataFrame:
    """Active memories without hubs, newest first; hubs don't use up the limit."""
    return scan(without_hubs(memories), scope, limit=limit)


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories of a table of ids; the join replaces one lookup for each."""
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def visible(query_scope: Column, scope: Column) -> Column:
    """Whether a query of a scope sees a memory: any, its own scope, or the global one."""
    return query_scope.isNull() | (scope == query_scope) | (scope == GLOBAL)


def visibility(memories: DataFrame) -> Column:
    """The stated visibility if it is valid, else personal for identities and team for the rest."""
    stated = F.col("visibility")
    return F.when(stated.isin(*VISIBILITIES), stated).when(F.col("type") == "identity", F.lit("personal")).otherwise(F.lit("team"))


def shareable(memories: DataFrame, scope: str) -> DataFrame:
    """What may leave with a scope: its active memories and those below it, hubs and personal ones aside."""
    inside = (F.col("scope") == scope) | F.col("scope").startswith(scope + ":")
    return without_hubs(scan(memories)).filter(inside & (visibility(memories) != "personal"))


def card(memories: DataFrame) -> DataFrame:
    """The public face of a memory, with rounded scores."""
    return memories.select("id", "type", "cognitive", "content", "scope", F.bround("confidence", 3).alias("confidence"), F.bround("importance", 3).alias("importance"), "status", F.unix_timestamp("valid_from").alias("valid_from"), F.unix_timestamp("valid_to").alias("valid_to"))


def row_fingerprints(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """One line per memory and edge, for comparing two stores."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    m = memories.select(F.concat_ws("|", F.lit("M"), *[text(c) for c in ("id", "type", "content", "scope", "status")]).alias("line"))
    e = edges.select(F.concat_ws("|", F.lit("E"), *[text(c) for c in ("from_id", "relation", "to_id")]).alias("line"))
    return m.unionByName(e)


def count(memories: DataFrame, statuses: tuple[str, ...] = ("active",)) -> int:
    return memories.filter(F.col("status").isin(*statuses)).count()


def history(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest entries of the log of operations."""
    return log.orderBy(F.desc("seq")).limit(limit)


def public(memories: DataFrame) -> DataFrame:
    """card() with the origin of the first provenance, and times in ISO 8601."""
    m = complete(memories)
    origin = F.get(F.col("provenance"), F.lit(0))["origin"].alias("origin")
    return m.select("id", "type", "cognitive", "content", "scope", F.bround("confidence", 3).alias("confidence"), F.bround("importance", 3).alias("importance"), "status", iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_to")).alias("valid_to"), origin)


def detail(memories: DataFrame) -> DataFrame:
    """public() with times, provenance, and attributes but the private ones."""
    m = complete(memories)
    said = F.transform("provenance", lambda p: p.withField("ingested_at", iso(p["ingested_at"])))
    more = [iso(F.col(c)).alias(c) for c in ("created_at", "updated_at", "last_seen_at")]
    extra = m.select("id", *more, said.alias("provenance"), F.map_filter("attributes", lambda k, _: ~k.startswith("_")).alias("attributes"))
    return public(m).join(extra, "id")


def flagged(memories: DataFrame) -> DataFrame:
    """public() with the flags that trust depends on."""
    m = complete(memories)
    flags = m.select("id", "stale", "conflict", F.col("sig").isNotNull().alias("signed"), F.col("reinforced").cast("int").alias("reinforced"))
    return public(m).join(flags, "id")


def hit_cards(hits: DataFrame, memories: DataFrame, now) -> DataFrame:
    """public() of hits (qid, place, id, score, sim), with rounded score, similarity and salience."""
    from memspark.operators.lifecycle import salience

    m = complete(memories).join(hits.select("id").distinct(), "id", "left_semi")
    scores = hits.select("qid", "place", "id", F.bround("score", 4).alias("score"), F.bround("sim", 4).alias("similarity"))
    return scores.join(public(m), "id").join(m.select("id", F.bround(salience(now), 4).alias("salience")), "id")


def concise(rows: DataFrame) -> DataFrame:
    """The few columns that a tool's answer needs."""
    return rows.select(*[c for c in ("qid", "place", "id", "type", "content", "scope", "score") if c in rows.columns])
