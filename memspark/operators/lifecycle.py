"""Decay, upkeep and consolidation of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.functions.vectors import best_in_scope
from memspark.schema import cognitive_of, complete, provenance
from memspark.session import numbered, saved

# Half-lives in days, growth per reinforcement, thresholds of upkeep and consolidation.
HALF_LIFE = {"episodic": 7.0, "procedural": 90.0, "semantic": 3650.0, "entity": 3650.0}
OTHER_HALF_LIFE, RECENCY_HALF_LIFE, GROWTH = 30.0, 30.0, 1.15
ARCHIVE_BELOW, MIN_AGE_DAYS, RETENTION_DAYS, PROMOTE_AFTER, PROMOTE_BUMP = 0.05, 30, 365, 2, 0.1
DUPLICATE, UPDATE, GRAY, BUMP = 0.97, 0.82, 0.65, 0.05


def _days(now, since: str) -> Column:
    return F.greatest((F.unix_timestamp(now) - F.unix_timestamp(since)) / 86400.0, F.lit(0.0))


def salience(now) -> Column:
    """Importance, halved with each half-life since last seen; reinforcement stretches the half-life."""
    life = F.lit(OTHER_HALF_LIFE)
    for k, v in HALF_LIFE.items():
        life = F.when(F.col("cognitive") == k, F.lit(v)).otherwise(life)
    stretch = F.pow(F.lit(GROWTH), F.coalesce("reinforced", F.lit(0.0)))
    return F.col("importance") * F.pow(F.lit(2.0), -_days(now, "last_seen_at") / (life * stretch))


def recency(now) -> Column:
    return F.pow(F.lit(2.0), -_days(now, "last_seen_at") / RECENCY_HALF_LIFE)


def reinforce(memories: DataFrame, ids: DataFrame, now) -> DataFrame:
    """Memories whose id is listed count one more use, seen now."""
    hit = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    seen = F.coalesce("_hit", F.lit(False))
    hit = hit.withColumn("reinforced", F.coalesce("reinforced", F.lit(0.0)) + seen.cast("double"))
    return hit.withColumn("last_seen_at", F.when(seen, now).otherwise(F.col("last_seen_at"))).drop("_hit")


def maintain(memories: DataFrame, now, below: float = ARCHIVE_BELOW, min_age: int = MIN_AGE_DAYS) -> DataFrame:
    """Archive what is old and faded."""
    faded = (F.col("status") == "active") & ~F.coalesce("hub", F.lit(False)) & (salience(now) < below) & (_days(now, "created_at") >= min_age)
    return memories.withColumn("status", F.when(faded, "archived").otherwise(F.col("status")))


def purge(memories: DataFrame, now, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(what stays, tombstones) once archived and forgotten memories pass their retention."""
    gone = F.coalesce(F.col("status").isin("archived", "forgotten") & (_days(now, "updated_at") >= days), F.lit(False))
    return memories.filter(~gone), memories.filter(gone).select(ft.fingerprint(F.col("type"), F.col("content")).alias("fp")).distinct()


def promote(memories: DataFrame, after: float = PROMOTE_AFTER) -> DataFrame:
    """Episodes that proved useful become semantic facts."""
    ripe = (F.col("status") == "active") & (F.col("cognitive") == "episodic") & (F.coalesce("reinforced", F.lit(0.0)) >= after)
    confident = F.when(ripe, F.least(F.col("confidence") + PROMOTE_BUMP, F.lit(1.0))).otherwise(F.col("confidence"))
    kind = F.when(ripe & (F.col("type") == "episode"), "fact").otherwise(F.col("type"))
    return memories.withColumn("confidence", confident).withColumn("type", kind).withColumn("cognitive", F.when(ripe, "semantic").otherwise(F.col("cognitive")))


def decide(candidates: DataFrame) -> DataFrame:
    """What consolidation does with each candidate against its nearest memory.

    Columns: sim, near_type, type, content, and near_id, null where nothing is in sight. Near copies are
    NOOP, the same subject an UPDATE or, where the text contradicts, a SUPERSEDE, all else an ADD, in
    conflict if it contradicts something close.
    """
    same, sim = F.coalesce(F.col("near_type") == F.col("type"), F.lit(False)), F.coalesce("sim", F.lit(-1.0))
    against = ft.contradicts(F.col("content"), F.col("type"))
    op = F.when(same & (sim >= DUPLICATE), "NOOP").when(same & (sim >= UPDATE) & against, "SUPERSEDE").when(same & (sim >= UPDATE), "UPDATE").otherwise("ADD")
    conflict = (op == "ADD") & same & (sim >= GRAY) & against
    return candidates.withColumn("op", op).withColumn("conflict", conflict)


def merged(pairs: DataFrame) -> DataFrame:
    """What an UPDATE leaves: the longer content, the larger importance, more confidence.

    ``pairs`` has old_* and new_* columns. The vector follows the content that is kept.
    """
    longer = F.length("new_content") > F.length("old_content")
    return pairs.select(
        "id", F.when(longer, F.col("new_content")).otherwise(F.col("old_content")).alias("content"), longer.alias("takes_new_vector"),
        F.greatest("old_importance", "new_importance").alias("importance"), F.least(F.col("old_confidence") + BUMP, F.lit(1.0)).alias("confidence"),
    )


def fold(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """seq, op, id: what consolidation makes of candidates, each seeing what earlier ones did."""
    from memspark.operators.write import decisions  # that module builds on this one

    return decisions(candidates, memories).select("seq", "op", "id")


def stale_dependents(replaced: DataFrame, memories: DataFrame, newest: int = 200) -> DataFrame:
    """id, reason of memories that mention what a replacement dropped.

    ``replaced`` has scope, old_id, old_content, new_content. Only the newest memories of each scope are
    looked at, as the review queue is for recent ones.
    """
    dropped = F.array_except(ft.key_entities(F.col("old_content")), ft.key_entities(F.col("new_content")))
    order = Window.partitionBy("scope").orderBy(F.desc("created_at"), "id")
    recent = memories.filter("status = 'active'").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= newest)
    recent = recent.select("id", "scope", ft.key_entities(F.col("content")).alias("names"))
    both = replaced.select("scope", "old_id", "new_content", dropped.alias("dropped")).join(recent, "scope").filter((F.col("id") != F.col("old_id")) & F.arrays_overlap("dropped", "names"))
    reason = F.concat(F.lit("references '"), F.array_min(F.array_intersect("dropped", "names")), F.lit("', superseded by: "), F.substring("new_content", 1, 80))
    return both.select("id", "old_id", reason.alias("reason"))


def auto_links(pairs: DataFrame, floor: float = 0.5) -> DataFrame:
    """Edges to near memories: pairs (from_id, to_id, sim) above a floor, weighted by similarity."""
    return pairs.filter((F.col("from_id") != F.col("to_id")) & (F.col("sim") >= floor)).select("from_id", "to_id", F.lit("related_to").alias("relation"), F.round("sim", 3).alias("weight"))


def outcomes(procedures: DataFrame) -> DataFrame:
    """Reliability and successes after an ordered list of outcomes."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.5).alias("r"))
    step = lambda s, ok: F.when(ok, F.struct((s["n"] + 1).alias("n"), F.least(F.lit(0.5) + 0.1 * (s["n"] + 1), F.lit(1.0)).alias("r"))).otherwise(F.struct(s["n"].alias("n"), F.greatest(s["r"] - 0.15, F.lit(0.0)).alias("r")))
    done = F.aggregate("outcomes", start, step)
    return procedures.select("id", done["n"].alias("success_count"), F.round(done["r"], 6).alias("reliability"))


def procedures_for(queries: DataFrame, procedures: DataFrame, k: int = 3) -> DataFrame:
    """Procedures by similarity and reliability, each query's within its scope; no pairs of both are made."""
    return best_in_scope(queries, procedures.withColumn("prior", 0.3 * F.col("reliability")), k, 0.7)


def learn_procedures(recipes: DataFrame, now: Column, agent: str = "cli") -> DataFrame:
    """Memories of recipes (trigger, steps, scope, success_signal): redacted, embedded, of even reliability."""
    line = ft.redact(F.concat(F.lit("When "), F.col("trigger"), F.lit(": "), F.concat_ws("; ", "steps")))
    from memspark.operators.write import new_id

    rows = recipes.withColumn("content", line).withColumn("trigger", ft.redact(F.col("trigger")))
    parts = rows.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode_outer("steps").alias("_at", "_step")).withColumn("_step", ft.redact(F.col("_step")))
    keys = [c for c in rows.columns if c != "steps"]
    rows = parts.groupBy("_row", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_step"))), lambda x: x["_step"]).alias("steps"))
    made = rows.withColumns({
        "id": new_id(F.lit("procedure"), F.col("content"), F.col("scope")), "type": F.lit("procedure"), "cognitive": F.lit("procedural"), "importance": F.lit(0.6), "confidence": F.lit(0.6),
        "success_count": F.lit(0), "reliability": F.lit(0.5), "provenance": F.array(provenance(agent, "procedure", "user-asserted", at=now)), "vec": ft.hash_embed(F.col("content")),
        **{c: now for c in ("valid_from", "recorded_at", "created_at", "updated_at", "last_seen_at")},
    })
    return complete(made)


def record_outcomes(memories: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Procedures after results (id, seq, ok), in order: a success sets reliability from their number, a failure lowers it."""
    lists = results.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ok"))), lambda x: x["ok"]).alias("_ok"))
    both = complete(memories).join(lists, "id", "left")
    hit = F.col("_ok").isNotNull() & (F.col("type") == "procedure")
    start = F.struct(F.coalesce("success_count", F.lit(0)).cast("long").alias("n"), F.coalesce("reliability", F.lit(0.5)).alias("r"))
    lower = lambda s: F.greatest(s["r"] - 0.15, F.lit(0.0))
    step = lambda s, ok: F.when(ok, F.struct((s["n"] + 1).alias("n"), F.least(0.5 + 0.1 * (s["n"] + 1), F.lit(1.0)).alias("r"))).otherwise(F.struct(s["n"].alias("n"), lower(s).alias("r")))
    done, good = F.aggregate("_ok", start, step), F.size(F.filter("_ok", lambda x: x))
    new = {
        "success_count": F.when(hit, done["n"]).otherwise(F.col("success_count")), "reliability": F.when(hit, F.round(done["r"], 6)).otherwise(F.col("reliability")),
        "reinforced": F.col("reinforced") + F.when(hit, good).otherwise(0), "last_seen_at": F.when(hit & (good > 0), now).otherwise(F.col("last_seen_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return both.withColumns(new).drop("_ok")


def forget(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The listed memories are forgotten, softly: they stay until they are purged."""
    hit = F.coalesce("_hit", F.lit(False))
    both = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    both = both.withColumn("status", F.when(hit, F.lit("forgotten")).otherwise(F.col("status")))
    return both.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).select(*memories.columns)


def edit(memories: DataFrame, edits: DataFrame, now: Column, replica: str = "", clock: int | None = None) -> DataFrame:
    """Memories after edits (id, and content, scope, type, importance where they are to change; seq).

    Content is redacted and embedded again if it changed; importance is clamped; an edited memory gets a
    clock after all others, edits in the order of seq. Several edits of one memory: the last counts.
    ``clock`` is the largest there is, where memories aren't all.
    """
    last = edits.groupBy("id").agg(*[F.max_by(c, "seq").alias(f"_{c}") for c in ("content", "scope", "type", "importance")], F.max("seq").alias("_seq"))
    last = numbered(last, F.col("_seq"), F.col("id"), name="_at").withColumn("_tick", F.col("_at") + 1).drop("_at")
    m = complete(memories)
    top = m.agg(F.coalesce(F.max("clock"), F.lit(0))).first()[0] if clock is None else clock
    both = m.join(last, "id", "left")
    hit = F.col("_seq").isNotNull()
    both = both.withColumn("_content", ft.redact(F.col("_content")))
    changed = hit & F.col("_content").isNotNull() & (F.col("_content") != F.col("content"))
    kind = F.coalesce("_type", "type")
    signed = changed | hit & (kind != F.col("type"))  # what was signed is no longer said
    both = both.withColumns({
        **{c: F.when(~signed, F.col(c)) for c in ("sig", "signer", "sig_scheme")},
        "vec": F.when(changed, ft.hash_embed(F.coalesce("_content", F.lit("")))).otherwise(F.col("vec")), "content": F.coalesce("_content", "content"), "scope": F.coalesce("_scope", "scope"),
        "type": kind, "cognitive": F.when(F.col("_type").isNotNull(), cognitive_of(kind)).otherwise(F.col("cognitive")),
        "importance": F.when(F.col("_importance").isNull(), F.col("importance")).otherwise(F.least(F.greatest(F.col("_importance").cast("double"), F.lit(0.0)), F.lit(1.0))),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "clock": F.when(hit, F.lit(top) + F.col("_tick")).otherwise(F.col("clock")), "replica": F.when(hit, F.lit(replica)).otherwise(F.col("replica")),
    })
    return both.select(*m.columns)


def resolve_stale(memories: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Review verdicts (id, keep): kept memories lose their flags, the others are forgotten."""
    m = complete(memories)
    both = m.join(verdicts.groupBy("id").agg(F.min("keep").alias("_keep")), "id", "left")
    keep, gone = F.coalesce("_keep", F.lit(False)), F.coalesce(~F.col("_keep"), F.lit(False))
    both = both.withColumns({
        "stale": F.col("stale") & ~keep, "conflict": F.col("conflict") & ~keep, "stale_reason": F.when(~keep, F.col("stale_reason")),
        "status": F.when(gone, F.lit("forgotten")).otherwise(F.col("status")), "updated_at": F.when(F.col("_keep").isNotNull(), now).otherwise(F.col("updated_at")),
    })
    return both.select(*m.columns)


def reembed(memories: DataFrame, embed=ft.hash_embed) -> DataFrame:
    """Memories with vectors of another embedder, a function of a text column; hubs stay without."""
    return memories.withColumn("vec", F.when(~F.coalesce("hub", F.lit(False)), embed(F.coalesce("content", F.lit("")))))


def insights(memories: DataFrame, synthesize, least: int = 3, sources: int = 10, shown: int = 30) -> DataFrame:
    """scope, at, content, sources: what ``synthesize`` makes of each scope with enough to reflect on.

    ``synthesize`` maps a column with up to ``shown`` contents, newest first, to one with up to three
    insights; a hosted model is a pandas function, and there is none by default. Memories made that way
    aren't reflected on again.
    """
    m = complete(memories).filter("status = 'active' and not hub and not reflection")
    newest = Window.partitionBy("scope").orderBy(F.desc("created_at"), "id")
    sized = m.groupBy("scope").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    top = m.withColumn("_at", F.row_number().over(newest)).filter(F.col("_at") <= shown).join(sized, "scope")
    rows = F.array_sort(F.collect_list(F.struct("_at", "id", "content")))
    per = top.groupBy("scope").agg(rows.alias("rows"))
    made = per.select("scope", F.slice(synthesize(F.transform("rows", lambda x: x["content"])), 1, 3).alias("made"), F.transform(F.slice("rows", 1, sources), lambda x: x["id"]).alias("sources"))
    each = made.select("scope", F.posexplode("made").alias("at", "content"), "sources").withColumn("content", F.trim("content"))
    return each.filter("content <> ''")


def reflect(memories: DataFrame, edges: DataFrame, synthesize, now: Column, **how) -> dict[str, DataFrame]:
    """insights() written as memories that cite their sources by derived_from edges."""
    from memspark.operators import graph
    from memspark.operators.write import consolidate, new_id

    found = numbered(insights(memories, synthesize, **how), F.col("scope"), F.col("at"), name="seq")
    found = saved(found.withColumns({
        "id": new_id(F.lit("fact"), F.col("content"), F.col("scope")), "type": F.lit("fact"), "cognitive": F.lit("semantic"), "importance": F.lit(0.7), "confidence": F.lit(0.7), "reflection": F.lit(True),
        "provenance": F.array(provenance("reflect", "reflect", at=now)), "vec": ft.hash_embed(F.col("content")),
    }), "insights")
    out = consolidate(memories, edges, complete(found, "seq"), now)
    cited = out["decisions"].filter("op <> 'NOOP'").select("seq", "id").join(found.select("seq", F.explode("sources").alias("source")), "seq")
    out["edges"] = out["edges"].unionByName(cited.select(*graph.edge(F.col("id"), F.col("source"), "derived_from"))).dropDuplicates(["id"])
    return out
