"""Proposals and their review, signatures, the audit chain, access to what is known of a subject."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.operators import write
from memspark.schema import complete, provenance

AUDIT = "seq long, ts string, actor string, action string, target string, detail string, prev_hash string, hash string"
HMAC = "hmac-sha256"


def propose(facts: DataFrame, now: Column) -> DataFrame:
    """Quarantined memories of proposals (content, scope, contributor): redacted, embedded, to be reviewed.

    Equal proposals of a contributor get one id, so a second run adds nothing new.
    """
    clean = facts.withColumn("content", ft.redact(F.col("content")))
    made = clean.withColumns({
        "id": write.new_id(F.lit("fact"), F.col("content"), F.col("scope"), F.col("contributor")), "type": F.lit("fact"), "status": F.lit("quarantined"), "proposed": F.lit(True),
        "provenance": F.array(provenance(F.col("contributor"), "propose", at=now)), "vec": ft.hash_embed(F.col("content")),
        **{c: now for c in ("valid_from", "recorded_at", "created_at", "updated_at", "last_seen_at")},
    })
    return complete(made).dropDuplicates(["id"])


def review_incoming(memories: DataFrame, limit: int = 100) -> DataFrame:
    """id, content, from of quarantined memories, newest first."""
    rows = memories.filter("status = 'quarantined'").orderBy(F.desc("created_at"), "id").limit(limit)
    return rows.select("id", "content", F.coalesce("contributor", F.lit("?")).alias("from"))


def approve(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Listed memories that are quarantined become active."""
    m = complete(memories)
    both = m.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") == "quarantined")
    new = {"status": F.when(hit, F.lit("active")).otherwise(F.col("status")), "contributor": F.when(~hit, F.col("contributor")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return both.withColumns(new).select(*m.columns)


def reject(memories: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, tombstones) once the listed memories are discarded for good."""
    gone = ids.select("id").distinct()
    bury = memories.join(gone, "id", "left_semi").select(ft.fingerprint(F.col("type"), F.col("content")).alias("fp")).distinct()
    return memories.join(gone, "id", "left_anti"), bury


def payload() -> Column:
    """What a signature commits to: type and content without outer blanks."""
    return F.concat("type", F.lit("|"), F.trim("content"))


def hmac(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal, as columns."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signer_of(key: bytes) -> str:
    """A name for a key that doesn't tell it."""
    return hashlib.blake2b(key, digest_size=8).hexdigest()


def sign(memories: DataFrame, key: bytes, now: Column) -> DataFrame:
    """Active memories that have no signature get one; hubs don't."""
    m = complete(memories)
    due = (F.col("status") == "active") & ~F.col("hub") & F.col("sig").isNull()
    new = {
        "signer": F.when(due, F.lit(signer_of(key))).otherwise(F.col("signer")), "sig_scheme": F.when(due, F.lit(HMAC)).otherwise(F.col("sig_scheme")),
        "updated_at": F.when(due, now).otherwise(F.col("updated_at")), "sig": F.when(due, hmac(payload(), key)).otherwise(F.col("sig")),
    }
    return m.withColumns(new)


def verdicts(memories: DataFrame, key: bytes) -> DataFrame:
    """id, verdict of active memories: verified, tampered, unsigned."""
    m = complete(memories).filter("status = 'active' and not hub")
    ok = (F.col("sig_scheme") == HMAC) & (F.col("signer") == signer_of(key)) & (F.col("sig") == hmac(payload(), key))
    return m.select("id", F.when(F.col("sig").isNull(), "unsigned").when(F.coalesce(ok, F.lit(False)), "verified").otherwise("tampered").alias("verdict"))


def verify(memories: DataFrame, key: bytes) -> DataFrame:
    """verdict, n over all active memories."""
    return verdicts(memories, key).groupBy("verdict").agg(F.count("*").alias("n"))


def _hash(prev: str, row: dict) -> str:
    return hashlib.sha256("|".join([prev, *(row[c] for c in ("ts", "actor", "action", "target", "detail"))]).encode()).hexdigest()


def append_audit(audit: DataFrame | None, entries: DataFrame) -> DataFrame:
    """The chain with new entries (at, ts, actor, action, target, detail) behind it, in the order of at.

    Each entry's hash takes in the one before, so entries are chained by one task, one after the other,
    as they stream past; only new entries pass through it.
    """
    last = audit.orderBy(F.desc("seq")).limit(1).select("seq", "hash").collect() if audit is not None else []
    start, head = (last[0]["seq"] + 1, last[0]["hash"]) if last else (0, "")

    def run(batches):
        seq, prev = start, head
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                row = {c: row[c] or "" for c in ("ts", "actor", "action", "target", "detail")}
                now = _hash(prev, row)
                rows.append({"seq": seq, **row, "prev_hash": prev, "hash": now})
                seq, prev = seq + 1, now
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in AUDIT.split(", ")]))

    fields = ("ts", "actor", "action", "target", "detail")
    ordered = entries.select("at", *fields).repartitionByRange(1, "at").sortWithinPartitions("at", *fields).select(*fields)
    new = ordered.mapInArrow(run, AUDIT)
    return new if audit is None else audit.select(*new.columns).unionByName(new)


def audit_log(audit: DataFrame, limit: int = 100) -> DataFrame:
    """The newest entries first."""
    return audit.orderBy(F.desc("seq")).limit(limit)


def anchor(audit: DataFrame) -> DataFrame:
    """n, head: what to keep elsewhere, so that cutting off the newest entries shows."""
    return audit.agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("head"))


def subject_export(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """All that recall found of a subject, with lineage: qid, place, id, type, content, scope, confidence, created_at, provenance."""
    m = complete(memories).select("id", "type", "content", "scope", "confidence", "created_at", "provenance")
    said = F.transform("provenance", lambda p: F.struct(p["agent"].alias("agent"), p["extractor"].alias("extractor"), p["origin"].alias("origin")))
    return hits.select("qid", "place", "id").join(m, "id").withColumn("provenance", said)


def quarantined(facts: DataFrame, now: Column) -> DataFrame:
    """Quarantined memories of shared facts (type, content, scope, importance, confidence, contributor, fingerprint)."""
    made = facts.withColumns({
        "id": write.new_id(F.col("type"), F.col("content"), F.col("scope"), F.col("contributor")), "status": F.lit("quarantined"),
        "provenance": F.array(provenance(F.col("contributor"), "share", at=now)), "vec": ft.hash_embed(F.col("content")),
        **{c: now for c in ("valid_from", "recorded_at", "created_at", "updated_at", "last_seen_at")},
    })
    return complete(made).dropDuplicates(["id"])


def checked(facts: DataFrame, keys: list[bytes]) -> DataFrame:
    """Facts with signed, whether their signer's key is among those known here, and sig_ok, whether the signature follows from it."""
    own = F.lit(None).cast("string")
    for key in filter(None, keys):
        own = F.when(F.col("signer") == signer_of(key), hmac(payload(), key)).otherwise(own)
    signed = F.coalesce((F.col("sig_scheme") == HMAC) & F.col("sig").isNotNull() & own.isNotNull(), F.lit(False))
    return facts.withColumns({"signed": signed, "sig_ok": F.coalesce(F.col("sig") == own, F.lit(False))})


def import_share(memories: DataFrame, edges: DataFrame | None, facts: DataFrame, tombstones: DataFrame, trusted: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Shared facts by their verdict: trusted ones through consolidation, others into quarantine, the rest dropped."""
    from memspark.operators.trust import classify_import
    from memspark.session import numbered, saved

    judged = saved(classify_import(facts, tombstones, trusted), "judged")
    held = quarantined(judged.filter("verdict = 'quarantined'"), now).join(memories.select("id"), "id", "left_anti")
    fit = judged.filter("verdict = 'accepted'").withColumns({
        "id": write.new_id(F.col("type"), F.col("content"), F.col("scope"), F.col("contributor")), "vec": ft.hash_embed(F.col("content")),
        "provenance": F.array(provenance(F.col("contributor"), "share", at=now)),
    })
    out = write.consolidate(memories, edges, numbered(complete(fit), F.col("id"), name="seq"), now)
    out["memories"], out["changed"] = out["memories"].unionByName(held), out["changed"].unionByName(held)
    out["verdicts"] = judged.groupBy("verdict").agg(F.count("*").alias("n"))
    return out
