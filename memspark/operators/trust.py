"""Governance: erasure, sharing, import checks, hash chains, Merkle roots, conformance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions import text as ft
from memspark.operators.store import shareable, visibility
from memspark.schema import TYPES
from memspark.session import numbered, saved


def pii_flags(text) -> list:
    """Booleans for kinds of personal data that plain patterns find."""
    return [text.rlike(ft.EMAIL).alias("has_email"), text.rlike(ft.SSN).alias("has_ssn"), text.rlike(ft.IPV4).alias("has_ipv4")]


def bundle(memories: DataFrame, scope: str) -> DataFrame:
    """Facts of a scope for sharing: redacted, with visibility and fingerprint."""
    out = shareable(memories, scope).withColumn("content", ft.redact(F.col("content")))
    return out.select("id", "type", "content", "scope", "confidence", "importance", visibility(memories).alias("visibility"), ft.fingerprint(F.col("type"), F.col("content")).alias("fingerprint"))


def classify_import(facts: DataFrame, tombstones: DataFrame, trusted: DataFrame) -> DataFrame:
    """What happens with each shared fact: tampered, forged, erased, accepted, quarantined.

    ``facts`` has fingerprint and contributor, signed and sig_ok. Facts of one fingerprint count once.
    """
    own = ft.fingerprint(F.col("type"), F.col("content"))
    f = facts.withColumn("own", own)
    f = f.join(tombstones.select(F.col("fp").alias("own"), F.lit(True).alias("erased")).distinct(), "own", "left")
    f = f.join(trusted.select("contributor", F.lit(True).alias("known")).distinct(), "contributor", "left")
    verdict = F.when(F.col("own") != F.col("fingerprint"), "tampered").when(F.col("signed") & ~F.col("sig_ok"), "forged").when(F.col("erased"), "erased").when(F.col("known"), "accepted").otherwise("quarantined")
    f = f.withColumn("verdict", verdict).drop("erased", "known")
    # Of equal facts the one of the smallest id stays, or of the first contributor.
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "contributor", "scope", "content") if c in f.columns]
    first = F.min_by(F.struct(*f.columns), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    return f.groupBy("own", "verdict").agg(first.alias("x")).select("x.*")


def chain_breaks(audit: DataFrame) -> DataFrame:
    """seq, ok of each entry: its hash follows from its fields and the hash before it.

    Each entry is checked beside its predecessor by a join on seq, so no task sees the whole chain.
    """
    before = audit.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    fields = F.concat_ws("|", F.coalesce("before", F.lit("")), "ts", "actor", "action", "target", "detail")
    both = audit.join(before, "seq", "left")
    linked = F.col("prev_hash") == F.coalesce("before", F.lit(""))
    return both.select("seq", (linked & (F.sha2(fields, 256) == F.col("hash"))).alias("ok"))


def merkle_levels(leaves: DataFrame, fan: int = 2) -> DataFrame:
    """root of sorted leaf hashes (leaf), pairwise; an odd last one is paired with itself.

    Leaves are numbered range by range and written once; a level is an aggregation, and levels are
    written every few, so that no plan holds all of them.
    """
    level = numbered(leaves.select("leaf", F.monotonically_increasing_id().alias("tie")), F.col("leaf"), F.col("tie"), name="i").select("i", F.col("leaf").alias("h"))
    n, k = leaves.count(), 0
    while n > 1:
        pairs = level.groupBy(F.floor(F.col("i") / fan).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        level = pairs.select("i", F.sha2(F.concat("a", "b"), 256).alias("h"))
        n, k = -(-n // fan), k + 1
        level = saved(level, "merkle") if k % 8 == 0 else level
    return level.select(F.col("h").alias("root"))


def merkle_proofs(leaves: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """id, leaf, path: what leads from a leaf (id, leaf) to merkle_levels()'s root: hashes beside it, level by level, and whether they stand left.

    Of all leaves, or of ``wanted`` ids. A level's pairs are an aggregation, and a path takes one hash of
    each level by a join, so nothing grows but by the number of levels. Equal leaves have paths of their own.
    """
    level = numbered(leaves.select("id", "leaf"), F.col("leaf"), F.col("id"), name="i")
    paths = level if wanted is None else level.join(wanted.select("id").distinct(), "id", "left_semi")
    paths = paths.select("id", "leaf", F.col("i").alias("at"), F.array().cast("array<struct<hash:string,left:boolean>>").alias("path"))
    n, k = leaves.count(), 0
    level = level.select("i", F.col("leaf").alias("h"))
    while n > 1:
        pair = saved(level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b")), "pairs")
        odd = F.col("at") % 2 == 1
        step = F.struct(F.when(odd, F.col("a")).otherwise(F.col("b")).alias("hash"), odd.alias("left"))
        paths = paths.join(pair, F.floor(F.col("at") / 2) == F.col("i")).select("id", "leaf", F.col("i").alias("at"), F.concat("path", F.array(step)).alias("path"))
        level = pair.select("i", F.sha2(F.concat("a", "b"), 256).alias("h"))
        n, k = -(-n // 2), k + 1
        paths = saved(paths, "paths") if k % 8 == 0 else paths
    return paths.select("id", "leaf", "path")


def proven(proofs: DataFrame, root: str) -> DataFrame:
    """proofs (id, leaf, path) with ``ok``: whether the path leads from the leaf to the root; row by row, nothing else is needed."""
    up = lambda h, s: F.sha2(F.when(s["left"], F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])), 256)
    return proofs.withColumn("ok", F.coalesce(F.aggregate("path", F.col("leaf"), up) == F.lit(root), F.lit(False)))


def erase(memories: DataFrame, edges: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """What stays, what is buried, and which derived memories lose their ground."""
    gone = ids.select("id").distinct()
    bury = memories.join(gone, "id", "left_semi").select(ft.fingerprint(F.col("type"), F.col("content")).alias("fp")).distinct()
    kept_edges = edges.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    derived = edges.filter("relation = 'derived_from'").join(gone.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    return {"memories": memories.join(gone, "id", "left_anti"), "edges": kept_edges, "tombstones": bury, "derived": derived.join(gone, "id", "left_anti")}


def conformance(records: DataFrame) -> DataFrame:
    """doc, n_errors, valid, level of portable records: required fields, known types, score ranges."""
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing required '{c}'")) for c in ("id", "type", "content", "created_at", "provenance")]
    wrong = [F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), F.lit("unknown type")), F.when(~F.col("confidence").between(0, 1), F.lit("confidence out of range"))]
    errors = F.array_compact(F.array(*missing, *wrong))
    per = records.withColumn("e", F.size(errors)).groupBy("doc").agg(F.sum("e").alias("n_errors"), F.count("*").alias("count"), F.min(F.col("signature").isNotNull()).alias("signed"))
    return per.select("doc", "count", "n_errors", (F.col("n_errors") == 0).alias("valid"), F.when(F.col("n_errors") > 0, F.lit(None)).when(F.col("signed"), "signed").otherwise("core").alias("level"))


def macs(facts: DataFrame, key: bytes) -> DataFrame:
    """Keyed BLAKE2b of each fact's fingerprint text; Spark has no keyed digest, hence Python."""

    @F.pandas_udf(T.StringType())
    def mac(text: pd.Series) -> pd.Series:
        return text.map(lambda t: ft.mac_text(key, t))

    return facts.withColumn("mac", mac(F.concat("type", F.lit("|"), F.lower(F.trim("content")))))


def verify_macs(facts: DataFrame, key: bytes) -> DataFrame:
    """facts with ``ok``: whether their mac is that of macs()."""
    return macs(facts.withColumnRenamed("mac", "_said"), key).withColumn("ok", F.col("_said") == F.col("mac")).drop("mac").withColumnRenamed("_said", "mac")
