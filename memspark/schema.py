"""The data model: kinds, states, and the columns of the relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the model.
TYPES = ["identity", "preference", "project", "decision", "entity", "convention", "snippet", "procedure", "episode", "fact"]
STATUSES = ["active", "archived", "forgotten", "superseded", "quarantined"]
ORIGINS = ["user-asserted", "agent-ingested"]
COGNITIVE = {
    "identity": "semantic", "preference": "semantic", "project": "semantic", "decision": "semantic", "fact": "semantic",
    "convention": "procedural", "snippet": "procedural", "procedure": "procedural", "episode": "episodic", "entity": "entity",
}
VISIBILITIES = ["personal", "team", "public"]
GLOBAL = "global"

_PROVENANCE = "array<struct<agent:string,ref:string,extractor:string,origin:string,ingested_at:timestamp>>"
#: Columns of a memory, their types, and what stands for one that a table hasn't.
MEMORIES: dict[str, tuple[str, object]] = {
    "id": ("string", None), "type": ("string", "fact"), "cognitive": ("string", "semantic"), "content": ("string", ""), "scope": ("string", GLOBAL),
    "importance": ("double", 0.5), "confidence": ("double", 0.5), "status": ("string", "active"),
    "valid_from": ("timestamp", None), "valid_to": ("timestamp", None), "recorded_at": ("timestamp", None), "created_at": ("timestamp", None),
    "updated_at": ("timestamp", None), "last_seen_at": ("timestamp", None), "reinforced": ("double", 0.0), "hub": ("boolean", False),
    "stale": ("boolean", False), "stale_reason": ("string", None), "conflict": ("boolean", False), "consolidated": ("boolean", False),
    "reflection": ("boolean", False), "clock": ("bigint", 0), "replica": ("string", ""), "visibility": ("string", None),
    "contributor": ("string", None), "proposed": ("boolean", False), "sig": ("string", None), "signer": ("string", None), "sig_scheme": ("string", None),
    "provenance": (_PROVENANCE, []), "attributes": ("map<string,string>", {}), "trigger": ("string", None), "steps": ("array<string>", None),
    "success_signal": ("string", None), "success_count": ("bigint", 0), "reliability": ("double", None), "vec": ("array<double>", None),
}
PROVENANCE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("agent", "ref", "extractor", "origin")] + [T.StructField("ingested_at", T.TimestampType())]))
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "from_id", "to_id", "relation")] + [T.StructField("weight", T.DoubleType())])


def cognitive_of(kind: Column) -> Column:
    """The cognitive kind of a memory type."""
    pairs = [F.lit(x) for kv in COGNITIVE.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit("semantic"))


def _default(kind: str, value: object) -> Column:
    if value == []:
        return F.array().cast(kind)
    if value == {}:
        return F.create_map().cast(kind)
    return F.lit(value).cast(kind)


def complete(memories: DataFrame, *more: str) -> DataFrame:
    """A table of memories with all columns of the model; of further ones those named are kept."""
    have = set(memories.columns)
    return memories.select(*more, *[(F.col(n).cast(k) if n in have else _default(k, v)).alias(n) for n, (k, v) in MEMORIES.items()])


def provenance(agent: Column | str, extractor: Column | str, origin: str = "agent-ingested", ref: Column | None = None, at: Column | None = None) -> Column:
    """Where a memory comes from, as an element of its provenance."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None)
    return F.struct(
        text(agent).cast("string").alias("agent"), (none if ref is None else ref).cast("string").alias("ref"), text(extractor).cast("string").alias("extractor"),
        F.lit(origin).alias("origin"), (none if at is None else at).cast("timestamp").alias("ingested_at"),
    )
