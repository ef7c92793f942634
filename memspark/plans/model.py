"""The model's relations over the driver tables, once as DataFrames and once as SQL.

Documents play memories (an id's remainders give it type, state and times), customers and orders a
graph, events a history, benchmark items the questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.schema import TYPES, cognitive_of, provenance
from memspark.session import few, ship

START, NOW = 1704067200, 1748736000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def now():
    return F.timestamp_seconds(F.lit(NOW))


def memories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    at = lambda s: F.timestamp_seconds(s)
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (i % 10 + 1).cast("int"))
    status = F.when(i % 17 == 0, "archived").when(i % 19 == 0, "superseded").when(i % 23 == 0, "forgotten").when(i % 29 == 0, "quarantined").otherwise("active")
    return table(spark, d, "documents").select(
        F.concat(F.lit("m"), i.cast("string")).alias("id"), kind.alias("type"), cognitive_of(kind).alias("cognitive"), F.col("text").alias("content"),
        F.when(i % 7 == 0, F.lit("global")).otherwise(F.concat(F.lit("project:"), F.col("source"))).alias("scope"),
        ((i % 11) / 10.0).alias("importance"), ((i % 13) / 12.0).alias("confidence"), status.alias("status"),
        at(F.lit(START) + i * 3600).alias("valid_from"), at(F.when(i % 5 == 0, F.lit(START) + i * 3600 + 2592000)).alias("valid_to"),
        at(F.lit(START) + i * 3600).alias("created_at"), at(F.lit(START) + i * 3700).alias("updated_at"), at(F.lit(START) + i * 3650).alias("last_seen_at"),
        (i % 4).cast("double").alias("reinforced"), (i % 97 == 0).alias("hub"), (i % 31 == 0).alias("stale"), (i % 3).alias("clock"),
        F.concat(F.lit("r"), (i % 2).cast("string")).alias("replica"), F.when(i % 37 == 0, F.lit("public")).alias("visibility"), i.alias("n"),
    )


_KIND = "[" + ", ".join(f"'{t}'" for t in TYPES) + "][CAST(doc_id % 10 AS INT) + 1]"
#: The same as a common table expression ``mem``.
MEM = f"""mem0 AS (SELECT *, {_KIND} AS kind FROM documents),
mem AS (SELECT 'm' || doc_id AS id, kind AS type,
  CASE WHEN kind IN ('identity','preference','project','decision','fact') THEN 'semantic' WHEN kind IN ('convention','snippet','procedure') THEN 'procedural' WHEN kind = 'episode' THEN 'episodic' ELSE 'entity' END AS cognitive,
  text AS content, CASE WHEN doc_id % 7 = 0 THEN 'global' ELSE 'project:' || source END AS scope,
  (doc_id % 11) / 10.0::DOUBLE AS importance, (doc_id % 13) / 12.0::DOUBLE AS confidence,
  CASE WHEN doc_id % 17 = 0 THEN 'archived' WHEN doc_id % 19 = 0 THEN 'superseded' WHEN doc_id % 23 = 0 THEN 'forgotten' WHEN doc_id % 29 = 0 THEN 'quarantined' ELSE 'active' END AS status,
  {START} + doc_id * 3600 AS valid_from, CASE WHEN doc_id % 5 = 0 THEN {START} + doc_id * 3600 + 2592000 END AS valid_to,
  {START} + doc_id * 3600 AS created_at, {START} + doc_id * 3700 AS updated_at, {START} + doc_id * 3650 AS last_seen_at,
  CAST(doc_id % 4 AS DOUBLE) AS reinforced, doc_id % 97 = 0 AS hub, doc_id % 31 = 0 AS stale, doc_id % 3 AS clock, 'r' || (doc_id % 2) AS replica,
  CASE WHEN doc_id % 37 = 0 THEN 'public' END AS visibility, doc_id AS n FROM mem0)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the memories that have one, with their scope and state."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vec"), F.col("vec_id"))
    return memories(spark, d).join(v, "id")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector, and the document of that id as text, asked against all; while they are few, no text is shuffled."""
    v = table(spark, d, "embeddings").filter(F.col("vec_id") % 100 == 0)
    t = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    scope = F.when(F.col("vec_id") % 200 == 0, F.concat(F.lit("project:"), F.col("source")))
    return few(v, 1024).join(t, "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), "text", scope.alias("scope"))


#: ``q``: the questions; ``vec``: vectors of memories.
QUESTIONS = """q AS (SELECT vec_id AS qid, embedding AS qv, text, CASE WHEN vec_id % 200 = 0 THEN 'project:' || source END AS scope
  FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 100 = 0),
vec AS (SELECT mem.*, embedding, vec_id FROM mem JOIN embeddings ON id = 'm' || vec_id)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A typed graph over memories: each is tied to the memories at a third and a half of its number."""
    m = memories(spark, d)
    rel = lambda div, name: m.filter(F.col("n") > 0).select(F.col("id").alias("from_id"), F.concat(F.lit("m"), F.floor(F.col("n") / div).cast("string")).alias("to_id"), name.alias("relation"))
    kinds = F.when(F.col("n") % 6 == 0, "supersedes").when(F.col("n") % 6 == 1, "conflicts_with").when(F.col("n") % 6 == 2, "derived_from").otherwise("related_to")
    return rel(3, kinds).unionByName(rel(2, F.lit("related_to"))).withColumn("weight", F.lit(1.0))


EDGES = """edg AS (
  SELECT id AS from_id, 'm' || (n // 3) AS to_id, CASE n % 6 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'conflicts_with' WHEN 2 THEN 'derived_from' ELSE 'related_to' END AS relation FROM mem WHERE n > 0
  UNION ALL SELECT id, 'm' || (n // 2), 'related_to' FROM mem WHERE n > 0),
adj AS (SELECT DISTINCT * FROM (SELECT from_id AS at, to_id AS nxt FROM edg UNION ALL SELECT to_id, from_id FROM edg))"""


#: How near the members of a group of eight facts are to its first: weights of its vector and of their own.
NEAR = [(0.0, 1.0), (1.0, 0.0), (0.985, 0.1726), (0.99, 0.1411), (0.9, 0.4359), (0.85, 0.5268), (0.7, 0.7141), (0.9, 0.4359)]
GROUP_TYPES = ["decision", "fact", "identity", "convention"]


def facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact for each vector, in groups of eight that are near one another: copies, refinements, contradictions.

    Those of the first kind of a group are known already, unless the group is a fourth one.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("own"))
    first = e.filter(F.col("n") % 8 == 0).select(F.floor(F.col("n") / 8).alias("g"), F.col("own").alias("lead"))
    both = e.withColumn("g", F.floor(F.col("n") / 8)).join(first, "g")
    r, g, n = (F.col("n") % 8).cast("int"), F.col("g"), F.col("n")
    weight = lambda k: F.element_at(F.array(*[F.lit(w[k]) for w in NEAR]), r + 1)
    vec = F.zip_with("lead", "own", lambda a, b: F.round(weight(0) * a + weight(1) * b, 6))
    said = F.when(n % 3 == 0, "We use").when(n % 3 == 1, "We no longer use").otherwise("The team runs")
    content = F.concat(said, F.lit(" Tool"), g, F.lit(" with Lib"), n % 4, F.lit(" for builds"), F.repeat(F.lit("!"), (n % 7).cast("int")))
    kind = F.element_at(F.array(*[F.lit(t) for t in GROUP_TYPES]), (g % 4 + 1).cast("int"))
    scope = F.when((g % 3 == 0) | (r == 5), F.lit("global")).otherwise(F.concat(F.lit("project:p"), g % 5))
    return both.select(
        n.alias("seq"), F.concat(F.lit("f"), n).alias("id"), kind.alias("type"), cognitive_of(kind).alias("cognitive"), content.alias("content"), scope.alias("scope"), vec.alias("vec"),
        ((n % 11) / 10.0).alias("importance"), ((n % 13) / 12.0).alias("confidence"), ((r == 0) & (g % 4 != 3)).alias("known"), n.alias("n"),
        F.array(provenance(F.concat(F.lit("a"), n % 2), "x")).alias("provenance"),
        *[F.timestamp_seconds(F.lit(START) + n * 3600).alias(c) for c in ("created_at", "updated_at", "last_seen_at", "valid_from")],
    )


#: ``fact``: the same.
FACTS = f"""fact AS (SELECT n AS seq, 'f' || n AS id, ['decision', 'fact', 'identity', 'convention'][CAST(g % 4 AS INT) + 1] AS type,
  (CASE n % 3 WHEN 0 THEN 'We use' WHEN 1 THEN 'We no longer use' ELSE 'The team runs' END) || ' Tool' || g || ' with Lib' || (n % 4) || ' for builds' || repeat('!', CAST(n % 7 AS INT)) AS content,
  CASE WHEN g % 3 = 0 OR n % 8 = 5 THEN 'global' ELSE 'project:p' || (g % 5) END AS scope,
  list_transform(range(1, 65), lambda i: round([0.0, 1.0, 0.985, 0.99, 0.9, 0.85, 0.7, 0.9][CAST(n % 8 AS INT) + 1]::DOUBLE * lead[i]::DOUBLE + [1.0, 0.0, 0.1726, 0.1411, 0.4359, 0.5268, 0.7141, 0.4359][CAST(n % 8 AS INT) + 1]::DOUBLE * own[i]::DOUBLE, 6)) AS vec,
  (n % 11) / 10.0::DOUBLE AS importance, (n % 13) / 12.0::DOUBLE AS confidence, n % 8 = 0 AND g % 4 <> 3 AS known, n, {START} + n * 3600 AS created_at
  FROM (SELECT a.vec_id AS n, a.vec_id // 8 AS g, a.embedding AS own, b.embedding AS lead FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 8))"""
