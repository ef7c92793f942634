"""Queries over retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.functions.vectors import nearest
from memspark.operators import evaluate, governance, retrieve, store
from memspark.operators.keywords import Keywords
from memspark.operators.lists import Lists
from memspark.plans import register, words
from memspark.plans.model import EDGES, MEM, NOW, QUESTIONS, edges, memories, now, questions, table, vectors
from memspark.session import folder, saved

_SEES = "(q.scope IS NULL OR {m}.scope = q.scope OR {m}.scope = 'global')"


def dense_sql(k: int = 50) -> str:
    return f"""dense AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1 AS rank, id, sim FROM (
  SELECT qid, vec.id, round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS sim FROM q, vec
  WHERE vec.status = 'active' AND NOT vec.hub AND {_SEES.format(m='vec')}) QUALIFY rank < {k})"""


def bm25_sql(k: int = 50, q: str = "q") -> str:
    return f"""live AS (SELECT id, scope, regexp_extract_all(lower(content), '[a-z0-9]+') AS words FROM mem WHERE status = 'active' AND NOT hub),
post AS (SELECT token, id, scope, len, count(*) AS tf FROM (SELECT id, scope, len(words) AS len, unnest(words) AS token FROM live) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
st AS (SELECT count(*) AS docs, avg(len(words)) AS avg_len FROM live),
words0 AS (SELECT qid, scope, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS k FROM {q}),
terms AS (SELECT qid, scope, token FROM (SELECT qid, scope, token, min(k) AS k FROM words0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k) <= 12),
sparse AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank, id, score FROM (
  SELECT qid, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM terms AS q JOIN post USING (token) JOIN df USING (token), st WHERE {_SEES.format(m='post')} GROUP BY qid, id) QUALIFY rank < {k})"""


_FUSED = """fused AS (SELECT qid, id, round(raw / max(raw) OVER (PARTITION BY qid), 9) AS rrf FROM (
  SELECT qid, id, sum(1.0 / (61 + rank)) AS raw FROM (SELECT qid, rank, id FROM dense UNION ALL SELECT qid, rank, id FROM sparse) GROUP BY qid, id))"""
# One step from the five best, two for questions that span subjects.
_GRAPH = f"""seed AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) <= 5),
deep AS (SELECT qid FROM q WHERE {words.multi_hop('text')}),
one AS (SELECT DISTINCT qid, seed.id AS seed, nxt AS id, rrf FROM seed JOIN adj ON seed.id = adj.at),
reach AS (SELECT * FROM (SELECT * FROM one UNION SELECT qid, seed, nxt, rrf FROM one JOIN adj ON one.id = adj.at WHERE qid IN (SELECT qid FROM deep)) WHERE id <> seed),
graph AS (SELECT qid, id, round(raw / max(raw) OVER (PARTITION BY qid), 9) AS graph FROM (SELECT qid, id, sum(rrf) AS raw FROM reach GROUP BY qid, id))"""
SALIENCE = f"importance * pow(2.0, -greatest(({NOW} - last_seen_at) / 86400.0, 0) / ((CASE cognitive WHEN 'episodic' THEN 7.0 WHEN 'procedural' THEN 90.0 ELSE 3650.0 END) * pow(1.15, reinforced)))"
_RECENCY = f"pow(2.0, -greatest(({NOW} - last_seen_at) / 86400.0, 0) / 30.0)"
_SCORED = f"""scored AS (SELECT *, round((0.35 * rrf + 0.22 * greatest(sim, 0) + 0.12 * {SALIENCE} + 0.08 * {_RECENCY} + 0.08 * confidence + 0.15 * graph) * CASE WHEN stale THEN 0.6 ELSE 1.0 END, 6) AS score FROM (
  SELECT q.qid, x.id, coalesce(rrf, 0) AS rrf, coalesce(sim, 0) AS sim, coalesce(graph, 0) AS graph, mem.* EXCLUDE (id)
  FROM (SELECT qid, id, rrf, graph FROM fused FULL JOIN graph USING (qid, id)) AS x LEFT JOIN dense USING (qid, id) JOIN q USING (qid) JOIN mem ON mem.id = x.id
  WHERE mem.status = 'active' AND NOT mem.hub AND {_SEES.format(m='mem')})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS words FROM scored)"""


def legs(k: int = 50) -> str:
    return f"WITH RECURSIVE {MEM}, {QUESTIONS}, {EDGES}, {dense_sql(k)}, {bm25_sql(k)}, {_FUSED}"


def greedy_sql(k: int, same: float, source: str, pick: str, chosen: str) -> str:
    """``chosen``: rank and place of at most k rows of ``source``, in rank order, none too similar to one kept before."""
    return f"""{pick} AS (SELECT DISTINCT qid, CAST(-1 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept FROM {source}
  UNION ALL SELECT p.qid, r.rank, CASE WHEN len(p.kept) >= {k} OR EXISTS (SELECT 1 FROM {source} o WHERE o.qid = r.qid AND list_contains(p.kept, o.rank)
      AND len(o.words) > 0 AND len(r.words) > 0 AND len(list_intersect(o.words, r.words)) >= {same} * (len(o.words) + len(r.words) - len(list_intersect(o.words, r.words)))) THEN p.kept ELSE list_append(p.kept, r.rank) END
  FROM {pick} p JOIN {source} r ON r.qid = p.qid AND r.rank = p.rank + 1),
{chosen} AS (SELECT qid, unnest(kept) AS rank, generate_subscripts(kept, 1) - 1 AS place FROM (SELECT qid, max_by(kept, rank) AS kept FROM {pick} GROUP BY qid))"""


def recall_sql(k: int = 8, leg: int = 50) -> str:
    return f"{legs(leg)}, {_GRAPH}, {_SCORED}, {greedy_sql(k, 0.9, 'ranked', 'pick', 'chosen')}"


def _texts(spark, d):
    """All memories that can surface, without vectors."""
    return memories(spark, d).filter("status = 'active' and not hub")


def _live(spark, d):
    """The same with vectors, those without one too."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return _texts(spark, d).join(v, "id", "left")


def _all(spark, d):
    """Questions, memories without vectors, the graph and the time; recall takes _vectors() beside them."""
    return questions(spark, d), _texts(spark, d), edges(spark, d), now()


def _vectors(spark, d):
    """The vectors of all memories that can surface and have one, without texts."""
    return vectors(spark, d).select("id", "scope", "status", "hub", F.col("vec").cast("array<double>").alias("vec"))


@register("r01_dense_topk", """WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)
SELECT qid, rank, id, sim FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1 AS rank, id, sim FROM (
  SELECT qid, CAST(vec_id AS VARCHAR) AS id, round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS sim FROM q, embeddings)) WHERE rank < 10""")
def r01(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("scope"))
    return nearest(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit("global").alias("scope")), 10)


@register("r01b_scoped_topk", f"WITH {MEM}, {QUESTIONS}, {dense_sql()} SELECT qid, rank, id, sim FROM dense")
def r01b(spark, d):
    return retrieve.dense(questions(spark, d), _live(spark, d))


@register("r01c_kept_vectors", f"WITH {MEM}, {QUESTIONS}, {dense_sql()} SELECT qid, rank, id, sim FROM dense")
def r01c(spark, d):
    """The same from kept lists, after two additions, of which some are replaced and some go."""
    index, m = Lists(spark, folder(spark, "lists")), vectors(spark, d)
    live, other = m.filter("status = 'active' and not hub"), m.filter("not (status = 'active' and not hub)")
    some = lambda x, r: x.filter(F.col("n") % 3 == r).select("id", "scope", F.col("vec").cast("array<double>").alias("vec"))
    early = some(live, 0).withColumn("vec", F.reverse("vec"))
    index.put(early.unionByName(some(live, 1)).unionByName(some(other, 1)), new=True)
    index.put(some(live, 0).unionByName(some(live, 2)))
    index.remove(other.select("id"))
    return index.nearest(questions(spark, d), retrieve.CANDIDATES)


@register("j01_vectors_of_memories", f"WITH {MEM}, {QUESTIONS} SELECT id, scope, label FROM vec JOIN (SELECT vec_id AS v, label FROM embeddings) ON v = vec_id")
def j01(spark, d):
    labels = table(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("id"), "label")
    return memories(spark, d).join(labels, "id").select("id", "scope", "label")


@register("r02_bm25", f"WITH {MEM}, {QUESTIONS}, {bm25_sql()} SELECT qid, rank, id, score FROM sparse")
def r02(spark, d):
    return retrieve.bm25(questions(spark, d), _texts(spark, d))


@register("r02b_kept_keywords", f"WITH {MEM}, {QUESTIONS}, {bm25_sql()} SELECT qid, rank, id, score FROM sparse")
def r02b(spark, d):
    """The same from a kept index, after two additions, of which some are replaced and some go."""
    index, m = Keywords(spark, folder(spark, "keywords")), memories(spark, d)
    live, other = m.filter("status = 'active' and not hub"), m.filter("not (status = 'active' and not hub)")
    some = lambda x, r: x.filter(F.col("n") % 3 == r).select("id", "scope", "content")
    early = some(live, 0).withColumn("content", F.concat(F.lit("an earlier text of "), "id"))
    index.put(early.unionByName(some(live, 1)).unionByName(some(other, 1)), new=True)
    index.put(some(live, 0).unionByName(some(live, 2)))
    index.remove(other.select("id"))
    return index.bm25(questions(spark, d))


@register("w03_keyword_scores", f"WITH {MEM}, {QUESTIONS}, {bm25_sql()} SELECT qid, id, round(1.0 / (rank + 1), 9) AS score FROM sparse")
def w03(spark, d):
    return retrieve.keyword_scores(retrieve.bm25(questions(spark, d), _texts(spark, d))).select("qid", "id", F.round("score", 9).alias("score"))


@register("r03_keyword_hits", f"""WITH {MEM}, {QUESTIONS}, w AS (SELECT qid, scope, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x, regexp_extract_all(lower(text), '[a-z0-9]+') AS raw FROM q),
t AS (SELECT qid, scope, list_slice(list_sort(x, 'ASC'), 1, 0) AS none, list_filter(raw, lambda e, i: list_position(raw, e) = i) AS terms FROM w),
s AS (SELECT q.qid, mem.id, CAST(len(list_filter(q.terms[1:8], lambda e: contains(lower(mem.content), e))) AS DOUBLE) AS score FROM t AS q, mem WHERE mem.status = 'active' AND NOT mem.hub AND {_SEES.format(m='mem')})
SELECT qid, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s WHERE score > 0) WHERE rank < 50""")
def r03(spark, d):
    return retrieve.keyword_hits(questions(spark, d), _texts(spark, d))


@register("r04_hybrid_rrf", f"{legs()} SELECT qid, id, rrf FROM fused")
def r04(spark, d):
    q = questions(spark, d)
    return retrieve.fuse(retrieve.dense(q, _live(spark, d)), retrieve.bm25(q, _texts(spark, d)))


@register("r05_graph_mass", f"{legs()}, {_GRAPH} SELECT qid, id, graph FROM graph")
def r05(spark, d):
    deep = questions(spark, d).select("qid", ft.multi_hop(F.col("text")).alias("deep"))
    return retrieve.graph_mass(saved(r04(spark, d), "fused"), edges(spark, d), deep=deep)


@register("r06_score", f"{legs()}, {_GRAPH}, {_SCORED} SELECT qid, id, score FROM scored")
def r06(spark, d):
    return retrieve.candidates_of(*_all(spark, d), vectors=_vectors(spark, d)).select("qid", "id", "score")


@register("r12_recall", f"{recall_sql()} SELECT qid, place, id, score FROM chosen JOIN ranked USING (qid, rank)")
def r12(spark, d):
    return retrieve.recall(*_all(spark, d), vectors=_vectors(spark, d)).select("qid", "place", "id", "score")


@register("r14_about", f"""{recall_sql()}, best AS (SELECT qid, id FROM chosen JOIN ranked USING (qid, rank) WHERE place = 0),
near AS (SELECT DISTINCT qid, nxt AS id FROM best JOIN adj ON best.id = adj.at WHERE nxt <> best.id)
SELECT qid, id, type FROM (SELECT qid, id, type, hub FROM near JOIN mem USING (id) WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY id) <= 5) WHERE NOT hub""")
def r14(spark, d):
    q, _, e, t = _all(spark, d)
    return retrieve.about(q, memories(spark, d), e, t, vectors=_vectors(spark, d))[1].select("qid", "id", "type")


@register("r14b_about_facts", f"{recall_sql()} SELECT qid, place, id, type, round_even(confidence, 2) AS confidence, stale FROM chosen JOIN ranked USING (qid, rank)")
def r14b(spark, d):
    return retrieve.about(*_all(spark, d), vectors=_vectors(spark, d))[0].select("qid", "place", "id", "type", "confidence", "stale")


@register("f10_proactive", f"""{recall_sql(12)} SELECT qid, id, score FROM chosen JOIN ranked USING (qid, rank) WHERE confidence >= 0.6 AND NOT stale QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 3""")
def f10(spark, d):
    return retrieve.proactive(*_all(spark, d), vectors=_vectors(spark, d)).select("qid", "id", "score")


_RERANK = """rr0 AS (SELECT c.qid, c.place, r.id, r.score, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS asked, regexp_extract_all(lower(r.content), '[a-z0-9]+') AS ws FROM chosen c JOIN ranked r USING (qid, rank) JOIN q USING (qid)),
rr AS (SELECT qid, id, place, CASE WHEN place < 25 THEN round(0.5 * score + 0.5 * CASE WHEN len(asked) > 0 AND len(ws) > 0 THEN 0.7 * len(list_intersect(asked, list_distinct(ws))) / len(asked) + 0.3 * len(list_filter(ws, lambda t: list_contains(asked, t))) / len(ws) ELSE 0 END, 6) ELSE round(score, 6) END AS final FROM rr0),
again AS (SELECT qid, id, final, row_number() OVER (PARTITION BY qid ORDER BY place >= 25, CASE WHEN place < 25 THEN -final ELSE place END, id) - 1 AS place FROM rr)"""


@register("r09_lexical_rerank", f"{recall_sql(30)}, {_RERANK} SELECT qid, place, id, final FROM again")
def r09(spark, d):
    hits = retrieve.recall(*_all(spark, d), vectors=_vectors(spark, d), k=retrieve.RERANK_FETCH).drop("rank").withColumnRenamed("place", "rank")
    return retrieve.rerank(hits, questions(spark, d)).select("qid", "place", "id", "final")


@register("r11_recall_reranked", f"{recall_sql(30)}, {_RERANK} SELECT qid, place, id, final AS score FROM again WHERE place < 8")
def r11(spark, d):
    return retrieve.recall(*_all(spark, d), vectors=_vectors(spark, d), reranker=retrieve.lexical).select("qid", "place", "id", "score")


@register("r10_cross_rerank", f"""{recall_sql(30)}, m AS (SELECT c.qid, c.place, r.id, r.score, length(r.content) % 97 AS raw FROM chosen c JOIN ranked r USING (qid, rank)), lo AS (SELECT qid, min(raw) AS lo, max(raw) AS hi FROM m WHERE place < 25 GROUP BY qid),
f AS (SELECT qid, id, place, CASE WHEN place < 25 THEN round(0.5 * score + 0.5 * (raw - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END, 6) ELSE round(score, 6) END AS final FROM m JOIN lo USING (qid))
SELECT qid, id, final, row_number() OVER (PARTITION BY qid ORDER BY place >= 25, CASE WHEN place < 25 THEN -final ELSE place END, id) - 1 AS place FROM f""")
def r10(spark, d):
    hits = retrieve.recall(*_all(spark, d), vectors=_vectors(spark, d), k=retrieve.RERANK_FETCH).drop("rank").withColumnRenamed("place", "rank")
    return retrieve.cross_rerank(hits, questions(spark, d), lambda question, content: F.length(content) % 97).select("qid", "id", "final", "place")


@register("r08_budget", f"""{legs()}, {_GRAPH}, {_SCORED}, c AS (SELECT qid, rank, id, greatest(length(content) // 4, 1) AS cost FROM ranked),
s AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS spent FROM c)
SELECT qid, id, cost, CAST(spent AS BIGINT) AS spent FROM s QUALIFY max(CASE WHEN spent > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) = 0""")
def r08(spark, d):
    ranked = retrieve.candidates_of(*_all(spark, d), vectors=_vectors(spark, d)).select("qid", "id", "rank").join(memories(spark, d).select("id", "content"), "id")
    return retrieve.within_budget(ranked).select("qid", "id", "cost", "spent")


@register("w05_edge_order", f"""{recall_sql()}, n AS (SELECT qid, id, place AS i, count(*) OVER (PARTITION BY qid) AS n FROM chosen JOIN ranked USING (qid, rank))
SELECT qid, id, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS BIGINT) AS position FROM n""")
def w05(spark, d):
    return retrieve.edges_first(retrieve.recall(*_all(spark, d), vectors=_vectors(spark, d)), "place").select("qid", "id", "position")


_PACK = f"""strong AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY first) - 1 AS rank FROM hits WHERE score >= 0.22 * best),
{greedy_sql(1000000, 0.85, 'strong', 'pick2', 'kept')},
cost AS (SELECT qid, rank, type, content, greatest(length(content) // 4, 1) AS cost FROM kept JOIN strong USING (qid, rank)),
fits AS (SELECT * FROM (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS spent FROM cost) QUALIFY max(CASE WHEN spent > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) = 0),
put AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY qid) AS n FROM fits)
SELECT qid, count(*) AS n_facts, CAST(sum(cost) AS BIGINT) AS n_tokens, md5(string_agg('- (' || type || ') ' || content, chr(10) ORDER BY CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END)) AS context_md5 FROM put GROUP BY qid"""


def _packed(df):
    return df.select("qid", "n_facts", "n_tokens", F.md5("context").alias("context_md5"))


@register("r13_context", f"{recall_sql(20)}, hits AS (SELECT c.qid, c.place AS first, c.place AS rank, r.type, r.content, r.score, r.words, max(r.score) OVER (PARTITION BY c.qid) AS best FROM chosen c JOIN ranked r USING (qid, rank)), {_PACK}")
def r13(spark, d):
    return _packed(retrieve.context(*_all(spark, d), vectors=_vectors(spark, d)))


_STANDING = f"""scopes AS (SELECT DISTINCT scope FROM mem UNION ALL SELECT NULL), asked AS (SELECT row_number() OVER (ORDER BY scope NULLS LAST) AS qid, scope AS q_scope FROM scopes),
live AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id) AS own, row_number() OVER (ORDER BY created_at DESC, id) AS any_ FROM mem WHERE status = 'active'),
s AS (SELECT qid, id, type, content, round({SALIENCE}, 9) AS score FROM asked JOIN live ON (scope = q_scope AND own <= 200) OR (q_scope IS NULL AND any_ <= 200) WHERE NOT hub),
stand AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s QUALIFY rank < 20)"""


def _scopes(spark, d):
    s = memories(spark, d).select("scope").distinct().unionByName(spark.createDataFrame([(None,)], "scope string"))
    return s.select(F.row_number().over(Window.orderBy(F.col("scope").asc_nulls_last())).cast("long").alias("qid"), F.lit(None).cast("string").alias("text"), "scope", F.lit(None).cast("array<double>").alias("vec"))


@register("k04_standing", f"WITH {MEM}, {_STANDING} SELECT qid, rank, id, score FROM stand")
def k04(spark, d):
    return retrieve.standing(_scopes(spark, d), memories(spark, d), now()).select("qid", "rank", "id", "score")


@register("r13b_context_open", f"WITH RECURSIVE {MEM}, {_STANDING}, hits AS (SELECT qid, rank AS first, rank, type, content, score, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS words, max(score) OVER (PARTITION BY qid) AS best FROM stand), {_PACK}")
def r13b(spark, d):
    _, _, e, t = _all(spark, d)
    return _packed(retrieve.context(_scopes(spark, d), memories(spark, d), e, t, vectors=_vectors(spark, d)))


@register("r15_export_subject", f"{recall_sql(40)} SELECT qid, place, id, type, scope, confidence, created_at FROM chosen JOIN ranked USING (qid, rank)")
def r15(spark, d):
    q, m, e, t = _all(spark, d)
    found = governance.subject_export(retrieve.recall(q, m, e, t, 40, vectors=_vectors(spark, d)), m)
    return found.select("qid", "place", "id", "type", "scope", "confidence", F.unix_timestamp("created_at").alias("created_at"))


@register("f11b_hit_cards", f"{recall_sql()} SELECT qid, place, id, round_even(score, 4) AS score, round_even(sim, 4) AS similarity, round_even({SALIENCE}, 4) AS salience, strftime(make_timestamp(valid_from * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS valid_from FROM chosen JOIN ranked USING (qid, rank)")
def f11b(spark, d):
    q, m, e, t = _all(spark, d)
    return store.hit_cards(retrieve.recall(q, m, e, t, vectors=_vectors(spark, d)), m, t).select("qid", "place", "id", "score", "similarity", "salience", "valid_from")


@register("f12_flag_cards", f"WITH {MEM} SELECT id, status, stale, false AS conflict, false AS signed, CAST(reinforced AS INT) AS reinforced FROM mem")
def f12(spark, d):
    return store.flagged(memories(spark, d)).select("id", "status", "stale", "conflict", "signed", "reinforced")


@register("r17_neighbors_1", f"WITH {MEM}, {EDGES} SELECT DISTINCT CAST(n AS BIGINT) AS key, nxt AS id FROM mem JOIN adj ON mem.id = adj.at WHERE n % 100 = 0 AND nxt <> mem.id")
def r17a(spark, d):
    return retrieve.neighbours(_hundredth(spark, d), edges(spark, d), 1)


@register("r17_neighbors_2", f"""WITH RECURSIVE {MEM}, {EDGES}, w AS (SELECT n AS key, id, id AS seed, 0 AS depth FROM mem WHERE n % 100 = 0
UNION SELECT key, nxt, seed, depth + 1 FROM w JOIN adj ON w.id = adj.at WHERE depth < 2) SELECT DISTINCT CAST(key AS BIGINT) AS key, id FROM w WHERE id <> seed""")
def r17b(spark, d):
    return retrieve.neighbours(_hundredth(spark, d), edges(spark, d), 2)


def _hundredth(spark, d):
    return memories(spark, d).filter(F.col("n") % 100 == 0).select(F.col("n").alias("key"), "id")


@register("e01_precision_recall_mrr", f"""WITH {MEM}, b AS (SELECT item_id AS qid, text, CAST(NULL AS VARCHAR) AS scope, lower(trim(text)) AS gold FROM benchmark), {bm25_sql(5, 'b')},
r AS (SELECT qid, rank, contains(lower(trim(content)), gold) OR contains(gold, lower(trim(content))) AS ok FROM sparse JOIN b USING (qid) JOIN mem USING (id)),
p AS (SELECT qid, count(*) AS shown, count(*) FILTER (ok) AS good, min(rank) FILTER (ok) AS first FROM r GROUP BY qid)
SELECT b.qid, round(coalesce(good, 0) / greatest(coalesce(shown, 0), 1), 6) AS precision, CASE WHEN coalesce(good, 0) > 0 THEN 1.0 ELSE 0.0 END AS recall, round(coalesce(1.0 / (first + 1), 0), 6) AS rr FROM b LEFT JOIN p USING (qid)""")
def e01(spark, d):
    gold = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").alias("gold_id"), "text")
    m = _texts(spark, d)
    found = retrieve.bm25(gold.select("qid", "text", F.lit(None).cast("string").alias("scope")), m, 5)
    return evaluate.at_k(found.select("qid", "rank", "id").join(m.select("id", "content"), "id"), gold)


@register("e04_percentiles", """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (i >= round_even(0.5 * (n - 1), 0)) AS p50, min(value) FILTER (i >= round_even(0.95 * (n - 1), 0)) AS p95 FROM o GROUP BY event_type""")
def e04(spark, d):
    return evaluate.nearest_rank(table(spark, d, "events"), "value", "event_type")


@register("t05_jaccard_pairs", """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
SELECT a.item_id AS a, c.item_id AS b, round(len(list_intersect(a.w, c.w)) / (len(a.w) + len(c.w) - len(list_intersect(a.w, c.w))), 6) AS sim FROM b a JOIN b c ON a.item_id < c.item_id
WHERE len(a.w) > 0 AND len(c.w) > 0 AND len(list_intersect(a.w, c.w)) >= 0.1 * (len(a.w) + len(c.w) - len(list_intersect(a.w, c.w)))""")
def t05(spark, d):
    w = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), ft.tokens(F.col("text")).alias("words"))
    return evaluate.similar_sets(w, 0.1).withColumn("sim", F.round("sim", 6))
