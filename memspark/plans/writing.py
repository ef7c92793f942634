"""Queries over the write path, lifecycle verbs, governance and merging, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.engine import Engine
from memspark.functions import text as ft
from memspark.functions.vectors import nearest
from memspark.operators import analytics, evaluate, governance, graph, lifecycle, merge, ranges, retrieve, write
from memspark.plans import register, words
from memspark.plans.model import EDGES, FACTS, MEM, NOW, edges, facts, memories, now, table
from memspark.schema import complete, provenance
from memspark.session import folder, saved
from memspark.sources import demo


def fold_sql(old: str, new: str, order: str) -> str:
    """``fold``: the state of the store step by step (flag 0), and one decision a step (flag 1), in order.

    ``old`` and ``new`` are relations with id, scope, type, content, vec; new ones have seq.
    """
    return f"""cand AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM {new}),
fold AS (SELECT CAST(0 AS BIGINT) AS step, 0 AS flag, id, scope, type, content, vec, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS near_id, CAST(NULL AS DOUBLE) AS sim, false AS conflict FROM {old}
UNION ALL SELECT step + 1, CASE k WHEN 2 THEN 1 ELSE 0 END,
  CASE k WHEN 0 THEN id WHEN 1 THEN c_id ELSE CASE WHEN op IN ('NOOP', 'UPDATE') THEN id ELSE c_id END END, CASE k WHEN 0 THEN scope ELSE c_scope END, CASE k WHEN 0 THEN type ELSE c_type END,
  CASE WHEN k = 0 AND NOT swap THEN content ELSE c_content END, CASE WHEN k = 0 AND NOT swap THEN vec ELSE c_vec END, CASE k WHEN 2 THEN c_seq END, CASE k WHEN 2 THEN op END,
  CASE WHEN k = 2 AND vis THEN id END, CASE WHEN k = 2 AND vis THEN sim END, k = 2 AND op = 'ADD' AND same AND sim >= 0.65 AND neg
  FROM (SELECT *, rn = 1 AND op = 'UPDATE' AND length(c_content) > length(content) AS swap FROM (
    SELECT *, CASE WHEN rn <> 1 THEN NULL WHEN same AND sim >= 0.97 THEN 'NOOP' WHEN same AND sim >= 0.82 AND neg THEN 'SUPERSEDE' WHEN same AND sim >= 0.82 THEN 'UPDATE' ELSE 'ADD' END AS op FROM (
      SELECT *, vis AND type = c_type AS same, {words.against('c_content', 'c_type')} AS neg, row_number() OVER (ORDER BY vis DESC, sim DESC, id) AS rn FROM (
        SELECT f.step, f.id, f.scope, f.type, f.content, f.vec, c.id AS c_id, c.scope AS c_scope, c.type AS c_type, c.content AS c_content, c.vec AS c_vec, c.seq AS c_seq,
          f.scope = c.scope OR f.scope = 'global' AS vis, round(list_dot_product(f.vec, c.vec), 6) AS sim FROM fold f JOIN cand c ON c.rk = f.step + 1 WHERE f.flag = 0))))
  CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE (k = 0 AND coalesce(op, '') <> 'SUPERSEDE') OR (rn = 1 AND k = 1 AND op IN ('ADD', 'SUPERSEDE')) OR (rn = 1 AND k = 2)),
made AS (SELECT seq, op, id, CASE WHEN sim >= 0.65 THEN near_id END AS near_id, CASE WHEN sim >= 0.65 THEN sim ELSE 0.0 END AS sim, conflict FROM fold WHERE flag = 1)"""


_WROTE = f"WITH RECURSIVE {FACTS}, old AS (SELECT * FROM fact WHERE known), fresh AS (SELECT * FROM fact WHERE NOT known), {fold_sql('old', 'fresh', 'seq')}"
# What the decisions leave: rows of the store with their sums, before and after staleness is judged.
_LEFT = f"""app AS (SELECT m.op, m.id, m.near_id, m.conflict, c.seq, c.content, c.importance, c.confidence, c.scope, c.type FROM made m JOIN fresh c USING (seq)),
base AS (SELECT id, scope, type, content, importance, confidence, created_at, 'a' || (n % 2) AS agent FROM old
  UNION ALL SELECT c.id, c.scope, c.type, c.content, c.importance, c.confidence, {NOW}, 'a' || (c.n % 2) FROM fresh c JOIN made m USING (seq) WHERE m.op IN ('ADD', 'SUPERSEDE')),
touch AS (SELECT id, count(*) AS n, max(importance) FILTER (op = 'UPDATE') AS imp, arg_max(content, length(content) * 100000 - seq) FILTER (op = 'UPDATE') AS best, list_distinct(list('a' || (seq % 2))) AS agents FROM app WHERE op IN ('NOOP', 'UPDATE') GROUP BY id),
after AS (SELECT b.id, b.scope, b.type, b.created_at, CASE WHEN length(best) > length(b.content) THEN best ELSE b.content END AS content, greatest(b.importance, coalesce(imp, b.importance)) AS importance,
  least(b.confidence + 0.05::DOUBLE * coalesce(n, 0), CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 9 END) AS confidence, coalesce(n, 0) AS reinforced,
  b.id IN (SELECT near_id FROM app WHERE op = 'SUPERSEDE') AS closed, b.id IN (SELECT id FROM app WHERE conflict UNION SELECT near_id FROM app WHERE conflict) AS conflict,
  1 + len(list_filter(coalesce(agents, []), lambda a: a <> agent)) AS sources FROM base b LEFT JOIN touch USING (id)),
rep AS (SELECT a.seq, a.id AS new_id, a.content AS nc, o.id AS old_id, o.scope, o.content AS oc FROM app a JOIN after o ON o.id = a.near_id WHERE a.op = 'SUPERSEDE'),
dropped AS (SELECT *, list_filter({words.entities('oc')}, lambda e: NOT list_contains({words.entities('nc')}, e)) AS gone FROM rep),
recent AS (SELECT id, scope, {words.entities('content')} AS names FROM after WHERE NOT closed QUALIFY row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id) <= 200),
flag AS (SELECT r.id, arg_min('references ''' || list_min(list_intersect(gone, names)) || ''', superseded by: ' || substr(nc, 1, 80), (seq, old_id)) AS reason FROM dropped d JOIN recent r USING (scope)
  WHERE r.id <> old_id AND r.id <> new_id AND len(list_intersect(gone, names)) > 0 GROUP BY r.id)"""


def _wrote(spark, d):
    f = saved(facts(spark, d), "facts")
    return write.consolidate(f.filter("known"), None, f.filter("not known"), now())


@register("c01_exact", f"{_WROTE} SELECT seq, op, id, near_id, round(sim, 6) AS sim, conflict FROM made")
def c01(spark, d):
    f = saved(facts(spark, d), "facts")
    return write.decisions(f.filter("not known"), f.filter("known")).withColumn("sim", F.round("sim", 6))


@register("a06_op_tally", f"{_WROTE} SELECT o.op, count(made.op) AS n FROM (VALUES ('ADD'), ('UPDATE'), ('NOOP'), ('SUPERSEDE')) o(op) LEFT JOIN made USING (op) GROUP BY o.op")
def a06(spark, d):
    f = saved(facts(spark, d), "facts")
    return write.tally(write.decisions(f.filter("not known"), f.filter("known")))


_NEAR = """near AS (SELECT a.seq, a.type, a.content, b.id AS near_id, b.type AS near_type, round(list_dot_product(a.vec, b.vec), 6) AS sim FROM fact a, fact b
  WHERE NOT a.known AND b.known AND (b.scope = a.scope OR b.scope = 'global') QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY sim DESC, b.id) = 1)"""


@register("c01_decision", f"""WITH {FACTS}, {_NEAR}, o AS (SELECT *, CASE WHEN type = near_type AND sim >= 0.97 THEN 'NOOP' WHEN type = near_type AND sim >= 0.82 AND {words.against('content', 'type')} THEN 'SUPERSEDE' WHEN type = near_type AND sim >= 0.82 THEN 'UPDATE' ELSE 'ADD' END AS op FROM near)
SELECT seq, near_id, sim, op, op = 'ADD' AND type = near_type AND sim >= 0.65 AND {words.against('content', 'type')} AS conflict FROM o""")
def c01_decision(spark, d):
    f = saved(facts(spark, d), "facts")
    asked = f.filter("not known")
    near = nearest(asked.select(F.col("seq").alias("qid"), "vec", "scope"), f.filter("known"), 1).select(F.col("qid").alias("seq"), F.col("id").alias("near_id"), "sim")
    kinds = f.select(F.col("id").alias("near_id"), F.col("type").alias("near_type"))
    return lifecycle.decide(asked.select("seq", "type", "content").join(near, "seq").join(kinds, "near_id")).select("seq", "near_id", "sim", "op", "conflict")


@register("c04_store_after", f"""{_WROTE}, {_LEFT} SELECT after.id, scope, type, content, round(importance, 9) AS importance, round(confidence, 9) AS confidence, CAST(reinforced AS DOUBLE) AS reinforced, closed, conflict, CAST(sources AS INT) AS sources, flag.id IS NOT NULL AS stale FROM after LEFT JOIN flag ON flag.id = after.id""")
def c04(spark, d):
    m = _wrote(spark, d)["memories"].filter("not hub")
    return m.select("id", "scope", "type", "content", F.round("importance", 9).alias("importance"), F.round("confidence", 9).alias("confidence"), "reinforced", (F.col("status") == "superseded").alias("closed"), "conflict", F.size("provenance").alias("sources"), "stale")


@register("c05_edges_after", f"""{_WROTE}, app AS (SELECT m.*, c.scope FROM made m JOIN fresh c USING (seq)) SELECT id AS from_id, near_id AS to_id, 'supersedes' AS relation FROM app WHERE op = 'SUPERSEDE' UNION SELECT id, near_id, 'conflicts_with' FROM app WHERE conflict
UNION SELECT 'hub_' || array_to_string(regexp_extract_all(scope, '[a-z0-9]+'), '-'), id, 'has_member' FROM app WHERE starts_with(scope, 'project:')""")
def c05(spark, d):
    return _wrote(spark, d)["edges"].select("from_id", "to_id", "relation")


@register("c06_conflicts", f"{_WROTE} SELECT id, near_id, round(sim, 6) AS sim FROM made WHERE conflict")
def c06(spark, d):
    return _wrote(spark, d)["decisions"].filter("conflict").select("id", "near_id", F.round("sim", 6).alias("sim"))


@register("c08_cascade", f"{_WROTE}, {_LEFT} SELECT id, reason FROM flag")
def c08(spark, d):
    return _wrote(spark, d)["memories"].filter("stale").select("id", F.col("stale_reason").alias("reason"))


@register("c26_history", f"""{_WROTE}, {_LEFT} SELECT lower(op) AS op, id AS memory_id FROM made UNION ALL SELECT 'conflict', id FROM made WHERE conflict UNION ALL SELECT 'stale-suspect', id FROM flag""")
def c26(spark, d):
    return _wrote(spark, d)["history"].select("op", "memory_id")


@register("c07_adjudicated", f"""WITH {FACTS}, {_NEAR} SELECT seq, CASE WHEN type = near_type AND sim >= 0.97 THEN 'NOOP' WHEN type = near_type AND sim >= 0.65 THEN CASE WHEN contains(content, 'no longer') THEN 'SUPERSEDE' WHEN ends_with(content, 'builds') THEN 'NOOP' ELSE 'ADD' END ELSE 'ADD' END AS op FROM near WHERE seq % 8 IN (4, 6)""")
def c07(spark, d):
    def judge(old: str, new: str) -> str:
        return "contradict" if "no longer" in new else "duplicate" if new.endswith("builds") else "distinct"

    f = saved(facts(spark, d), "facts")
    # One candidate of each group at a time, so that each meets what was known before.
    one = lambda r: write.decisions(f.filter(F.col("seq") % 8 == r), f.filter("known"), judge).select("seq", "op")
    return one(4).unionByName(one(6)).join(f.filter("not known").select("seq"), "seq")


@register("m03_merge_strand", f"""WITH RECURSIVE {FACTS}, old AS (SELECT * FROM fact WHERE known), fresh AS (SELECT * REPLACE ('n' || id AS id) FROM fact WHERE NOT known AND n % 9 <> 0), {fold_sql('old', 'fresh', 'created_at DESC, id')},
all_ AS (SELECT op, 1 AS n FROM made UNION ALL SELECT 'NOOP', 1 FROM fact WHERE NOT known AND n % 9 = 0 UNION ALL SELECT unnest(['ADD', 'UPDATE', 'NOOP', 'SUPERSEDE']), 0) SELECT op, CAST(sum(n) AS BIGINT) AS n FROM all_ GROUP BY op""")
def m03(spark, d):
    f = saved(facts(spark, d), "facts")
    erased = f.filter(F.col("n") % 9 == 0).filter("not known").select(ft.fingerprint(F.col("type"), F.col("content")).alias("fp"))
    return merge.merge_strand(f.filter("known"), None, f.filter("not known"), erased, now())["tally"]


@register("m01b_provenance", f"""WITH {MEM}, rep AS (SELECT id, clock, replica, ['p' || (n % 3), 'q'] AS agents FROM mem UNION ALL SELECT id, (n * 7) % 5, 'r9', ['p' || (n % 2), 'z'] FROM mem WHERE n % 2 = 0),
w AS (SELECT id, list(agents ORDER BY clock DESC, replica DESC) AS l FROM rep GROUP BY id), x AS (SELECT id, flatten(l) AS a FROM w)
SELECT id, array_to_string(list_filter(a, lambda e, i: list_position(a, e) = i), ',') AS agents FROM x""")
def m01b(spark, d):
    m = memories(spark, d)
    said = lambda *agents: F.array(*[provenance(a, "x") for a in agents])
    mine = complete(m.withColumn("provenance", said(F.concat(F.lit("p"), F.col("n") % 3), "q")), "n")
    other = mine.filter(F.col("n") % 2 == 0).withColumns({"clock": (F.col("n") * 7) % 5, "replica": F.lit("r9"), "provenance": said(F.concat(F.lit("p"), F.col("n") % 2), "z")})
    out = merge.last_writer(mine.unionByName(other))
    return out.select("id", F.concat_ws(",", F.transform("provenance", lambda p: p["agent"])).alias("agents"))


@register("m06b_handoff", f"""WITH RECURSIVE {FACTS}, old AS (SELECT * FROM fact WHERE known), fresh AS (SELECT * REPLACE ('n' || id AS id, 'project:next' AS scope) FROM fact WHERE NOT known AND n % 5 = 0), {fold_sql('old', 'fresh', 'substr(id, 2)')}
SELECT seq, op FROM made""")
def m06b(spark, d):
    f = saved(facts(spark, d), "facts")
    none = spark.createDataFrame([], "fp string")
    ids = f.filter("not known").filter(F.col("n") % 5 == 0).select("id")
    out = merge.handoff(complete(f.filter("known")).unionByName(complete(f.filter("not known")).withColumn("status", F.lit("archived"))), None, ids, "project:next", none, now())
    order = f.join(ids, "id", "left_semi").select(F.col("seq").alias("n"), (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("seq"))
    return out["decisions"].select("seq", "op").join(order, "seq").select(F.col("n").alias("seq"), "op")


# Verbs on single memories.


@register("c16_forget", f"WITH {MEM} SELECT id, CASE WHEN n % 6 = 0 THEN 'forgotten' ELSE status END AS status, CASE WHEN n % 6 = 0 THEN {NOW} ELSE updated_at END AS updated FROM mem")
def c16(spark, d):
    m = memories(spark, d)
    return lifecycle.forget(m, m.filter(F.col("n") % 6 == 0).select("id"), now()).select("id", "status", F.unix_timestamp("updated_at").alias("updated"))


@register("c18_edit", f"""WITH {MEM}, top AS (SELECT max(clock) AS c FROM mem), e AS (SELECT id, n, row_number() OVER (ORDER BY n, id) AS tick FROM mem WHERE n % 10 = 3)
SELECT mem.id, CASE WHEN e.id IS NULL OR mem.n % 20 = 3 THEN md5(content) ELSE md5('new words ' || mem.n) END AS content_md5, CASE WHEN e.id IS NOT NULL THEN 'episode' ELSE type END AS type, CASE WHEN e.id IS NOT NULL THEN 'episodic' ELSE cognitive END AS cognitive,
CASE WHEN e.id IS NOT NULL THEN least(mem.n / 100.0, 1.0) ELSE importance END AS importance, CASE WHEN e.id IS NOT NULL THEN (SELECT c FROM top) + tick ELSE clock END AS clock, CASE WHEN e.id IS NOT NULL THEN 'me' ELSE replica END AS replica, e.id IS NOT NULL AND mem.n % 20 <> 3 AS new_vector
FROM mem LEFT JOIN e ON e.id = mem.id""")
def c18(spark, d):
    m, n = memories(spark, d), F.col("n")
    edits = m.filter(n % 10 == 3).select("id", n.alias("seq"), F.when(n % 20 != 3, F.concat(F.lit("new words "), n)).alias("content"), F.lit(None).cast("string").alias("scope"), F.lit("episode").alias("type"), (n / 100.0).alias("importance"))
    return lifecycle.edit(m, edits, now(), "me").select("id", F.md5("content").alias("content_md5"), "type", "cognitive", "importance", "clock", "replica", F.col("vec").isNotNull().alias("new_vector"))


@register("c19_resolve_stale", f"WITH {MEM} SELECT id, stale AND n % 4 <> 0 AS stale, CASE WHEN n % 4 = 1 THEN 'forgotten' ELSE status END AS status, CASE WHEN n % 4 < 2 THEN {NOW} ELSE updated_at END AS updated FROM mem")
def c19(spark, d):
    m = memories(spark, d)
    verdicts = m.filter(F.col("n") % 4 < 2).select("id", (F.col("n") % 4 == 0).alias("keep"))
    return lifecycle.resolve_stale(m, verdicts, now()).select("id", "stale", "status", F.unix_timestamp("updated_at").alias("updated"))


@register("c11b_touch", f"WITH {MEM}, h AS (SELECT user_id % 97 AS n, count(*) AS c FROM events GROUP BY ALL) SELECT id, reinforced + coalesce(c, 0) AS reinforced, CASE WHEN c IS NULL THEN last_seen_at ELSE {NOW} END AS seen FROM mem LEFT JOIN h USING (n)")
def c11b(spark, d):
    hits = table(spark, d, "events").select(F.concat(F.lit("m"), F.col("user_id") % 97).alias("id"))
    return retrieve.touch(memories(spark, d), hits, now()).select("id", "reinforced", F.unix_timestamp("last_seen_at").alias("seen"))


_VERBS = f"""WITH {MEM}, a AS (SELECT *, CASE WHEN n % 6 = 0 THEN 'forgotten' ELSE status END AS s1 FROM mem),
b AS (SELECT *, CASE WHEN n % 4 = 1 THEN 'forgotten' ELSE s1 END AS s2 FROM a),
c AS (SELECT *, s2 = 'quarantined' AND n % 2 = 0 AS taken FROM b WHERE NOT (status = 'quarantined' AND n % 2 = 1))"""


def _stored(spark, d):
    """A store of all memories after a few verbs, each on the version before it."""
    e = Engine(spark, folder(spark, "store"), now=dt.datetime.fromtimestamp(NOW, dt.UTC))
    m = saved(complete(memories(spark, d), "n"), "memories")
    n = F.col("n")
    e.put(m)
    e.forget(m.filter(n % 6 == 0).select("id"))
    e.resolve_stale(m.filter(n % 4 < 2).select("id", (n % 4 == 0).alias("keep")))
    e.approve(m.filter(n % 2 == 0).select("id"))
    e.reject(m.filter("status = 'quarantined'").filter(n % 2 == 1).select("id"))
    return e


@register("c27_store_after_verbs", f"{_VERBS} SELECT id, CASE WHEN taken THEN 'active' ELSE s2 END AS status, stale AND n % 4 <> 0 AS stale, CASE WHEN taken OR n % 4 < 2 OR n % 6 = 0 THEN {NOW} ELSE updated_at END AS updated FROM c")
def c27(spark, d):
    return _stored(spark, d).table("memories").select("id", "status", "stale", F.unix_timestamp("updated_at").alias("updated"))


@register("c27b_store_history", f"""WITH {MEM}, h AS (SELECT 1 AS v, 'forget' AS op, id FROM mem WHERE n % 6 = 0 UNION ALL SELECT 2, 'review', id FROM mem WHERE n % 4 < 2
UNION ALL SELECT 3, 'approve-incoming', id FROM mem WHERE n % 2 = 0 UNION ALL SELECT 4, 'reject-incoming', id FROM mem WHERE status = 'quarantined' AND n % 2 = 1)
SELECT row_number() OVER (ORDER BY v, id) - 1 AS seq, op, id AS memory_id FROM h""")
def c27b(spark, d):
    return _stored(spark, d).table("history").select("seq", "op", "memory_id")


_REPLICAS = f"""WITH {MEM}, a AS (SELECT id, content, clock, n FROM mem),
b AS (SELECT id, content, CASE WHEN n % 50 = 7 THEN clock + 1 ELSE clock END AS clock, n FROM mem WHERE n % 60 <> 11 UNION ALL SELECT 'x' || n, content, clock, n FROM mem WHERE n % 80 = 3),
h AS (SELECT *, substr(sha256(id), 1, 3) AS node, sha256(id || chr(1) || coalesce(content, chr(0)) || chr(1) || clock) AS h FROM (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b)),
r AS (SELECT node, string_agg(h, '' ORDER BY h) FILTER (side = 'a') IS DISTINCT FROM string_agg(h, '' ORDER BY h) FILTER (side = 'b') AS differs FROM h GROUP BY node),
up AS (SELECT k AS level, substr(node, 1, CAST(k AS INT)) AS node, bool_or(differs) AS differs FROM r, range(0, 4) t(k) GROUP BY ALL),
seen AS (SELECT level, node, differs FROM up WHERE level = 0 OR (level - 1, substr(node, 1, CAST(level - 1 AS INT))) IN (SELECT (level, node) FROM up WHERE differs))"""


def _replicas(spark, d):
    """A replica's id, content and clock, and another's in which some are newer, some gone and some new."""
    m, n = memories(spark, d).select("id", "content", "clock", "n"), F.col("n")
    other = m.filter(n % 60 != 11).withColumn("clock", F.when(n % 50 == 7, F.col("clock") + 1).otherwise(F.col("clock")))
    other = other.unionByName(m.filter(n % 80 == 3).withColumn("id", F.concat(F.lit("x"), n)))
    return m.drop("n"), other.drop("n")


@register("m05_ranges_compared", f"{_REPLICAS} SELECT CAST(level AS INTEGER) AS level, node, differs FROM seen")
def m05(spark, d):
    return ranges.exchange(*_replicas(spark, d), depth=3)[1]


@register("m05b_rows_sent", f"{_REPLICAS} SELECT id, clock FROM b WHERE substr(sha256(id), 1, 3) IN (SELECT node FROM seen WHERE level = 3 AND differs)")
def m05b(spark, d):
    return ranges.exchange(*_replicas(spark, d), depth=3)[0].select("id", "clock")


@register("m05c_bytes_exchanged", f"""{_REPLICAS} SELECT 'level ' || level AS what, count(*) AS n, count(*) * 32 AS bytes FROM seen GROUP BY level
UNION ALL SELECT 'rows', count(*), CAST(coalesce(sum(strlen(id) + strlen(CAST(clock AS VARCHAR)) + 18), 0) AS BIGINT) FROM b WHERE substr(sha256(id), 1, 3) IN (SELECT node FROM seen WHERE level = 3 AND differs)""")
def m05c(spark, d):
    sent, seen = ranges.exchange(*_replicas(spark, d), depth=3)
    return ranges.bill(sent.select("id", "clock"), seen)


_RECIPE = "SELECT item_id, 'building ' || item_id AS trigger, ['open ' || item_id, 'run it', 'check ' || length(text)] AS steps, CASE WHEN item_id % 2 = 0 THEN 'global' ELSE 'project:b' END AS scope FROM benchmark"


@register("c23_learn_procedure", f"SELECT 'When ' || trigger || ': ' || array_to_string(steps, '; ') AS content, trigger, steps, scope, 0.6::DOUBLE AS importance, 0.6::DOUBLE AS confidence, 0.5::DOUBLE AS reliability, 'procedural' AS cognitive FROM ({_RECIPE})")
def c23(spark, d):
    b, i = table(spark, d, "benchmark"), F.col("item_id")
    recipes = b.select(F.concat(F.lit("building "), i).alias("trigger"), F.array(F.concat(F.lit("open "), i), F.lit("run it"), F.concat(F.lit("check "), F.length("text"))).alias("steps"), F.when(i % 2 == 0, "global").otherwise("project:b").alias("scope"), F.lit(None).cast("string").alias("success_signal"))
    return lifecycle.learn_procedures(recipes, now()).select("content", "trigger", "steps", "scope", "importance", "confidence", "reliability", "cognitive")


@register("k05_procedures", f"""WITH {FACTS}, p AS (SELECT id, scope, vec, (n % 10) / 10.0::DOUBLE AS reliability FROM fact WHERE known), q AS (SELECT n AS qid, vec AS qv, scope FROM fact WHERE n % 8 = 4)
SELECT qid, rank, id, total FROM (SELECT q.qid, p.id, round(0.7 * list_dot_product(qv, vec) + 0.3 * reliability, 6) AS total, row_number() OVER (PARTITION BY q.qid ORDER BY round(0.7 * list_dot_product(qv, vec) + 0.3 * reliability, 6) DESC, p.id) AS rank FROM q JOIN p USING (scope)) WHERE rank <= 3""")
def k05(spark, d):
    f = saved(facts(spark, d), "facts")
    p = f.filter("known").select("id", "scope", "vec", ((F.col("n") % 10) / 10.0).alias("reliability"))
    return lifecycle.procedures_for(f.filter(F.col("n") % 8 == 4).select(F.col("n").alias("qid"), "vec", "scope"), p)


@register("c20_auto_link", f"""WITH {FACTS}, n AS (SELECT a.id AS from_id, b.id AS to_id, round(list_dot_product(a.vec, b.vec), 6) AS sim FROM fact a, fact b WHERE NOT a.known AND (b.scope = a.scope OR b.scope = 'global')),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY sim DESC, to_id) <= 4)
SELECT from_id, to_id, 'related_to' AS relation, round(sim, 3) AS weight FROM t WHERE sim >= 0.5 AND from_id <> to_id""")
def c20(spark, d):
    f = saved(facts(spark, d), "facts")
    near = nearest(f.filter("not known").select(F.col("seq").alias("qid"), "vec", "scope"), f, 4)
    return lifecycle.auto_links(near.select(F.concat(F.lit("f"), F.col("qid")).alias("from_id"), F.col("id").alias("to_id"), "sim"))


_SOURCES = "top AS (SELECT scope, id, content, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id) AS pos, count(*) OVER (PARTITION BY scope) AS c FROM mem WHERE status = 'active' AND NOT hub)"


@register("c15_reflect", f"WITH {MEM}, {_SOURCES} SELECT scope, 'In short: ' || count(*) || ' notes, ' || sum(length(content)) || ' characters' AS content, array_to_string(list(id ORDER BY pos) FILTER (pos <= 10), ',') AS sources FROM top WHERE pos <= 30 AND c >= 3 GROUP BY scope")
def c15(spark, d):
    total = lambda texts: F.aggregate(texts, F.lit(0), lambda s, x: s + F.length(x))
    short = lambda texts: F.array(F.concat(F.lit("In short: "), F.size(texts), F.lit(" notes, "), total(texts), F.lit(" characters")), F.lit(" "))
    return lifecycle.insights(memories(spark, d), short).select("scope", "content", F.concat_ws(",", "sources").alias("sources"))


@register("c25_reembed")
def c25(spark, d):
    return lifecycle.reembed(memories(spark, d)).filter("vec is not null").select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@register("a04_stats", f"""WITH {MEM}, {EDGES} SELECT s || '_memories' AS metric, (SELECT count(*) FROM mem WHERE status = s) AS value FROM (VALUES ('active'), ('archived'), ('forgotten'), ('superseded'), ('quarantined')) v(s)
UNION ALL SELECT 'embedding_dim', 0 UNION ALL SELECT 'edges', count(*) FROM edg UNION ALL SELECT 'tombstones', count(DISTINCT text) FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'operations', count(*) FROM events""")
def a04(spark, d):
    buried = table(spark, d, "documents").filter(F.col("doc_id") % 9 == 0).select(F.sha2("text", 256).alias("fp")).distinct()
    return analytics.stats(memories(spark, d), edges(spark, d), buried, table(spark, d, "events"))


# Governance.


@register("g08_review", f"WITH {MEM} SELECT id, '?' AS from_ FROM mem WHERE status = 'quarantined' ORDER BY created_at DESC, id LIMIT 100")
def g08(spark, d):
    return governance.review_incoming(complete(memories(spark, d))).select("id", F.col("from").alias("from_"))


@register("g08b_approve", f"WITH {MEM} SELECT id, CASE WHEN status = 'quarantined' AND n % 2 = 0 THEN 'active' ELSE status END AS status FROM mem")
def g08b(spark, d):
    m = memories(spark, d)
    return governance.approve(m, m.filter(F.col("n") % 2 == 0).select("id"), now()).select("id", "status")


@register("g08c_reject", f"WITH {MEM} SELECT DISTINCT sha256(type || '|' || lower(trim(content, ' '))) AS fp FROM mem WHERE status = 'quarantined' AND n % 2 = 1")
def g08c(spark, d):
    m = memories(spark, d)
    return governance.reject(m, m.filter("status = 'quarantined'").filter(F.col("n") % 2 == 1).select("id"))[1]


@register("g09_propose", "SELECT DISTINCT 'Use plan ' || doc_id || ' from now on' AS content, 'project:' || source AS scope, lang AS contributor, 'quarantined' AS status, true AS proposed, lang AS agent FROM documents WHERE lang IS NOT NULL")
def g09(spark, d):
    t = table(spark, d, "documents").filter("lang is not null").select(F.concat(F.lit("Use plan "), F.col("doc_id"), F.lit(" from now on")).alias("content"), F.concat(F.lit("project:"), F.col("source")).alias("scope"), F.col("lang").alias("contributor"))
    return governance.propose(t.unionByName(t), now()).select("content", "scope", "contributor", "status", "proposed", F.col("provenance")[0]["agent"].alias("agent"))


_KEY = b"a key of some length"
_PADS = ["".join(rf"\x{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_SIG = f"sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(type || '|' || trim(content, ' ')))))"


@register("g05_sign", f"WITH {MEM} SELECT id, CASE WHEN status = 'active' AND NOT hub THEN {_SIG} END AS sig FROM mem")
def g05(spark, d):
    return governance.sign(memories(spark, d), _KEY, now()).select("id", "sig")


@register("g05b_verify", f"WITH {MEM} SELECT CASE WHEN n % 3 = 0 THEN 'unsigned' WHEN n % 7 = 0 THEN 'tampered' ELSE 'verified' END AS verdict, count(*) AS n FROM mem WHERE status = 'active' AND NOT hub GROUP BY 1")
def g05b(spark, d):
    n = F.col("n")
    m = complete(memories(spark, d), "n").drop("n")
    m = m.withColumn("n", F.substring("id", 2, 20).cast("long"))
    signed = governance.sign(m, _KEY, now()).join(m.select("id", "n"), "id")
    broken = signed.withColumn("sig", F.when(n % 3 != 0, F.col("sig"))).withColumn("content", F.when(n % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return governance.verify(broken, _KEY)


@register("g06b_import", f"""WITH {MEM}, f AS (SELECT id, n, sha256(type || '|' || lower(trim(content, ' '))) AS own FROM mem),
v AS (SELECT own, CASE WHEN n % 5 = 0 THEN 'tampered' WHEN n % 3 = 0 AND n % 4 = 0 THEN 'forged' WHEN own IN (SELECT own FROM f WHERE n % 23 = 0) THEN 'erased' ELSE 'quarantined' END AS verdict, n FROM f)
SELECT count(DISTINCT own) AS held FROM v WHERE verdict = 'quarantined'""")
def g06b(spark, d):
    m, n = memories(spark, d), F.col("n")
    fp = ft.fingerprint(F.col("type"), F.col("content"))
    shared = m.select("id", "type", "content", "scope", "importance", "confidence", F.when(n % 5 == 0, "broken").otherwise(fp).alias("fingerprint"), F.lit("eve").alias("contributor"), (n % 3 == 0).alias("signed"), (n % 4 != 0).alias("sig_ok"))
    tomb = m.filter(n % 23 == 0).select(fp.alias("fp"))
    empty = spark.createDataFrame([], "id string, scope string, content string")
    out = governance.import_share(empty, None, shared, tomb, spark.createDataFrame([], "contributor string"), now())
    return out["memories"].filter("status = 'quarantined'").agg(F.count("*").alias("held"))


@register("e05_benchmark")
def e05(spark, d):
    """How many of the benchmark's items recall finds again, asked with their own texts, in documents embedded by hashes."""
    live = memories(spark, d).filter("status = 'active' and not hub").withColumn("vec", ft.hash_embed(F.coalesce("content", F.lit(""))))
    b = table(spark, d, "benchmark")
    asked = b.select(F.col("item_id").alias("qid"), "text", F.lit(None).cast("string").alias("scope"))
    return evaluate.benchmark(saved(live, "live"), edges(spark, d), asked, b.select(F.col("item_id").alias("qid"), F.col("item_id").alias("gold_id"), "text"), now())


@register("e06_capability")
def e06(spark, d):
    """Secrets and personal data of all documents against the write path's redaction, and staleness of the facts' groups."""
    kept = table(spark, d, "documents").select(F.concat(F.lit("m"), F.col("doc_id")).alias("id"), ft.redact(F.col("text")).alias("content"), F.lit("active").alias("status"), F.lit(False).alias("hub"))
    mails = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z.]+@[a-z]+[.][a-z]+"), F.lit(0))).alias("text")).distinct().select(F.lit("mail").alias("kind"), "text")
    wrote = _wrote(spark, d)
    flags = wrote["memories"].filter("status = 'active' and not hub").select(F.col("stale").alias("should"), F.col("stale_reason").isNotNull().alias("flagged"))
    pairs = wrote["decisions"].filter("conflict").select(F.col("id").alias("a"), F.col("near_id").alias("b"))
    return evaluate.capabilities(saved(kept, "redacted"), mails, flags).unionByName(evaluate.conflict_rate(wrote["memories"], pairs))


@register("s22_demo")
def s22(spark, d):
    """A store seeded with the benchmark's items, each linked to the one before."""
    empty = spark.createDataFrame([], "id string, scope string, content string")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), F.concat(F.lit("project:p"), F.col("item_id") % 5).alias("scope"), "text")
    links = b.select(F.col("seq").alias("a"), (F.col("seq") - 1).alias("b"))
    return demo.seed(empty, None, b, links, now())["memories"].select("id", "type", "scope", "content", "hub")


@register("k06_newest_changes", f"WITH {MEM}, {EDGES} SELECT from_id, to_id, a.created_at AS changed_at FROM edg JOIN mem a ON a.id = from_id JOIN mem b ON b.id = to_id WHERE relation = 'supersedes' ORDER BY changed_at DESC, from_id, to_id LIMIT 100")
def k06(spark, d):
    return graph.newest_changes(edges(spark, d), memories(spark, d)).select("from_id", "to_id", "changed_at")


@register("m04b_samples", f"WITH {MEM}, a AS (SELECT DISTINCT type, content FROM mem WHERE n % 2 = 0), b AS (SELECT DISTINCT type, content FROM mem WHERE n % 3 = 0), x AS (FROM a EXCEPT FROM b), y AS (FROM b EXCEPT FROM a) SELECT * FROM (SELECT 'only_mine' AS side, content FROM x ORDER BY content, type LIMIT 5) UNION ALL SELECT * FROM (SELECT 'only_theirs', content FROM y ORDER BY content, type LIMIT 5)")
def m04b(spark, d):
    m = memories(spark, d)
    return merge.samples(m.filter(F.col("n") % 2 == 0), m.filter(F.col("n") % 3 == 0))
