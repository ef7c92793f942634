"""Operators on fixtures, properties, sources and streams."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.operators import analytics, evaluate, graph, lifecycle, merge, retrieve, store, trust
from memspark.schema import TYPES, cognitive_of
from memspark.sources import notes, snapshots
from memspark.streaming import ingest

NOW = dt.datetime(2025, 6, 1)
MEMORY = "id string, type string, cognitive string, content string, scope string, importance double, confidence double, status string, valid_from timestamp, valid_to timestamp, created_at timestamp, updated_at timestamp, last_seen_at timestamp, reinforced double, hub boolean, stale boolean, clock long, replica string, visibility string"


def memory(i, content="x", kind="fact", scope="global", status="active", days=0, **more):
    at = NOW - dt.timedelta(days=days)
    row = {"id": i, "type": kind, "cognitive": "semantic", "content": content, "scope": scope, "importance": 0.5, "confidence": 0.5, "status": status, "valid_from": at, "valid_to": None, "created_at": at, "updated_at": at, "last_seen_at": at, "reinforced": 0.0, "hub": False, "stale": False, "clock": 0, "replica": "a", "visibility": None}
    return row | more


def memories(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], MEMORY)


def now():
    return F.lit(NOW).cast("timestamp")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


SECRET_KEY = "sk-" + "abcdefghij0123456789XY"


@pytest.mark.parametrize(
    ("text", "gone", "mark"),
    [
        ("key " + SECRET_KEY, SECRET_KEY, ft.SECRET_MARK),
        ("id AKIA" + "ABCDEFGHIJKLMNOP", "AKIA", ft.SECRET_MARK),
        ("postgres://user:pw" + "1@host/db", "pw1", ft.SECRET_MARK),
        ("password" + " = hunter2", "hunter2", ft.SECRET_MARK),
        ("blob aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1eF3hX", "aB3dE5", ft.SECRET_MARK),
        ("mail dev@example.com", "dev@", ft.PII_MARK),
        ("call 555-123-4567 now", "555-123", ft.PII_MARK),
        ("card 4111 1111 1111 1111 ok", "4111", ft.PII_MARK),
        ("from 10.0.0.7 today", "10.0.0.7", ft.PII_MARK),
    ],
)
def test_redaction(text, gone, mark):
    out = ft.redact_text(text)
    assert gone not in out and mark in out and ft.redact_text(out) == out


def test_redaction_leaves_prose_and_null():
    assert ft.redact_text("We chose Postgres over Mongo for billing.") == "We chose Postgres over Mongo for billing."
    assert ft.redact_text(None) is None


def test_gate_and_types(spark):
    t = F.lit("Remember: we always use pytest, never unittest.")
    assert one(spark, ft.gate(t, F.lit(0.9))) == pytest.approx(0.97) and one(spark, ft.gate(F.lit("ok thanks"), F.lit(0.0))) == 0.0
    kinds = {"We decided on Kafka": "decision", "Never use tabs": "convention", "I prefer tea": "preference", "My name is Alice": "identity", "Bob owns the build": "entity", "Rain fell": "fact"}
    assert {k: one(spark, ft.infer_type(F.lit(k))) for k in kinds} == kinds
    assert one(spark, cognitive_of(F.lit("episode"))) == "episodic" and len(TYPES) == 10


def test_entities_drop_trailing_marks(spark):
    got = one(spark, F.array_sort(ft.key_entities(F.lit("We use SQLite for storage. The API v2 and Postgres."))))
    assert got == ["api", "postgres", "sqlite"]


def test_embedding_is_unit_and_deterministic():
    a, b = ft.embed_text("deploys are frozen on fridays"), ft.embed_text("which deploys are frozen")
    assert math.isclose(sum(x * x for x in a), 1.0) and a == ft.embed_text("deploys are frozen on fridays")
    assert sum(x * y for x, y in zip(a, b, strict=True)) > sum(x * y for x, y in zip(a, ft.embed_text("zzz qqq"), strict=True))


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_redaction_is_idempotent(text):
    assert ft.redact_text(ft.redact_text(text)) == ft.redact_text(text)


def test_slices_and_extraction(spark):
    text = "# Head\n- We chose Postgres over Mongo\n* use ruff for linting\nok thanks\n```\na b c d\n```\nThe deploys are frozen. On fridays we rest.\n---"
    got = notes.slices(spark.createDataFrame([(1, text)], "note long, text string")).orderBy("slice").collect()
    assert [r.text for r in got] == ["We chose Postgres over Mongo", "use ruff for linting", "The deploys are frozen. On fridays we rest."]
    short = notes.extract(spark.createDataFrame([(1, "hi. yo.")], "note long, text string")).collect()
    assert [r.content for r in short] == ["hi. yo."]  # no sentence is long enough: the slice as a whole
    assert notes.extract(spark.createDataFrame([(1, "Rain fell on the hills today.")], "note long, text string"), force=False).count() == 0


def test_salience_falls_with_time_and_grows_with_use(spark):
    m = memories(spark, memory("a", days=10), memory("b", days=100), memory("c", days=100, reinforced=3.0), memory("f", days=-5))
    s = {r.id: r.s for r in m.select("id", lifecycle.salience(now()).alias("s")).collect()}
    assert s["a"] > s["b"] and s["c"] > s["b"] and s["f"] == 0.5


def test_upkeep(spark):
    m = memories(spark, memory("old", cognitive="episodic", importance=0.3, days=60), memory("new", cognitive="episodic"), memory("gone", status="forgotten", days=400), memory("ep", kind="episode", cognitive="episodic", reinforced=3.0))
    assert {r.id: r.status for r in lifecycle.maintain(m, now()).collect()}["old"] == "archived"
    stays, tombs = lifecycle.purge(m, now())
    assert stays.count() == 3 and tombs.count() == 1
    ep = {r.id: r for r in lifecycle.promote(m).collect()}["ep"]
    assert (ep.type, ep.cognitive, round(ep.confidence, 6)) == ("fact", "semantic", 0.6)


def test_decisions(spark):
    rows = [("a", "fact", "fact", "same", 0.99), ("b", "fact", "fact", "more", 0.9), ("c", "fact", "fact", "no longer so", 0.9), ("d", "fact", "fact", "not this", 0.7), ("e", "fact", "entity", "x", 0.99), ("f", "fact", None, "x", None)]
    d = {r.id: (r.op, r.conflict) for r in lifecycle.decide(spark.createDataFrame(rows, "id string, type string, near_type string, content string, sim double")).collect()}
    assert d == {"a": ("NOOP", False), "b": ("UPDATE", False), "c": ("SUPERSEDE", False), "d": ("ADD", True), "e": ("ADD", False), "f": ("ADD", False)}


def test_fold_sees_earlier_candidates(spark):
    schema = "seq long, id string, scope string, type string, content string, vec array<double>"
    new = spark.createDataFrame([(1, "a", "s", "fact", "x", [1.0, 0.0]), (2, "b", "s", "fact", "x", [1.0, 0.0]), (3, "c", "s", "fact", "not x", [0.9, math.sqrt(1 - 0.81)]), (4, "d", "t", "fact", "x", [1.0, 0.0])], schema)
    old = new.limit(0).drop("seq")
    assert {r.seq: (r.op, r.id) for r in lifecycle.fold(new, old).collect()} == {1: ("ADD", "a"), 2: ("NOOP", "a"), 3: ("SUPERSEDE", "c"), 4: ("ADD", "d")}


def test_stale_dependents(spark):
    m = memories(spark, memory("dep", "SQLite WAL mode is enabled", scope="p"), memory("keep", "All API errors use RFC-7807", scope="p"), memory("old", "We use SQLite", scope="p"))
    rep = spark.createDataFrame([("p", "old", "We use SQLite for storage", "We use Postgres for storage")], "scope string, old_id string, old_content string, new_content string")
    assert [(r.id, r.reason) for r in lifecycle.stale_dependents(rep, m).collect()] == [("dep", "references 'sqlite', superseded by: We use Postgres for storage")]


def test_outcomes_keep_the_last_rule(spark):
    p = spark.createDataFrame([("a", [True, False]), ("b", [])], "id string, outcomes array<boolean>")
    assert {r.id: (r.success_count, r.reliability) for r in lifecycle.outcomes(p).collect()} == {"a": (1, 0.45), "b": (0, 0.5)}


def test_last_writer_is_commutative_and_idempotent(spark):
    rows = [memory("x", "SQLite", clock=1, replica="a", importance=0.9), memory("x", "Postgres", clock=2, replica="b", importance=0.2), memory("x", "Tie", clock=2, replica="b")]
    results = set()
    for order in itertools.permutations(rows):
        results.add(tuple(merge.last_writer(memories(spark, *order, order[0])).drop("replicas").first()))
    assert len(results) == 1 and next(iter(results))[1] == "Tie" and next(iter(results))[6] == 0.9


def test_diff_and_tombstones(spark):
    a, b = memories(spark, memory("1", "p"), memory("2", "q"), memory("3", "q")), memories(spark, memory("4", "q"), memory("5", "r"))
    assert {r.side: r.n for r in merge.diff(a, b).collect()} == {"only_mine": 1, "only_theirs": 1, "both": 1}
    tomb = a.filter("id = '1'").select(ft.fingerprint(F.col("type"), F.col("content")).alias("fp"))
    assert merge.merge_replicas(a, b, tomb).count() == 5 and merge.without_tombstoned(a, tomb).count() == 2


def test_recall_finds_facts_within_scope(spark):
    texts = {"fri": ("deploys are frozen on fridays", "global"), "nats": ("This service uses NATS for events", "project:alpha"), "kafka": ("This service uses Kafka for events", "project:beta")}
    m = memories(spark, *[memory(i, t, scope=s) for i, (t, s) in texts.items()]).withColumn("vec", ft.hash_embed(F.col("content")))
    q = spark.createDataFrame([(1, "which deploys are frozen", None), (2, "what does this service use for events", "project:alpha")], "qid long, text string, scope string").withColumn("vec", ft.hash_embed(F.col("text")))
    edges = spark.createDataFrame([("nats", "fri", "related_to", 1.0)], "from_id string, to_id string, relation string, weight double")
    hits = retrieve.recall(q, m, edges, now()).orderBy("qid", "place").collect()
    assert [h.id for h in hits if h.qid == 1][0] == "fri"
    assert [h.id for h in hits if h.qid == 2][0] == "nats" and "kafka" not in [h.id for h in hits if h.qid == 2]
    rows = [(h.qid, h.place, h.id, h.score, h.type, h.content) for h in hits]
    packed = retrieve.pack(spark.createDataFrame(rows, "qid long, rank long, id string, score double, type string, content string"))
    assert "- (fact) deploys are frozen on fridays" in packed.filter("qid = 1").first().context


def test_packing(spark):
    hits = spark.createDataFrame([(1, 0, "a", 1.0, "fact", "alpha beta gamma"), (1, 1, "b", 0.95, "fact", "alpha beta gamma"), (1, 2, "c", 0.9, "fact", "one two three"), (1, 3, "d", 0.05, "fact", "weak words here")], "qid long, rank long, id string, score double, type string, content string")
    got = retrieve.pack(hits).first()
    assert got.n_facts == 2 and "weak" not in got.context
    assert retrieve.within_budget(hits, 8).count() == 2
    order = {r.id: r.position for r in retrieve.edges_first(hits).collect()}
    assert order == {"a": 0, "b": 3, "c": 1, "d": 2}


def test_rerank_prefers_coverage(spark):
    hits = spark.createDataFrame([(1, 0, "far", 0.9, "unrelated words"), (1, 1, "hit", 0.3, "which database billing")], "qid long, rank long, id string, score double, content string")
    q = spark.createDataFrame([(1, "which database billing")], "qid long, text string")
    assert [r.id for r in retrieve.rerank(hits, q).orderBy("place").collect()] == ["hit", "far"]


@settings(max_examples=8, deadline=None)
@given(st.permutations(range(6)))
def test_fusion_ignores_row_order(order):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    leg = spark.createDataFrame([(1, i, f"m{i}") for i in order], "qid long, rank long, id string")
    assert [r.id for r in retrieve.fuse(leg, leg).orderBy(F.desc("rrf"), "id").collect()] == [f"m{i}" for i in range(6)]


def test_neighbours_and_graph(spark):
    e = spark.createDataFrame([("a", "b", "related_to", 1.0), ("b", "c", "related_to", 1.0), ("n", "o", "supersedes", 1.0), ("a", "c", "conflicts_with", 1.0)], "from_id string, to_id string, relation string, weight double")
    s = spark.createDataFrame([(1, "a")], "key long, id string")
    chain = e.filter("relation = 'related_to'")
    assert {r.id for r in retrieve.neighbours(s, chain, 1).collect()} == {"b"} and {r.id for r in retrieve.neighbours(s, chain, 2).collect()} == {"b", "c"}
    m = memories(spark, *[memory(i, i) for i in "abc"], memory("n", "new"), memory("o", "old", status="superseded"), memory("s", "s", stale=True))
    assert graph.conflicts(e, m).count() == 1 and graph.changes(e, m).first().old_content == "old"
    assert [r.kind for r in graph.review_queue(m, e).collect()] == ["stale", "conflict"]
    assert graph.induced(e, m.filter("id in ('a', 'b')")).count() == 1


def test_snapshots_in_valid_time(spark):
    m = memories(spark, memory("a", days=10, valid_to=NOW - dt.timedelta(days=5)), memory("b", days=5))
    at = lambda d: F.lit(NOW - dt.timedelta(days=d)).cast("timestamp")
    assert [[r.id for r in graph.as_of(m, at(d)).collect()] for d in (11, 7, 5)] == [[], ["a"], ["b"]]
    instants = spark.createDataFrame([(NOW - dt.timedelta(days=7),), (NOW,)], "at timestamp")
    assert sorted((r.at, r.id) for r in graph.as_of_many(m, instants).collect()) == [(NOW - dt.timedelta(days=7), "a"), (NOW, "b")]


def test_sharing_and_import(spark):
    m = memories(spark, memory("id1", "My name is Alice", kind="identity", scope="p"), memory("t", "mail a@b.co", scope="p"), memory("h", hub=True, scope="p"), memory("o", scope="q"))
    out = trust.bundle(m, "p").collect()
    assert [(r.id, r.content) for r in out] == [("t", "mail «pii»")]
    fp = lambda kind, c: one(spark, ft.fingerprint(F.lit(kind), F.lit(c)))
    rows = [("fact", "a", fp("fact", "a"), "bob", False, False), ("fact", "b", "wrong", "bob", False, False), ("fact", "c", fp("fact", "c"), "bob", True, False), ("fact", "d", fp("fact", "d"), "bob", False, False), ("fact", "e", fp("fact", "e"), "eve", True, True)]
    facts = spark.createDataFrame(rows, "type string, content string, fingerprint string, contributor string, signed boolean, sig_ok boolean")
    tomb, trusted = spark.createDataFrame([(fp("fact", "d"),)], "fp string"), spark.createDataFrame([("bob",)], "contributor string")
    assert {r.content: r.verdict for r in trust.classify_import(facts, tomb, trusted).collect()} == {"a": "accepted", "b": "tampered", "c": "forged", "d": "erased", "e": "quarantined"}


def test_chain_and_merkle(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows, prev = [], ""
    for i in range(6):
        h = sha("|".join([prev, "t", "me", "do", str(i), "-"]))
        rows.append((i, "t", "me", "do", str(i), "-", prev, h))
        prev = h
    schema = "seq long, ts string, actor string, action string, target string, detail string, prev_hash string, hash string"
    assert all(r.ok for r in trust.chain_breaks(spark.createDataFrame(rows, schema)).collect())
    rows[2] = (*rows[2][:3], "edited", *rows[2][4:])
    assert [r.seq for r in trust.chain_breaks(spark.createDataFrame(rows, schema)).filter("not ok").collect()] == [2]
    for n in (1, 2, 5):
        level = sorted(sha(str(i)) for i in range(n))
        leaves = spark.createDataFrame([(x,) for x in level], "leaf string")
        while len(level) > 1:
            level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        assert trust.merkle_levels(leaves).first().root == level[0]


def test_erase_and_conformance(spark):
    m = memories(spark, memory("base"), memory("der", "y"))
    e = spark.createDataFrame([("der", "base", "derived_from", 1.0)], "from_id string, to_id string, relation string, weight double")
    left = trust.erase(m, e, m.filter("id = 'base'").select("id"))
    assert (left["memories"].count(), left["edges"].count(), left["tombstones"].count(), left["derived"].first().id) == (1, 0, 1, "der")
    rec = spark.createDataFrame([("g", "1", "fact", "x", "t", "p", 0.5, "s"), ("w", None, "odd", "x", "t", "p", 2.0, None)], "doc string, id string, type string, content string, created_at string, provenance string, confidence double, signature string")
    assert {r.doc: (r.valid, r.level, r.n_errors) for r in trust.conformance(rec).collect()} == {"g": (True, "signed", 0), "w": (False, None, 3)}


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 0, "noise"), (1, 1, "We chose Postgres"), (2, 0, "none")], "qid long, rank long, content string")
    gold = spark.createDataFrame([(1, 1, "we chose postgres"), (2, 1, "absent fact"), (3, 1, "never asked")], "qid long, gold_id long, text string")
    got = {r.qid: (r.precision, r.recall, r.rr) for r in evaluate.at_k(ranked, gold).collect()}
    assert got == {1: (0.5, 1.0, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    v = spark.createDataFrame([("g", float(x)) for x in range(1, 12)], "k string, v double")
    assert tuple(evaluate.nearest_rank(v.withColumnRenamed("v", "x"), "x", "k").first())[1:] == (6.0, 11.0)


def test_analytics(spark):
    m = memories(spark, memory("a", "NATS carries events", scope="p", days=1), memory("b", "NATS and Kafka", scope="p", reinforced=2.0), memory("c", "plain words", scope="p", stale=True))
    e = spark.createDataFrame([("a", "b", "conflicts_with", 1.0)], "from_id string, to_id string, relation string, weight double")
    over = {(r.metric, r.key): r.value for r in analytics.overview(m, e, spark.createDataFrame([], "fp string")).collect()}
    assert over["total", ""] == 3 and over["stale", ""] == 1 and over["conflicts", ""] == 1 and over["by_type", "fact"] == 3
    assert analytics.themes(m).first().asDict() == {"topic": "nats", "n": 2, "example": "b"}
    assert analytics.clusters(m).first().sources.startswith("b,c,a") and analytics.most_recalled(m).count() == 1


def test_store_views(spark):
    m = memories(spark, memory("a"), memory("h", hub=True), memory("p", scope="project:x"), memory("z", status="archived"))
    assert store.scan(m).count() == 3 and store.listed(m, limit=1).count() == 1 and store.scan(m, "global", ("archived",)).first().id == "z"


def test_snapshots_and_files(spark, tmp_path):
    m = memories(spark, memory("a"), memory("b", status="archived"))
    root = f"file://{tmp_path}/store"
    assert snapshots.push({"memories": m}, root) == 1 and snapshots.push({"memories": m.filter("id = 'a'")}, root) == 2
    assert snapshots.pull(spark, root, "memories").count() == 1 and snapshots.pull(spark, root, "memories", 1).count() == 2
    with pytest.raises(ValueError, match="no store"):
        snapshots.backend("ftp://x")
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("﻿We chose Kafka for events")
    (tmp_path / "n" / "b.txt").write_text("no")
    assert [r.text for r in notes.read_files(spark, f"file://{tmp_path}/n").collect()] == ["We chose Kafka for events"]
    snapshots.write_bundle(trust.bundle(m, "global"), f"file://{tmp_path}/b", "me")
    assert snapshots.read_bundle(spark, f"file://{tmp_path}/b", "id string, contributor string").first().contributor == "me"


def test_repository_facts(spark):
    files = spark.createDataFrame([("r", "uv.lock", ""), ("r", "docs/CODEOWNERS", "* @late"), ("r", "CODEOWNERS", "# c\n* @b @a\n/x @a"), ("r", "AGENTS.md", "x"), ("r", "CONTRIBUTING.md", "y"), ("s", "package.json", "broken")], "root string, path string, text string")
    got = {(r.root, r.fact) for r in notes.repository_facts(files).collect()}
    assert got == {("r", "This project is managed with uv."), ("r", "Code ownership (CODEOWNERS): @a, @b."), ("s", "This project uses Node.js / JavaScript.")}
    assert [(r.root, r.path) for r in notes.contributing(files).collect()] == [("r", "CONTRIBUTING.md")]


def test_streams(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Remember: we always use pytest here. Mail a@b.co now please.")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/turns")
    seen = []
    q = ingest.start(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/turns"), f"{tmp_path}/cp", lambda df, n: seen.extend(df.collect()))
    q.awaitTermination(120)
    assert [r.type for r in seen] == ["convention", "fact"] or len(seen) == 2
    assert all("a@b.co" not in r.content for r in seen)
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, m), 7, "click", 1.0) for m in (0, 10, 50)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert ingest.hourly(events).first().n == 3 and sorted(r.n for r in ingest.sessions(events).collect()) == [1, 2]
    events.write.parquet(f"{tmp_path}/events")
    s = ingest.hourly(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("hours").first().n == 3


def test_registry_without_extras():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 80
