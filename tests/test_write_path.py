"""The write path, lifecycle verbs, governance, merging and sources against slow plain Python or by hand."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.functions.vectors import nearest, smallest_near
from memspark.operators import evaluate, governance, graph, lifecycle, merge, retrieve, store, write
from memspark.schema import MEMORIES, complete, provenance
from memspark.session import numbered
from memspark.sources import demo, jdbc, notes, snapshots
from memspark.streaming import ingest

NOW = dt.datetime(2025, 6, 1)
EMPTY = "id string, scope string, content string"


def now():
    return F.lit(NOW).cast("timestamp")


def slow_fold(known, new):
    """One candidate after the other over plain lists."""
    state = [dict(m) for m in known]
    out = []
    for c in sorted(new, key=lambda r: r["seq"]):
        seen = [m for m in state if m["scope"] in (c["scope"], "global")]
        best = min(seen, key=lambda m: (-round(float(np.dot(m["vec"], c["vec"])), 6), m["id"]), default=None)
        sim = round(float(np.dot(best["vec"], c["vec"])), 6) if best else 0.0
        best = best if sim >= 0.65 else None
        same = best is not None and best["type"] == c["type"]
        neg = c["type"] == "identity" or bool(write._NEGATION.search(c["content"]))
        near = best["id"] if best else None
        if same and sim >= 0.97:
            out.append((c["seq"], "NOOP", near, near, False))
        elif same and sim >= 0.82 and not neg:
            out.append((c["seq"], "UPDATE", near, near, False))
            if len(c["content"]) > len(best["content"]):
                best["content"], best["vec"] = c["content"], c["vec"]
        else:
            op = "SUPERSEDE" if same and sim >= 0.82 else "ADD"
            if op == "SUPERSEDE":
                state.remove(best)
            state.append({k: c[k] for k in ("id", "scope", "type", "content", "vec")})
            out.append((c["seq"], op, c["id"], near, op == "ADD" and same and sim >= 0.65 and neg))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decisions_match_a_slow_fold(spark, monkeypatch, seed):
    monkeypatch.setattr(write, "KNOWN", 2)  # lists run out, so clusters go several rounds
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))

    def fact(i, **more):
        v = centres[rng.integers(0, 6)] + rng.normal(size=12) * rng.choice([0.02, 0.15, 0.3, 0.6])
        text = rng.choice(["we use this", "we no longer use this", "not that", "plain"]) + "!" * int(rng.integers(0, 9))
        return {"id": f"x{i:03d}", "scope": str(rng.choice(["global", "project:a", "project:b"])), "type": str(rng.choice(["fact", "fact", "fact", "identity"])), "content": text, "vec": (v / np.linalg.norm(v)).tolist(), **more}

    known, new = [fact(i) for i in range(25)], [fact(100 + i, seq=int(i)) for i in rng.permutation(90)]
    columns = "id string, scope string, type string, content string, vec array<double>"
    got = write.decisions(spark.createDataFrame(new, columns + ", seq long").repartition(3), spark.createDataFrame(known, columns)).collect()
    assert sorted((r.seq, r.op, r.id, r.near_id, r.conflict) for r in got) == slow_fold(known, new)
    assert len({r.op for r in got}) == 4


def test_effects_of_the_four_operations(spark):
    base = {"cognitive": "semantic", "scope": "project:x", "type": "fact", "importance": 0.4, "confidence": 0.5}
    old = [("a", "We use SQLite for storage", [1.0, 0.0, 0.0]), ("b", "Short fact", [0.0, 1.0, 0.0]), ("dep", "SQLite WAL mode is on", [0.0, 0.0, -1.0]), ("c", "Deploys are frozen", [-1.0, 0.0, 0.0])]
    memories = complete(spark.createDataFrame([{**base, "id": i, "content": t, "vec": v, "created_at": NOW - dt.timedelta(days=3)} for i, t, v in old], "id string, content string, vec array<double>, cognitive string, scope string, type string, importance double, confidence double, created_at timestamp"))
    near = lambda w: [w, math.sqrt(1 - w * w)]
    rows = [(1, "n1", "We use SQLite for storage", [1.0, 0.0, 0.0]), (2, "n2", "A rather longer fact about it", [0.0, near(0.9)[0], near(0.9)[1]]), (3, "n3", "We switched to Postgres", [near(0.9)[0], 0.0, near(0.9)[1]]), (4, "n4", "Deploys are not frozen", [-0.7, -near(0.7)[1], 0.0]), (5, "n5", "Something else", [0.0, -1.0, 0.0])]
    cand = complete(spark.createDataFrame([{**base, "importance": 0.9, "seq": s, "id": i, "content": t, "vec": v} for s, i, t, v in rows], "seq long, id string, content string, vec array<double>, cognitive string, scope string, type string, importance double, confidence double").withColumn("provenance", F.array(provenance("me", "test"))), "seq")
    out = write.consolidate(memories, None, cand, now())
    assert {r.seq: (r.op, r.id, r.conflict) for r in out["decisions"].collect()} == {1: ("NOOP", "a", False), 2: ("UPDATE", "b", False), 3: ("SUPERSEDE", "n3", False), 4: ("ADD", "n4", True), 5: ("ADD", "n5", False)}
    m = {r.id: r for r in out["memories"].collect()}
    assert set(m) == {"a", "b", "c", "dep", "n3", "n4", "n5", "hub_project-x"}
    assert (m["a"].status, m["a"].valid_to, m["a"].reinforced, round(m["a"].confidence, 6)) == ("superseded", NOW, 1.0, 0.55) and [p.agent for p in m["a"].provenance] == ["me"]
    assert (m["b"].content, m["b"].importance, m["b"].last_seen_at) == ("A rather longer fact about it", 0.9, NOW) and m["b"].vec[1] == pytest.approx(0.9)
    assert m["n4"].conflict and m["c"].conflict and not m["n5"].conflict and m["n3"].valid_from == NOW
    assert m["dep"].stale and m["dep"].stale_reason == "references 'sqlite', superseded by: We switched to Postgres" and not m["b"].stale
    e = {(r.from_id, r.relation, r.to_id) for r in out["edges"].collect()}
    assert {("n3", "supersedes", "a"), ("n4", "conflicts_with", "c"), ("hub_project-x", "has_member", "n5")} <= e and m["hub_project-x"].hub
    assert sorted(r.op for r in out["history"].collect()) == ["add", "add", "conflict", "noop", "stale-suspect", "supersede", "update"]


def demo_texts(spark):
    """Unlike facts of two scopes, and links between them."""
    said = ["We keep invoices in a Derby database because audits need them.", "Builds run nightly under Gradle.", "Reviews need two approvals.", "Logs are kept for ninety days.", "The search page is written in Elm.", "Alerts go to the duty phone."]
    texts = spark.createDataFrame([(i, "global" if i > 3 else "project:ledger", t) for i, t in enumerate(said)], "seq long, scope string, text string")
    return texts, spark.createDataFrame([(0, 1), (1, 2), (4, 0)], "a long, b long")


def test_remembering_twice_only_reinforces(spark):
    texts, links = demo_texts(spark)
    once = demo.seed(spark.createDataFrame([], EMPTY), None, texts, links, now())
    m = once["memories"]
    m.write.mode("overwrite").saveAsTable("seeded")
    again = demo.seed(spark.table("seeded"), once["edges"], texts, links, now())
    assert {r.op for r in again["decisions"].collect()} == {"NOOP"}
    assert again["memories"].count() == m.count() and again["memories"].filter("not hub").agg(F.min("reinforced")).first()[0] == 1.0
    assert again["edges"].filter("relation = 'related_to'").count() == links.count()
    spark.sql("drop table seeded")


def test_verbs(spark):
    m = complete(spark.createDataFrame([("a", "g", "x", True), ("b", "g", "y", False)], "id string, scope string, content string, stale boolean"))
    assert {r.id: r.status for r in lifecycle.forget(m, m.filter("id = 'a'").select("id"), now()).collect()} == {"a": "forgotten", "b": "active"}
    edits = spark.createDataFrame([("a", 1, "first", 7.0), ("a", 2, "mail me at a@b.co", -1.0)], "id string, seq long, content string, importance double").withColumn("scope", F.lit(None).cast("string")).withColumn("type", F.lit("episode"))
    a = {r.id: r for r in lifecycle.edit(m, edits, now(), "me").collect()}["a"]
    assert (a.content, a.importance, a.type, a.cognitive, a.clock, a.replica, len(a.vec)) == ("mail me at «pii»", 0.0, "episode", "episodic", 1, "me", 256)
    kept = {r.id: r for r in lifecycle.resolve_stale(m, spark.createDataFrame([("a", True), ("b", False)], "id string, keep boolean"), now()).collect()}
    assert not kept["a"].stale and kept["a"].status == "active" and kept["b"].status == "forgotten"
    recipes = spark.createDataFrame([("deploying", ["build", "push it"], "g", "green")], "trigger string, steps array<string>, scope string, success_signal string")
    p = lifecycle.learn_procedures(recipes, now())
    one = p.first()
    assert (one.content, one.steps, one.reliability, one.cognitive) == ("When deploying: build; push it", ["build", "push it"], 0.5, "procedural")
    results = spark.createDataFrame([(one.id, 1, True), (one.id, 2, False)], "id string, seq long, ok boolean")
    done = lifecycle.record_outcomes(p, results, now()).first()
    assert (done.success_count, done.reliability, done.reinforced) == (1, 0.45, 1.0)
    assert lifecycle.reembed(m).filter("vec is not null").count() == 2


def test_reflection_cites_its_sources(spark):
    m = complete(spark.createDataFrame([(f"m{i}", "project:x", f"Fact number {i} here", NOW - dt.timedelta(days=i)) for i in range(4)] + [("o", "project:y", "alone", NOW)], "id string, scope string, content string, created_at timestamp")).withColumn("vec", ft.hash_embed(F.col("content")))
    out = lifecycle.reflect(m, None, lambda texts: F.array(F.concat(F.lit("Insight of "), F.size(texts))), now())
    made = out["memories"].filter("reflection").collect()
    assert [(r.content, r.scope, r.importance) for r in made] == [("Insight of 4", "project:x", 0.7)]
    assert {r.to_id for r in out["edges"].filter("relation = 'derived_from'").collect()} == {"m0", "m1", "m2", "m3"}
    assert lifecycle.insights(out["memories"], lambda t: F.array(F.lit("again"))).count() == 1


def test_governance(spark):
    facts = spark.createDataFrame([("Use key a@b.co", "global", "bob")], "content string, scope string, contributor string")
    p = governance.propose(facts, now())
    assert [(r.content, r["from"]) for r in governance.review_incoming(p).collect()] == [("Use key «pii»", "bob")]
    ok = governance.approve(p, p.select("id"), now()).first()
    assert (ok.status, ok.contributor, ok.proposed) == ("active", None, True)
    left, tomb = governance.reject(p, p.select("id"))
    assert left.count() == 0 and tomb.count() == 1
    m = complete(spark.createDataFrame([("a", "g", "x "), ("b", "g", "y"), ("c", "g", "z")], EMPTY))
    key = b"k" * 80
    signed = governance.sign(m.filter("id <> 'c'"), key, now())
    assert signed.filter("id = 'a'").first().sig == hmac.new(key, b"fact|x", hashlib.sha256).hexdigest()
    both = signed.withColumn("content", F.when(F.col("id") == "b", "changed").otherwise(F.col("content"))).unionByName(m.filter("id = 'c'"))
    assert {r.id: r.verdict for r in governance.verdicts(both, key).collect()} == {"a": "verified", "b": "tampered", "c": "unsigned"}
    assert {r.verdict for r in governance.verdicts(signed, b"other").collect()} == {"tampered"}


def test_audit_grows_by_links(spark):
    from memspark.operators import trust

    entry = lambda i: (i, "t", "me", "do", str(i), None)
    schema = "at long, ts string, actor string, action string, target string, detail string"
    first = spark.createDataFrame([entry(2), entry(1)], schema)
    one = governance.append_audit(None, first)
    rows = [tuple(r) for r in one.orderBy("seq").collect()]
    kept = spark.createDataFrame(rows, governance.AUDIT)
    two = governance.append_audit(kept, spark.createDataFrame([entry(3)], schema))
    assert [r.target for r in two.orderBy("seq").collect()] == ["1", "2", "3"] and all(r.ok for r in trust.chain_breaks(two).collect())
    assert governance.audit_log(two, 1).first().target == "3" and governance.anchor(two).first().n == 3


def test_shared_facts_are_imported_by_verdict(spark):
    fp = ft.fingerprint(F.col("type"), F.col("content"))
    rows = [("1", "fact", "We use Kafka for events", "g", "bob", True), ("2", "fact", "We use NATS for events now", "g", "eve", True), ("3", "fact", "tampered", "g", "bob", False)]
    facts = spark.createDataFrame(rows, "id string, type string, content string, scope string, contributor string, good boolean").withColumns({"fingerprint": F.when(F.col("good"), fp).otherwise("x"), "signed": F.lit(False), "sig_ok": F.lit(False), "importance": F.lit(0.5), "confidence": F.lit(0.5)}).drop("good")
    out = governance.import_share(spark.createDataFrame([], EMPTY), None, facts, spark.createDataFrame([], "fp string"), spark.createDataFrame([("bob",)], "contributor string"), now())
    assert {r.content: r.status for r in out["memories"].filter("not hub").collect()} == {"We use Kafka for events": "active", "We use NATS for events now": "quarantined"}
    assert {r.verdict: r.n for r in out["verdicts"].collect()} == {"accepted": 1, "quarantined": 1, "tampered": 1}


def test_merging_keeps_every_attribution(spark):
    said = lambda *a: F.array(*[provenance(x, "e") for x in a])
    row = complete(spark.createDataFrame([("x", "g", "old", 1, "a"), ("x", "g", "new", 2, "b")], "id string, scope string, content string, clock long, replica string"))
    rows = row.withColumn("provenance", F.when(F.col("clock") == 1, said("p", "q")).otherwise(said("r", "p")))
    won = merge.last_writer(rows).first()
    assert won.content == "new" and [p.agent for p in won.provenance] == ["r", "p", "q"]
    forged = rows.withColumns({"sig_scheme": F.lit("ed25519"), "sig": F.lit("s"), "sig_ok": F.col("clock") == 1})
    assert merge.without_forged(forged).count() == 1
    mine = complete(spark.createDataFrame([("a", "g", "We use Kafka for events")], EMPTY)).withColumn("vec", ft.hash_embed(F.col("content")))
    theirs = complete(spark.createDataFrame([("t1", "g", "We use Kafka for events"), ("t2", "g", "Lunch is at noon on all days"), ("t3", "g", "gone for good")], EMPTY)).withColumns({"vec": ft.hash_embed(F.col("content")), "created_at": now()})
    tomb = theirs.filter("id = 't3'").select(ft.fingerprint(F.col("type"), F.col("content")).alias("fp"))
    out = merge.merge_strand(mine, None, theirs, tomb, now())
    assert {r.op: r.n for r in out["tally"].collect()} == {"ADD": 1, "NOOP": 2, "UPDATE": 0, "SUPERSEDE": 0}
    copied = merge.handoff(out["memories"], None, out["memories"].filter("id = 'a'").select("id"), "project:z", tomb, now())
    assert copied["memories"].filter("scope = 'project:z' and not hub").first().content == "We use Kafka for events"


def test_recall_in_full(spark):
    texts = {"fri": "deploys are frozen on fridays", "pg": "We chose Postgres over Mongo for billing because it needs ACID transactions.", "far": "Vacuum runs at night", "hop": "Bloat is watched"}
    m = complete(spark.createDataFrame([(i, "global", t, NOW, NOW) for i, t in texts.items()], EMPTY + ", created_at timestamp, last_seen_at timestamp")).withColumn("vec", ft.hash_embed(F.col("content")))
    e = spark.createDataFrame([("pg", "hop", "related_to", 1.0), ("hop", "far", "related_to", 1.0)], "from_id string, to_id string, relation string, weight double")
    q = spark.createDataFrame([(1, "which database did we pick for billing", None)], "qid long, text string, scope string").withColumn("vec", ft.hash_embed(F.col("text")))
    hits = retrieve.recall(q, m, e, now())
    assert hits.orderBy("place").first().id == "pg"
    shallow, deep = (retrieve.candidates_of(q, m, e, now(), depth=k) for k in (1, 2))
    mass = lambda df: {r.id: r.graph for r in df.collect()}
    assert mass(deep)["far"] >= mass(shallow)["far"]
    assert retrieve.recall(q, m, e, now(), k=2, reranker=retrieve.lexical).orderBy("place").first().id == "pg"
    touched = {r.id: r.reinforced for r in retrieve.touch(m, hits.filter("place = 0"), now()).collect()}
    assert touched["pg"] == 1.0 and touched["fri"] == 0.0
    asked = q.unionByName(spark.createDataFrame([(2, None, "global", None)], "qid long, text string, scope string, vec array<double>"))
    packed = {r.qid: r.context for r in retrieve.context(asked, m, e, now()).collect()}
    assert "Postgres" in packed[1] and packed[2].count("- (fact)") == 4
    facts, near = retrieve.about(q, m, e, now())
    assert facts.count() == 4 and {r.id for r in near.collect()} == {"hop"}
    assert retrieve.matching(q, m, e, now()).first().id == "pg" and retrieve.proactive(q, m.withColumn("confidence", F.lit(0.3)), e, now()).count() == 0
    out = governance.subject_export(hits, m.withColumn("provenance", F.array(provenance("me", "x")))).filter("id = 'pg'").first()
    assert out.provenance[0].agent == "me" and store.hit_cards(hits, m, now()).count() == 4 and store.detail(m).count() == 4


def test_keyword_hits_and_containment_match_brute_force(spark):
    rng = np.random.default_rng(0)
    words = ["al", "alpha", "pha", "beta", "be", "x1", "gamma ray", "é"]
    docs = [(f"d{i}", "global" if i % 3 else "project:a", " ".join(rng.choice(words, 5))) for i in range(60)]
    asks = [(j, " ".join(rng.choice(words, 4)), None if j % 2 else "project:b") for j in range(9)]
    m, q = spark.createDataFrame(docs, "id string, scope string, content string").repartition(3), spark.createDataFrame(asks, "qid long, text string, scope string")
    want = []
    for j, text, scope in asks:
        terms = list(dict.fromkeys(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text).split()))[:8]
        scored = [(-sum(t in c for t in terms), i) for i, s, c in docs if scope in (None, s) or s == "global"]
        want += [(j, k, i, float(-n)) for k, (n, i) in enumerate(sorted(x for x in scored if x[0])[:7])]
    assert sorted(tuple(r) for r in retrieve.keyword_hits(q, m, 7).collect()) == sorted(want)
    texts = [(i, t) for i, t in enumerate(["Alpha beta gamma", " beta ", "", None, "gamma delta", "beta gamma delta epsilon", "long gamma delta text"])]
    gold = [(i, t) for i, t in enumerate(["beta gamma", "GAMMA delta", "zzz", "", "the long gamma delta text here"])]
    norm = lambda t: t.strip(" ").lower()
    pairs = {(d, g) for d, t in texts for g, x in gold if t is not None and (norm(t) in norm(x) or norm(x) in norm(t))}
    got = evaluate.containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(gold, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == pairs


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(1)
    items = spark.createDataFrame([(f"i{k:03d}", x.tolist(), ["global", "a", "b"][k % 3]) for k, x in enumerate(v)] + [("none", None, "global")], "id string, vec array<double>, scope string").repartition(4)
    asks = [(j, v[j].tolist(), [None, "a"][j % 2]) for j in range(10)]
    got = {}
    for r in nearest(spark.createDataFrame(asks, "qid long, vec array<double>, scope string"), items, 5, floor=0.5).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.sim))
    for j, x, scope in asks:
        sims = sorted((-round(float(v[k] @ np.array(x)), 6), f"i{k:03d}") for k in range(300) if scope is None or k % 3 < 2)
        assert sorted(got.get(j, [])) == [(n, i, -s) for n, (s, i) in enumerate(sims[:5]) if -s >= 0.5]
    rows = [(k, 1000 - k, x.tolist()) for k, x in enumerate(v[:80])]
    low = {r.seq: r.near for r in smallest_near(spark.createDataFrame(rows, "seq long, label long, vec array<double>").repartition(3), 2.0).collect()}
    for k in range(80):
        near = [1000 - j for j in range(80) if round(float(v[j] @ v[k]), 6) >= 2.0]
        assert low.get(k) == (min(near) if near else None)


def test_many_instants(spark):
    rng = np.random.default_rng(3)
    at = lambda h: NOW + dt.timedelta(hours=int(h))
    rows = [(f"m{i}", at(a), None if i % 4 == 0 else at(a + rng.integers(0, 900))) for i, a in enumerate(rng.integers(0, 800, 120))]
    instants = [(at(h),) for h in rng.choice(1500, 300, replace=False)]
    got = graph.as_of_many(spark.createDataFrame(rows, "id string, valid_from timestamp, valid_to timestamp"), spark.createDataFrame(instants, "at timestamp"))
    want = {(t, i) for (t,) in instants for i, a, b in rows if a <= t and (b is None or b > t)}
    assert {(r["at"], r.id) for r in got.collect()} == want and got.count() == len(want)


def test_texts(spark):
    import collections

    tokens = ["aB3dE5gH7jK9mN1pQ3sT5vW7", "aaaa", "x"]
    for t, r in zip(tokens, spark.createDataFrame([(t,) for t in tokens], "t string").select(F.round(ft.entropy(F.col("t")), 9).alias("e")).collect(), strict=True):
        assert r.e == pytest.approx(-sum(n / len(t) * math.log2(n / len(t)) for n in collections.Counter(t).values()), abs=1e-8)
    found = spark.createDataFrame([("id " + "AKIA" + "ABCDEFGHIJKLMNOP and aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1eF3hX",)], "t string").select(ft.secret_findings(F.col("t")).alias("f")).first().f
    assert [(x.kind, x.hint) for x in found] == [("aws-key", "«detected»"), ("high-entropy", "aB3d…hX")]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("2024-01-02T04:04:05+0100",), ("soon",)], "t string").select(ft.iso(ft.parse_iso(F.col("t"))).alias("x"))
    assert [r.x for r in times.collect()] == ["2024-01-02T03:04:05+00:00"] * 3 + [None]
    batch = ["deploys are frozen", "", "w:x w:x", None]
    assert np.allclose(ft.embed_texts(batch), np.array([ft.embed_text(t or "") for t in batch]))


def test_numbers_follow_the_order(spark):
    rows = [(f"k{i:04d}" if i else None,) for i in np.random.default_rng(0).permutation(2000)]
    got = numbered(spark.createDataFrame(rows, "k string").repartition(7), F.col("k").asc_nulls_last()).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.number)] == sorted((k for (k,) in rows if k), key=str) + [None]


def test_stores_and_containers(spark, tmp_path):
    root, m = f"file://{tmp_path}/store", complete(spark.createDataFrame([("a", "g", "x"), ("b", "g", "y")], EMPTY))
    snapshots.put(spark, root, "note", b"\x00hello")
    snapshots.put(spark, root, "note", b"again")
    assert snapshots.get(spark, root, "note") == b"again" and snapshots.names(spark, root) == ["note"]
    v = f"file://{tmp_path}/versions"
    snapshots.push({"memories": m}, v), snapshots.push({"memories": m.limit(1)}, v)
    assert snapshots.rollback(spark, v, 1) == 3 and snapshots.pull(spark, v, "memories").count() == 2
    out = snapshots.pull_merge(spark, v, spark.createDataFrame([], EMPTY), None, spark.createDataFrame([], "fp string"), now())
    assert out["tally"].count() == 4
    c = f"file://{tmp_path}/container"
    snapshots.export_container({"memories": m, "none": m.limit(0)}, c, b"key", "mine")
    assert snapshots.import_container(spark, c, b"key")["memories"].count() == 2
    with pytest.raises(ValueError, match="signed"):
        snapshots.verify_container(spark, c, b"other")
    m.limit(1).write.mode("overwrite").parquet(f"{c}/data/memories")
    assert snapshots.verify_container(spark, c, b"key") == {"memories": False, "none": True}
    snapshots.write_portable(snapshots.portable(m, spark.createDataFrame([], "id string, from_id string, to_id string, relation string, weight double"), "g", now()), f"{tmp_path}/portable")
    assert sorted(r.id for r in snapshots.read_portable(spark, f"{tmp_path}/portable").collect()) == ["a", "b"]
    notes.write_markdown(m, f"{tmp_path}/md")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.strip() == "## g\n\n- **fact**: x\n- **fact**: y"


def test_relational_store(spark):
    url, how = "jdbc:derby:memory:helper;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, f"text {i}", f"[{i}, 1]") for i in range(20)], "n long, content string, embedding string")
    jdbc.write(rows.coalesce(1), url, "memories", "overwrite", **how)
    back = jdbc.vectors(jdbc.read(spark, url, "memories", "n", 0, 20, 4, **how), "embedding")
    assert back.count() == 20 and back.filter("n = 3").first().vec == [3.0, 1.0]


def test_turns_are_remembered_once(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Remember: we always use pytest here."), (1, 1, "user", "The build runs on Nomad machines.")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/turns")
    root = f"file://{tmp_path}/store"
    stream = spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/turns")
    ingest.remember_into(stream, root, f"{tmp_path}/cp").awaitTermination(240)
    first = snapshots.pull(spark, root, "memories").count()
    assert first >= 2
    turns.limit(1).write.mode("append").parquet(f"{tmp_path}/turns")
    ingest.remember_into(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/turns"), root, f"{tmp_path}/cp").awaitTermination(240)
    assert snapshots.pull(spark, root, "memories").count() == first and snapshots.pull(spark, root, "memories").agg(F.max("reinforced")).first()[0] == 1.0


def test_benchmark_and_capabilities(spark):
    texts, _ = demo_texts(spark)
    held = write.remember(spark.createDataFrame([], EMPTY), None, texts, now())
    asked = texts.select(F.col("seq").alias("qid"), F.regexp_replace("text", r"^\S+ ", "what about ").alias("text"), "scope")
    gold = texts.select(F.col("seq").alias("qid"), F.col("seq").alias("gold_id"), "text")
    got = evaluate.benchmark(held["memories"], held["edges"], asked, gold, now()).agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.count("*").alias("n")).first()
    assert got.n == 6 and got.recall > 0.5 and got.mrr > 0
    texts = spark.createDataFrame([(0, "g", "my key is sk-" + "A" * 26), (1, "g", "reach me at dev@example.com about the deploy")], "seq long, scope string, text string")
    kept = write.remember(spark.createDataFrame([], EMPTY), None, texts, now())["memories"]
    planted = spark.createDataFrame([("mail", "@example.com")], "kind string, text string")
    stale = spark.createDataFrame([(True, True), (False, False)], "should boolean, flagged boolean")
    assert {r.name: r.rate for r in evaluate.capabilities(kept, planted, stale).collect()} == {"secret_block": 1.0, "pii_block": 1.0, "stale_catch": 1.0}


def test_the_model_is_complete(spark):
    m = complete(spark.createDataFrame([("a", "g", "x")], EMPTY))
    assert m.columns == list(MEMORIES) and m.first().provenance == [] and m.first().status == "active"
