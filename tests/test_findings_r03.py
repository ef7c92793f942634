"""What the review of round 3 found, on small tables."""

import collections
import hashlib
import math
import re
import tracemalloc

import duckdb
import numpy as np

import __spark_entry__ as entry
from memspark.functions import ranking, vectors
from memspark.functions import text as ft
from memspark.operators import lifecycle, retrieve
from memspark.operators.keywords import Keywords
from memspark.plans import model
from memspark.session import folder


def sql_rows(name, d, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return sorted(c.execute(entry.oracle_sql()[name]).fetchall())


def test_turn_facts_count_sentences_not_whole_short_turns(spark, tmp_path):
    turns = [(1, 0, "user", "And heer.\nLy instea."), (1, 1, "assistant", "one two three. and four more words"), (2, 0, "user", "Short one. Too short."), (3, 0, "user", None), (3, 1, "user", "a b\n\nc d e")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, entry.queries()["x01_turn_facts"](spark, str(tmp_path)).collect()))
    assert got == sql_rows("x01_turn_facts", tmp_path, "conversations") == [(1, 2), (3, 1)]


def plain_embedding(text, dim=256):
    low = (text or "").lower()
    padded, out = f" {low} ", np.zeros(dim)
    for x in ["w:" + w for w in re.findall("[a-z0-9]+", low)] + [padded[i : i + n] for n in (3, 4) for i in range(len(padded) - n + 1)]:
        h = int.from_bytes(hashlib.blake2s(x.encode(), digest_size=8).digest(), "big")
        out[h % dim] += (2.0 if x.startswith("w:") else 1.0) * (1 if (h >> 33) & 1 else -1)
    return out / (np.linalg.norm(out) or 1.0)


def test_embedding_is_that_of_single_features(monkeypatch):
    texts = ["deploys are frozen on fridays", None, "", "a", "w:x w:", "É漢字 ß İ 🙂🙂🙂", "ab " * 500, "x" * 777, "".join(map(chr, range(32, 3000)))]
    want = np.array([plain_embedding(t) for t in texts])
    assert np.allclose(ft.embed_texts(texts), want)
    for at_once, piece in ((50, 7), (1, 1), (1000, 64)):  # groups and pieces of any size give the same
        monkeypatch.setattr(ft, "AT_ONCE", at_once)
        monkeypatch.setattr(ft, "PIECE", piece)
        assert np.allclose(ft.embed_texts(texts), want)
    monkeypatch.undo()
    monkeypatch.setattr(ft, "REMEMBERED", 3)
    assert np.allclose(ft.embed_texts(texts), want)
    wide = "".join(map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x18000)]))  # more letters than a number of four holds
    assert np.allclose(ft.embed_texts([wide, "plain"])[0], plain_embedding(wide))


def test_embedding_holds_a_bounded_part_of_the_features():
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(np.random.default_rng(k).choice(words, 4000)) for k in range(60)] + [" ".join(words * 300)]
    tracemalloc.start()
    ft.embed_texts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20, peak


def plain_bm25(asked, rows, k):
    """qid, rank, id, score by the formula, pair by pair."""
    words = {i: re.findall("[a-z0-9]+", c.lower()) for i, _, c in rows if c is not None}
    docs, avg = len(words), sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for x in words.values() for w in set(x))
    out = set()
    for qid, text, scope in asked:
        terms = list(dict.fromkeys(re.findall("[a-z0-9]+", (text or "").lower())))[:12]
        found = []
        for i, s, _ in rows:
            if i in words and (scope is None or s in (scope, "global")) and set(terms) & set(words[i]):
                tf = collections.Counter(words[i])
                parts = [math.log(1 + (docs - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / avg)) for t in terms if t in tf]
                found.append((-round(sum(parts), 6), i))
        out |= {(qid, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])}
    return out


def test_bm25_makes_no_pairs_of_questions_and_memories(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(40)]
    rows = [(f"m{n}", "global" if n % 5 == 0 else f"project:{n % 3}", " ".join(rng.choice(words, rng.integers(0, 30)))) for n in range(700)]
    rows += [(f"same{n}", "global", "w1 W2 w3 w3 of all copies") for n in range(150)] + [("null", "global", None), ("empty", "global", "")]
    asked = [(n, " ".join(rng.choice(words, 20)), None if n % 2 else f"project:{n % 4}") for n in range(30)] + [(100, "copies w3", None), (101, None, None), (102, "", None), (103, "unheard", "project:1")]
    m = spark.createDataFrame(rows, "id string, scope string, content string").repartition(5)
    q = spark.createDataFrame(asked, "qid long, text string, scope string")
    want = plain_bm25(asked, rows, 20)
    rounded = lambda df: {(r.qid, r["rank"], r.id, round(r.score, 6)) for r in df.collect()}
    assert rounded(retrieve.bm25(q, m, 20)) == want
    plan = retrieve.bm25(q, m, 20)._jdf.queryExecution().toString()
    assert "Join" not in plan  # the joins of questions with postings grew with the product of both
    monkeypatch.setattr(ranking, "ASKED_BYTES", 700)  # several passes
    monkeypatch.setattr(ranking, "WORDS", 10)
    assert rounded(retrieve.bm25(q, m, 20)) == want
    assert retrieve.bm25(q, m.limit(0)).count() == 0 == retrieve.bm25(q.limit(0), m).count()
    index = Keywords(spark, folder(spark, "keywords"))
    index.put(m.filter("content is not null"), new=True)
    assert rounded(index.bm25(q, 20)) == want


def test_procedures_of_a_large_scope_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vec = lambda: [float(x) for x in np.round(rng.normal(size=4), 3)]
    scopes = ["global"] * 3 + ["project:a", None]
    procedures = [(f"p{n}", scopes[n % 5], vec(), n % 10 / 10) for n in range(300)] + [(f"copy{n}", "project:a", [9.0, 0.0, 0.0, 0.0], 0.5) for n in range(9)] + [("bare", "project:a", None, 0.9)]
    queries = [(n, scopes[n % 5], vec()) for n in range(40)] + [(100, "project:a", [1.0, 0.0, 0.0, 0.0]), (101, "project:none", vec())]
    want = set()
    for qid, scope, q in queries:
        found = sorted((-round(0.7 * float(np.dot(q, v)) + 0.3 * r, 6), i) for i, s, v, r in procedures if scope is not None and s == scope and v is not None)
        want |= {(qid, n + 1, i, -t) for n, (t, i) in enumerate(found[:3])}
    p = spark.createDataFrame(procedures, "id string, scope string, vec array<double>, reliability double").repartition(3)
    q = spark.createDataFrame(queries, "qid long, scope string, vec array<double>")
    got = lifecycle.procedures_for(q, p)
    rounded = lambda df: {(r.qid, r["rank"], r.id, round(r.total, 6)) for r in df.collect()}
    assert rounded(got) == want and "Join" not in got._jdf.queryExecution().toString()
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 300)
    monkeypatch.setattr(vectors, "CELLS", 50)
    assert rounded(lifecycle.procedures_for(q, p)) == want
    assert lifecycle.procedures_for(q, p.limit(0)).count() == 0 == lifecycle.procedures_for(q.limit(0), p).count()


def test_keyword_scores_shuffle_no_text(spark, tmp_path, monkeypatch):
    docs = [(n, f"common words w{n % 7} of text {n}", "en", f"s{n % 3}", 20) for n in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0, n / 400]) for n in range(400)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    given, counted = [], ranking.counted
    monkeypatch.setattr(ranking, "counted", lambda m, tokens: (given.append(m), counted(m, tokens))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in entry.queries()["w03_keyword_scores"](spark, str(tmp_path)).select("qid", "id", "score").collect())
        asked = model.questions(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sql_rows("w03_keyword_scores", tmp_path, "documents", "embeddings") and len(got) == 200
    assert "Join" not in given[0]._jdf.queryExecution().executedPlan().toString()  # every text went through the join with the vectors
    assert "SortMergeJoin" not in asked and "hashpartitioning" not in asked


def test_recall_keeps_texts_out_of_joins_with_vectors(spark, tmp_path, monkeypatch):
    docs = [(n, f"common words w{n % 7} of text {n}", "en", f"s{n % 3}", 20) for n in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0, n / 400]) for n in range(0, 400, 2)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    given, counted = [], ranking.counted
    monkeypatch.setattr(ranking, "counted", lambda m, tokens: (given.append(m), counted(m, tokens))[1])
    got = entry.queries()["r12_recall"](spark, str(tmp_path)).select("qid", "place", "id", "score")
    want = sql_rows("r12_recall", tmp_path, "documents", "embeddings")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 8  # memories without a vector are found too
    assert "Join" not in given[0]._jdf.queryExecution().executedPlan().toString()  # every text went through the join with the vectors


def test_context_takes_contents_of_hits_once(spark, tmp_path):
    docs = [(n, f"common words w{n % 7} of text {n} " + f"v{n % 5} " * (n % 40), "en", f"s{n % 3}", 20) for n in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0, n / 400]) for n in range(0, 400, 2)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["r13_context"](spark, str(tmp_path))
    want = sql_rows("r13_context", tmp_path, "documents", "embeddings")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4
    assert not any("documents.parquet" in f for f in got.inputFiles())  # packing joined all contents to the hits twice
