"""The longest match with a benchmark of several blocks."""

from __future__ import annotations

from test_operators import rows_of, vary

from memspark.llm import decontam


def test_longest_match_is_that_of_all_blocks(spark, monkeypatch):
    texts = [vary(k, 120, base=80 + k) for k in range(6)]
    bench = spark.createDataFrame([(f"i{k}", " ".join(t.split()[10 : 30 + k])) for k, t in enumerate(texts)], "item_id string, text string")
    rows = [(k, t) for k, t in enumerate(texts)] + [(10, texts[0] + " " + texts[5]), (11, texts[5] + " " + texts[2]), (12, None), (13, "nothing of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(k, 20 + k) for k in range(6)] + [(10, 25), (11, 25), (12, 0), (13, 0)], key=repr)
    assert rows_of(decontam.score(docs, bench), "doc_id", "longest") == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    assert len([b for b in decontam.blocks(bench) if len(b.ids)]) > 1
    assert rows_of(decontam.score(docs, bench), "doc_id", "longest") == want
    assert sorted(r.doc_id for r in decontam.remove(docs, bench).collect()) == [12, 13]


def test_many_equal_items_and_texts_that_repeat_themselves(spark):
    import hashlib

    passage = vary(3, 60, base=70)
    words = passage.split()
    items = [(k, passage) for k in range(3000)] + [(5000 + k, passage + f" own{k} more words of its own that end it {k} x y z") for k in range(200)]
    items += [(7000, "lo " * 300), (7001, "lo " * 40 + "hi"), (7002, "two words")]
    rows = [(1, f"a {passage} b"), (2, "lo " * 5000), (3, " ".join(words[5:40])), (4, "lo " * 20 + "hi"), (5, "clean"), (6, "some two words more")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.score(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    ids = sorted([str(k) for k in range(3000)] + [str(5000 + k) for k in range(200)])
    assert (got[1].n_items, got[1].longest, got[1].longest_at, got[1].n_hit) == (3200, 60, 1, 60)
    assert got[1].items_sha256 == got[3].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert (got[2].longest, got[2].longest_at, got[2].n_hit, got[2].n_items) == (300, 0, 5000, 2)
    assert (got[3].longest, got[3].n_hit) == (35, 35) and (got[4].longest, got[4].longest_at, got[4].n_items) == (21, 0, 2)
    assert (got[5].n_items, got[5].longest_at) == (0, None) and (got[6].n_items, got[6].longest) == (1, 2)


def test_matches_laid_out_in_parts_are_the_same(spark, monkeypatch):
    items = [(k, vary(k % 4, 50, base=60) + " " + vary(k, 12, base=90 + k)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, t) for k, t in items] + [(50, items[0][1] + " " + items[5][1])], "doc_id long, text string")
    names = ("doc_id", "item_id", "doc_word", "item_word", "n_words")
    want = rows_of(decontam.matches(docs, bench), *names)
    assert len(want) > 30
    monkeypatch.setattr(decontam, "LAID_OUT", 25)
    assert rows_of(decontam.matches(docs, bench), *names) == want
