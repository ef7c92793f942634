"""The pipeline's near_dedup at its own similarity, and where ids don't tell rows apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from test_operators import shingle_set

import corpus_pipeline
from memspark.llm import files, minhash


def pair(k: int, changed: int, words: int = 204) -> tuple[str, str]:
    """Two texts of 200 shingles each; every changed word is far from others and changes five."""
    rng = np.random.default_rng(700 + k)
    a = [f"w{i}" for i in rng.integers(0, 10**9, words)]
    b = list(a)
    for i in range(changed):
        b[10 + 15 * i] = f"v{k}x{i}"
    return " ".join(a), " ".join(b)


def test_near_dedup_links_from_080(spark):
    # Similarities: 0.905, 0.861, 0.818, 0.778.
    rows, alike = [], {}
    for k in range(40):
        a, b = pair(k, 2 + k % 4)
        x, y = shingle_set(a), shingle_set(b)
        alike[k] = len(x & y) / len(x | y)
        rows += [(2 * k, a), (2 * k + 1, b)]
    assert sum(0.80 <= s < 0.85 for s in alike.values()) == 10 and sum(s < 0.80 for s in alike.values()) == 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert got == {2 * k for k in alike} | {2 * k + 1 for k, s in alike.items() if s < 0.80}


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    a, near = pair(50, 1)
    lone, other, third = (pair(k, 1)[0] for k in (51, 52, 53))
    rows = [(1, a, "first"), (2, near, "copy of 1"), (2, lone, "alone"), (3, other, "alone"), (3, third, "alone"), (4, third, "copy of 3")]
    rows += [(5, " ", "no words"), (5, None, "no words"), (6, lone + " x", "copy of 2"), (6, "short text", "alone"), (None, a, "no id"), (None, a, "no id")]
    rows += [(3, other, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    want = [(1, a), (2, lone), (3, other), (3, third), (5, " "), (6, "short text"), (None, a), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_a_round_takes_only_the_groups_that_have_open_members_in_it(spark):
    # One group of 200 around a difference, and 400 of two; every member is open.
    diffs = [(0, n, [1]) for n in range(200)] + [(1 + k, 1000 + 2 * k + i, [10 + k]) for k in range(400) for i in (0, 1)]
    rows = [(hub, node, 100, 0.5, 0.5, 0.0, diff, True) for hub, node, diff in diffs]
    members = spark.createDataFrame(rows, "hub long, node long, n int, f double, low double, room double, diff array<long>, open boolean")
    x, y = minhash._heads(members)
    rounds = {(r.hub, r.a): r["round"] for r in x.collect()}
    last = {(r.hub, r.b): r["last"] for r in y.collect()}
    assert len(rounds) == len(last) == 1000 and max(rounds.values()) >= 4
    assert all(max(r for (h, _), r in rounds.items() if h == hub) <= last[hub, b] for hub, b in [(0, 0), (0, 199), (1, 1000)])
    assert all(n == 0 for (hub, _), n in last.items() if hub)  # before, all rows met the labels in every round
    assert sum(n + 1 for n in last.values()) <= 2 * len(last)


def test_tables_are_counted_while_they_are_written_and_small_groups_get_no_chunks(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:59], f"x{n}"]) for n in range(12)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate([*near, " ".join(words[::-1])])], "doc_id long, text string")
    made = len(files._made)
    out = minhash.deduplicate(docs, 80)
    assert sorted(r.doc_id for r in out.collect()) == [0, 12]
    names = [path.rsplit("-", 1)[-1] for _, path in files._made[made:]]
    assert "hot" in names and "chunked" not in names  # before, each comparison wrote pairs twice and looked all of them up
    table = files.saved(spark.range(7).withColumn("odd", F.col("id") % 2), "table", odd=F.sum("odd"))
    assert (files.noted(table), files.noted(table, "odd")) == (7, 3)
    assert files.noted(files.saved(spark.range(0), "none")) == 0
