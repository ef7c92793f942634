"""Replicas that exchange the ranges that differ."""

from __future__ import annotations

import hashlib

import pytest

from memspark.operators import ranges

KIND = "id string, content string, clock long"


def rows_for(n: int) -> list[tuple]:
    return [(f"m{i}", f"text {i}" if i % 9 else None, i % 4) for i in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_rows_of_ranges_that_differ_are_sent(spark, depth):
    mine = rows_for(400)
    theirs = [(i, c, k + (i == "m7")) for i, c, k in mine if i != "m90"] + [("new", None, 1), ("m9", "text of it", 1)]
    theirs = [r for r in theirs if r != ("m9", None, 1)]
    place = lambda i: hashlib.sha256(i.encode()).hexdigest()[:depth]
    wrong = {place(i) for i in ("m7", "m90", "new", "m9")}
    sent, seen = ranges.exchange(spark.createDataFrame(mine, KIND).repartition(3), spark.createDataFrame(theirs, KIND).repartition(2), depth)
    assert sorted(map(repr, map(tuple, sent.collect()))) == sorted(repr(r) for r in theirs if place(r[0]) in wrong)
    got = {(r.level, r.node): r.differs for r in seen.collect()}
    above = {w[:k] for w in wrong for k in range(depth + 1)}
    assert {n for (_, n), d in got.items() if d} == above
    assert all(level == 0 or node[:-1] in above for level, node in got)


def test_equal_replicas_exchange_a_root(spark):
    rows = spark.createDataFrame(rows_for(300), KIND)
    sent, seen = ranges.exchange(rows, rows.repartition(5))
    assert sent.count() == 0 and [tuple(r) for r in seen.collect()] == [(0, "", False)]
    none = spark.createDataFrame([], KIND)
    assert ranges.exchange(none, none)[0].count() == 0 and ranges.exchange(none, rows)[0].count() == 300
    assert ranges.depth_for(10**9) == 6 and ranges.depth_for(1) == 1
