"""The kept vector index against brute force, over additions, replacements and removals."""

from __future__ import annotations

import numpy as np
import pytest

from memspark.functions.vectors import nearest
from memspark.operators import lists
from memspark.operators.lists import Lists, ceilings, fit

KIND = "id string, scope string, vec array<double>"
SCOPES = ["global", "project:a", "project:b", None]


def _clustered(n, dims=12, groups=20, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    lead = rng.normal(size=(groups, dims))
    lead /= np.linalg.norm(lead, axis=1, keepdims=True)
    v = lead[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rows(v, name="v"):
    return [(f"{name}{i}", SCOPES[i % 4], [float(x) for x in row]) for i, row in enumerate(v)]


def _asked(spark, v):
    return spark.createDataFrame([(i, [None, "project:a", "nowhere"][i % 3], [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None, None)], "qid long, scope string, vec array<double>")


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_the_index_finds_what_brute_force_finds(spark, tmp_path, spread):
    v = _clustered(900, spread=spread)
    index = Lists(spark, f"file://{tmp_path}/i")
    old = spark.createDataFrame(_rows(_clustered(300, seed=8)), KIND)
    index.put(old.unionByName(spark.createDataFrame([("gone", "global", [1.0] + [0.0] * 11)], KIND)), new=True)
    rows = [*_rows(v), ("zero", "global", [0.0] * 12), ("long", "global", [3.0] + [0.0] * 11), ("none", "global", None), *[(f"same{i}", "global", [float(x) for x in v[5]]) for i in range(9)]]
    now = spark.createDataFrame(rows, KIND)
    index.put(now)
    index.remove(spark.createDataFrame([("gone",), ("nobody",)], "id string"))
    asked = _asked(spark, np.concatenate([v[:6], _clustered(9, seed=11)]))
    want = sorted(map(tuple, nearest(asked, now, 7).collect()))
    hits, read = index.search(asked, 7)
    assert sorted(map(tuple, hits.collect())) == want
    used = {r.qid: (r.lists_read, r.lists) for r in read.collect()}
    assert 999 not in used and all(a <= b for a, b in used.values())
    index.refit()
    hits, read = index.search(asked, 7)
    assert sorted(map(tuple, hits.collect())) == want
    if spread < 1:  # what lies in groups is found in few lists, once the centroids lie in them
        used = [(r.lists_read, r.lists) for r in read.filter("qid < 6").collect()]
        assert sum(a for a, _ in used) < 0.5 * sum(b for _, b in used), used
    assert index.nearest(asked, 500, version=2).filter("id = 'gone'").count() > 0  # as it was then


def test_an_index_of_nothing(spark, tmp_path):
    index = Lists(spark, f"file://{tmp_path}/n")
    none = spark.createDataFrame([], KIND)
    asked = _asked(spark, _clustered(2))
    assert index.nearest(asked, 3).count() == 0
    index.put(none, new=True)
    index.put(spark.createDataFrame([("z", "global", [0.0] * 12), ("n", "global", None)], KIND))
    assert [(r.qid, r.id, r.sim) for r in index.nearest(asked, 3).orderBy("qid").collect()] == [(0, "z", 0.0), (1, "z", 0.0)]
    index.remove(spark.createDataFrame([("z",)], "id string"))
    assert index.nearest(asked, 3).count() == 0
    index.refit()
    assert index.nearest(asked, 3).count() == 0
    index.put(spark.createDataFrame(_rows(_clustered(5)), KIND))
    assert index.nearest(asked, 3).filter("qid = 0").count() == 3


def test_long_lists_and_many_questions_are_cut_into_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lists, "TILE", 16)
    v = _clustered(400, groups=2)
    index, rows = Lists(spark, f"file://{tmp_path}/t"), spark.createDataFrame(_rows(v), KIND)
    index.put(rows, new=True)
    asked = _asked(spark, v[:60])
    assert sorted(map(tuple, index.nearest(asked, 5).collect())) == sorted(map(tuple, nearest(asked, rows, 5).collect()))


def test_ceilings_hold(spark):
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(500, 6)) * rng.uniform(0.1, 3, (500, 1)), rng.normal(size=(40, 6))
    at = fit(v, 15)
    cell = (v @ at.T).argmax(1)
    norm = np.array([np.linalg.norm(v[cell == c], axis=1).max() for c in range(len(at))])
    cosine = np.array([((v[cell == c] @ at[c]) / np.linalg.norm(v[cell == c], axis=1)).min() for c in range(len(at))])
    top = ceilings(q, at, np.arange(len(at)), norm, cosine)
    for c in range(len(at)):
        assert (q @ v[cell == c].T <= top[:, c, None]).all()
