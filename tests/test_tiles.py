"""Similarity joins by tiles against brute force, with and without cells that are ruled out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import tiles

KIND = "seq long, scope string, vec array<double>"


def clustered(n: int, spread: float, seed: int = 3, dim: int = 16):
    """Vectors about some directions, in three scopes, with equal ones, a null and a zero vector."""
    rng = np.random.default_rng(seed)
    lead = rng.normal(size=(12, dim))
    v = lead[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, ["global", "project:a", "project:b"][i % 3], [float(x) for x in np.round(v[i], 6)]) for i in range(n)]
    rows += [(n + k, "project:a", rows[1][2]) for k in range(40)]
    return [*rows, (n + 50, "global", None), (n + 51, "global", [0.0] * dim), (n + 52, "global", [0.0] * dim)]


def components(rows, floor):
    known = [r for r in rows if r[2] is not None]
    label = {r[0]: r[0] for r in known}
    v = np.array([r[2] for r in known])
    sim = np.round(v @ v.T, 6) >= floor
    while True:
        before = dict(label)
        for i, r in enumerate(known):
            for j in np.flatnonzero(sim[i]):
                o = known[j]
                if r[1] == o[1] or "global" in (r[1], o[1]):
                    label[r[0]] = min(label[r[0]], label[o[0]])
        if before == label:
            return label


@pytest.mark.parametrize(("pivots", "tile", "spread", "floor"), [(256, 2048, 0.05, 0.65), (12, 7, 0.1, 0.9), (3, 5, 0.4, 0.8), (1, 30, 0.3, 0.7), (64, 16, 0.02, 0.99)])
def test_links_connect_what_is_similar(spark, monkeypatch, pivots, tile, spread, floor):
    monkeypatch.setattr(tiles, "PIVOTS", pivots)
    monkeypatch.setattr(tiles, "TILE", tile)
    rows = clustered(150, spread)
    links = [(r.a, r.b) for r in tiles.linked(spark.createDataFrame(rows, KIND).repartition(3), floor).collect()]
    want = components(rows, floor)
    got = {k: k for k in want}
    for _ in range(len(rows)):
        before = dict(got)
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
        if before == got:
            break
    assert got == want
    assert len(links) < 40 * len(rows)  # no pairs


@pytest.mark.parametrize(("pivots", "tile"), [(256, 2048), (5, 9), (40, 4)])
def test_best_are_those_of_brute_force(spark, monkeypatch, pivots, tile):
    monkeypatch.setattr(tiles, "PIVOTS", pivots)
    monkeypatch.setattr(tiles, "TILE", tile)
    rows, asked = clustered(120, 0.2), clustered(30, 0.2, 5)
    items = spark.createDataFrame([(f"i{s}", *r) for s, *r in rows], "id string, scope string, vec array<double>").repartition(4)
    queries = spark.createDataFrame([(s, None if s % 5 == 0 else c, v) for s, c, v in asked], "qid long, scope string, vec array<double>")
    want = []
    for q, scope, v in [(s, None if s % 5 == 0 else c, v) for s, c, v in asked if v is not None]:
        sims = [(-float(np.round(np.dot(v, w), 6)), f"i{i}") for i, c, w in rows if w is not None and (scope is None or c in (scope, "global"))]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(x for x in sims if -x[0] >= 0.6)[:8])]
    got = [(r.qid, r["rank"], r.id, r.sim) for r in tiles.best(queries, items, 8, 0.6).collect()]
    assert sorted(got) == sorted(want)


def test_far_cells_never_meet(spark, monkeypatch):
    rows = clustered(200, 0.01)
    v = np.array([r[2] for r in rows if r[2] is not None and any(r[2])])
    pivots = v[:60]
    cell = (v @ pivots.T).argmax(1)
    about = {c: (1, float(np.sqrt(((v[cell == c] - pivots[c]) ** 2).sum(1)).max()), 1.0) for c in set(cell.tolist())}
    near = tiles.near_cells(pivots, about, about, 0.9)
    assert len(near) < len(about) ** 2 / 2
    for i in about:  # none that is similar is ruled out
        for j in about:
            if (np.round(v[cell == i] @ v[cell == j].T, 6) >= 0.9).any():
                assert (i, j) in near
    empty = tiles.linked(spark.createDataFrame([], KIND), 0.5)
    assert empty.count() == 0 and tiles.linked(spark.createDataFrame(rows[:1], KIND), 0.5).filter(F.col("a") != F.col("b")).count() == 0
