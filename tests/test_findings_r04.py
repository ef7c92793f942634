"""What round 4's findings named: rows that similarity joins shuffle, the fold of large clusters, a stream's state."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row

from memspark.functions import tiles
from memspark.operators import write
from memspark.streaming import replicas


def _random(n: int, dim: int = 8) -> list[tuple]:
    """Vectors that all keep far from each other, so no cells are ruled out, in three scopes and none."""
    v = np.random.default_rng(5).normal(size=(n, dim))
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 6)
    return [(i, [None, "global", "project:a", "project:b"][i % 4], v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("right", [False, True])
def test_a_row_is_dealt_to_few_tiles(spark, monkeypatch, right):
    dealt = []

    def counted(x, y, *rest, f=tiles.met_tiles, **more):
        dealt.append(x.count() + y.count())
        return f(x, y, *rest, **more)

    monkeypatch.setattr(tiles, "met_tiles", counted)
    monkeypatch.setattr(tiles, "TILE", 16)
    rows = spark.createDataFrame(_random(800), "seq long, scope string, vec array<double>").repartition(4)
    if right:
        some = rows.filter("seq % 2 = 0").selectExpr("seq as qid", "scope", "vec")
        tiles.best(some, rows.selectExpr("cast(seq as string) as id", "scope", "vec"), 3, 0.9)
    else:
        tiles.linked(rows, 0.9)
    assert len(dealt) == 1 and dealt[0] <= 17 * 800


def test_blocks_of_similarities_connect_like_brute_force(monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", (7, 5))
    rows = _random(90, 4)
    v = np.array([r[2] for r in rows])
    cells = np.sort(np.arange(90) % 4)
    near = np.ones((4, 4), bool)
    near[0, 3] = near[3, 0] = False
    tile = tiles.Tile([str(r[0]) for r in rows], [r[1] for r in rows], v, cells)
    want = np.triu((np.round(v @ v.T, 6) >= 0.8) & near[cells][:, cells])
    got = np.zeros_like(want)
    for x, y, sim in tiles._similar(tile, tile, near, 0.8):
        got[x, y] = True
        assert (sim == np.round((v[x] * v[y]).sum(1), 6)).all()
    assert (np.triu(got) == want).all()
    root, label = np.arange(90), np.arange(90)
    tiles._connect(root, *np.nonzero(want))
    for _ in range(90):
        for x, y in zip(*np.nonzero(want), strict=True):
            label[x] = label[y] = min(label[x], label[y])
    assert (root == label).all()


def test_a_clusters_matrix_is_not_made_anew_for_each_candidate(monkeypatch):
    made, vec = [], np.array([1.0, 0.0])
    cluster = write._Cluster()
    monkeypatch.setattr(write.np, "array", lambda *a, f=np.array, **k: made.append(1) or f(*a, **k))
    for k in range(200):
        cluster.add(f"i{k:03d}", "project:a" if k % 2 else None, "fact", "", [1.0, k / 1000], True)
        cluster.nearest("project:a", vec)
    assert not made
    assert cluster.nearest("project:a", vec) == (1, 1.0)
    assert cluster.nearest(None, np.array([0.0, 1.0])) == (198, 0.198)
    assert cluster.nearest("project:b", vec) == (None, 0.0)
    cluster.close(1)
    cluster.change(3, "new", [0.5, 0.0])
    assert cluster.nearest("project:a", vec) == (5, 1.0)


def test_a_version_costs_one_read_of_state_and_no_frame():
    class State:
        held, reads = None, 0

        def get(self):
            self.reads += 1
            return self.held

        def update(self, row):
            self.held = row

    writer, state = replicas.LastWriter(dt.timedelta(days=1)), State()
    writer.state = state
    row = lambda clock, score: Row(id="a", clock=clock, replica="x", updated_at=2**60 + 1, content=f"c{clock}", type="fact", scope="global", erased=False, importance=score, confidence=0.5)
    out = [*writer.handleInputRows(("a",), iter([row(None, None), row(3, 0.2)]), None), *writer.handleInputRows(("a",), iter([row(2, 0.7)]), None)]
    assert state.reads == 2
    assert tuple(out[-1]) == ("a", 3, "x", 2**60 + 1, "c3", "fact", "global", False, 0.7, 0.5, 3)
