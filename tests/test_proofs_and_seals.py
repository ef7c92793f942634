"""Hubs, exact percentiles, proofs and sealed containers."""

from __future__ import annotations

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from memspark.operators import evaluate, retrieve, trust
from memspark.sources import sealed


@pytest.mark.parametrize("depth", [1, 2])
def test_seeds_reach_through_hubs_once_each(spark, depth):
    rng = random.Random(depth)
    links = [("hub", f"m{i}") for i in range(60)] + [(f"m{rng.randrange(60)}", f"m{rng.randrange(60)}") for _ in range(80)] + [("m1", "m1")]
    fused = [(q, f"m{rng.randrange(60)}", rng.random()) for q in range(4) for _ in range(9)]
    fused = list({(q, i): (q, i, r) for q, i, r in fused}.values())
    near: dict[str, set] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {}
    for q in range(4):
        mass: dict[str, float] = {}
        for _, s, r in sorted((x for x in fused if x[0] == q), key=lambda x: (-x[2], x[1]))[: retrieve.SEEDS]:
            reached, front = set(), {s}
            for _ in range(depth):
                front = {y for x in front for y in near.get(x, ())}
                reached |= front
            for y in reached - {s}:
                mass[y] = mass.get(y, 0) + r
        want |= {(q, y): m / max(mass.values()) for y, m in mass.items()}
    edges = spark.createDataFrame(links, "from_id string, to_id string")
    got = retrieve.graph_mass(spark.createDataFrame(fused, "qid int, id string, rrf double"), edges, depth).collect()
    assert {(r.qid, r.id): r.graph for r in got} == pytest.approx(want, abs=1e-8)


def test_percentiles_of_one_group_of_all_rows(spark):
    rng = random.Random(4)
    rows = [("all", rng.random()) for _ in range(3000)] + [("same", 2.0)] * 500 + [("one", 7.0), ("all", None), (None, 1.0), (None, 3.0), ("none", None)]
    got = evaluate.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(9), "v", "g", (0, 50, 95, 100))
    want = {}
    for g in ("all", "same", "one", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = tuple(v[round(p / 100 * (len(v) - 1))] for p in (0, 50, 95, 100))
    assert {r.g: (r.p0, r.p50, r.p95, r.p100) for r in got.collect()} == want
    assert evaluate.nearest_rank(spark.createDataFrame([], "g string, v double"), "v", "g").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 33])
def test_a_proof_holds_for_its_leaf_alone(spark, n):
    leaves = spark.createDataFrame([(f"f{i}", f"text {i // 2}") for i in range(n)], "id string, t string").select("id", F.sha2("t", 256).alias("leaf"))
    root = trust.merkle_levels(leaves).first()["root"]
    proofs = trust.merkle_proofs(leaves)
    assert {r.id for r in trust.proven(proofs, root).filter("ok").collect()} == {f"f{i}" for i in range(n)}
    other = proofs.withColumn("leaf", F.sha2(F.concat("leaf", F.lit("x")), 256))
    assert not trust.proven(other, root).filter("ok").count()
    some = trust.merkle_proofs(leaves, spark.createDataFrame([("f0",), ("nobody",)], "id string"))
    assert [r.ok for r in trust.proven(some, root).collect()] == [True]


def test_an_empty_table_has_no_proofs(spark):
    assert trust.merkle_proofs(spark.createDataFrame([], "id string, leaf string")).count() == 0


def test_a_sealed_container_opens_whole_or_not(spark, tmp_path):
    root, key = f"file://{tmp_path}/c", b"0123456789abcdef"
    rows = [(i, None if i % 5 == 0 else f"secret {i}", [i, None], dt.datetime(2024, 1, 1, 0, i % 60)) for i in range(25)] * 2
    facts = spark.createDataFrame(rows, "id long, `a.text` string, list array<int>, at timestamp")
    sealed.seal({"facts": facts, "none": facts.limit(0)}, root, key, "team", 8)
    assert sorted(map(str, sealed.unseal(spark, root, key, "facts").collect())) == sorted(map(str, facts.collect()))
    assert sealed.unseal(spark, root, key, "none").count() == 0 and sealed.unseal(spark, root, key, "facts", [2]).count() == 8
    raw = spark.read.parquet(f"{root}/sealed/facts")
    assert not any(b"secret" in bytes(r.sealed) for r in raw.collect())
    with pytest.raises(sealed.Broken):
        sealed.manifest_of(spark, root, b"another key 16 b")
    bad = f"file://{tmp_path}/bad"
    for change in (raw.withColumn("block", F.when(F.col("block") < 2, 1 - F.col("block")).otherwise(F.col("block"))), raw.filter("block <> 3"), raw.union(raw.filter("block = 1"))):
        shutil.copytree(f"{tmp_path}/c", f"{tmp_path}/bad", dirs_exist_ok=True)
        change.write.mode("overwrite").parquet(f"{bad}/sealed/facts")
        assert sealed.verified(spark, bad, key) == {"facts": False, "none": True}
        with pytest.raises(sealed.Broken):
            sealed.unseal(spark, bad, key, "facts")
    with pytest.raises(sealed.Broken):
        sealed.unseal(spark, bad, key, "facts", [99])
