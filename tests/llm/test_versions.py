"""Versions of a store of shards: each stays readable, whatever is committed after it."""

from __future__ import annotations

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import odd_rows

from memspark.llm import sharding

SCHEMA = "doc_id long, text string, tier int, folder string, path string, bytes long, run string, shard_file string, manifest_version long, _metadata string, _run string"


def odd_table(spark, n=9):
    rows = [(r[0], r[1], 1, "f", None, 2, "r", "s", 3, "m", "x") for r in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(n)


def content(df):
    return Counter(map(repr, map(tuple, df.collect())))


def test_every_version_is_readable_after_compactions(spark, tmp_path):
    root, odd = f"file://{tmp_path}/s", odd_table(spark)
    once = content(odd)
    times = lambda k: Counter({x: k * n for x, n in once.items()})
    sharding.append(odd, root), sharding.append(odd, root)
    assert sharding.compact(spark, root) == 3
    sharding.append(odd, root)
    sharding.append(odd.repartition(12), root)
    assert sharding.compact(spark, root) == 6
    for version, k in ((1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 4)):
        out = sharding.read(spark, root, version)
        assert out.columns == odd.columns and content(out) == times(k), version
    assert sharding.manifest(spark, root, 6).count() < sharding.manifest(spark, root, 5).count()
    sharding.vacuum(spark, root)
    assert content(sharding.read(spark, root)) == times(4) and sharding.read(spark, root, 6).count() == 4 * odd.count()
    sharding.vacuum(spark, root, retain=1, grace_seconds=0)
    assert sharding.versions(spark, root) == [6] and content(sharding.read(spark, root)) == times(4)


def test_waves_commit_one_by_one(spark, tmp_path, monkeypatch):
    root, odd = f"file://{tmp_path}/s", odd_table(spark, 12)
    for _ in range(6):
        sharding.append(odd, root)
    monkeypatch.setattr(sharding, "WAVE_SHARDS", 20)
    monkeypatch.setattr(sharding, "SECTION", 6)
    before = sharding.versions(spark, root)[-1]
    last = sharding.compact(spark, root)
    assert last > before + 1
    for v in range(before, last + 1):
        assert sharding.read(spark, root, v).count() == 6 * odd.count()


def test_two_writers_lose_nothing(spark, tmp_path):
    root, odd = f"file://{tmp_path}/s", odd_table(spark, 5)
    sharding.append(odd, root)
    errors = []

    def write():
        try:
            sharding.append(odd, root)
            sharding.compact(spark, root)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    both = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in both], [t.join() for t in both]
    assert not errors and sharding.read(spark, root).count() == 3 * odd.count()


def test_a_wave_gives_way_to_another_compaction(spark, tmp_path):
    root, odd = f"file://{tmp_path}/s", odd_table(spark, 8)
    sharding.append(odd, root)
    stale = sharding.plan(sharding.manifest(spark, root))
    stale = spark.createDataFrame(stale.collect(), stale.schema)
    sharding.compact(spark, root)
    with pytest.raises(sharding.Replaced):
        sharding._wave(spark, root, stale, sharding.TARGET_BYTES)
    assert sharding.read(spark, root).count() == odd.count()


def test_empty_and_named_shards(spark, tmp_path):
    odd = odd_table(spark)
    out, root, version = sharding.shard(odd.limit(0), f"file://{tmp_path}/e")
    assert out.count() == 0 and out.columns == odd.columns and version == 1  # nothing to merge, nothing to commit
    out, _, _ = sharding.shard(odd, f"file://{tmp_path}/n", file="where")
    assert out.columns == [*odd.columns, "where"] and out.filter(F.col("where").endswith(".parquet")).count() == odd.count()


def test_later_columns_stay_and_clashes_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    one = spark.range(40).selectExpr("id AS doc_id", "concat('t', id) AS text").repartition(6)
    two = spark.range(40, 60).selectExpr("concat('t', id) AS text", "id AS doc_id", "'en' AS lang").repartition(5)
    sharding.append(one, root), sharding.append(two, root)
    want = Counter([(i, f"t{i}", None if i < 40 else "en") for i in range(60)])
    for version in (2, sharding.compact(spark, root)):
        out = sharding.read(spark, root, version)
        assert out.columns == ["doc_id", "text", "lang"] and Counter(map(tuple, out.collect())) == want
    assert sharding.read(spark, root, 1).columns == ["doc_id", "text"] and version == 3
    with pytest.raises(ValueError, match="doc_id"):
        sharding.append(spark.createDataFrame([("x",)], "doc_id string"), root)
    assert sharding.versions(spark, root)[-1] == 3


def test_many_shards_become_files_near_the_target(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RUNS_A_JOB", 3)
    root = f"file://{tmp_path}/m"
    docs = spark.range(0, 5000, 1, 50).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), cast(1 + id % 9 AS int)) AS text")
    sharding.append(docs, root, arrivals=10)
    before = sharding.manifest(spark, root)
    assert before.count() == 500 and sharding.versions(spark, root) == [1]
    target = before.agg(F.sum("bytes")).first()[0] // 12
    assert sharding.compact(spark, root, target) == 2
    after = sharding.manifest(spark, root)
    assert after.count() < 60 and after.agg(F.max("bytes")).first()[0] <= 1.5 * target
    assert sharding.read(spark, root).exceptAll(docs).count() == 0 and sharding.read(spark, root).count() == 5000
    runs = sharding.plan(before, target).select("run").distinct().count()
    assert after.filter("level = 1").count() == runs  # a file a run
    assert sharding.compact(spark, root, target) in (2, 3)


def test_small_tables_are_merged_too(spark, tmp_path):
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text")
    out, root, version = sharding.shard(docs, f"file://{tmp_path}/t")
    assert version == 2 and sharding.manifest(spark, root, 2).count() < sharding.manifest(spark, root, 1).count() == sharding.ARRIVALS
    assert out.exceptAll(docs).count() == 0 and out.count() == 300
