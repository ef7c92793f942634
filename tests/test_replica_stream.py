"""Streams of replicas' versions against the merge of the whole."""

from __future__ import annotations

import datetime as dt
import random

from memspark.operators import merge
from memspark.sources import snapshots
from memspark.streaming import replicas

_VERSION = "id string, clock long, replica string, updated_at timestamp, content string, type string, scope string, erased boolean, importance double, confidence double"


def _versions(n, seed=1):
    rng = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(3))
    text = lambda: rng.choice([None, "a", "b", "c"])
    return [(f"k{rng.randrange(n // 4)}", rng.choice([None, 1, 2, 3]), rng.choice("xyz"), at(), text(), "fact", "global", False, rng.choice([None, 0.2, 0.7]), rng.random()) for _ in range(n)]


def test_a_stream_of_replicas_ends_where_the_merge_does(spark, tmp_path):
    rows = _versions(120)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(_VERSION).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k in range(3):  # in batches out of order, the last after a restart
        spark.createDataFrame(rows[k::3], _VERSION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k:
            replicas.replicate_into(stream, f"file://{tmp_path}/r", f"{tmp_path}/cp").awaitTermination(200)
    shape = ["id", "content", "clock", "replica", "importance", "confidence", "replicas"]
    want = merge.last_writer(spark.createDataFrame(rows, _VERSION).drop("erased")).select(*shape)
    got = snapshots.pull(spark, f"file://{tmp_path}/r", "replicated").select(*shape)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_erased_ids_go_and_only_a_later_writer_brings_them_back(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    row = lambda i, clock, erased=False: (i, clock, "x", at, f"{i}{clock}", "fact", "global", erased, 0.5, 0.5)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(_VERSION).parquet(f"{tmp_path}/in")
    batches = [[row("a", 1), row("b", 1), row("c", 1)], [row("a", 3, True), row("b", 2, True), row(None, 1)], [row("a", 2), row("b", 4)]]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, _VERSION).write.mode("append").parquet(f"{tmp_path}/in")
        replicas.replicate_into(stream, f"file://{tmp_path}/r", f"{tmp_path}/cp").awaitTermination(200)
        seen.append(sorted(r.content for r in snapshots.pull(spark, f"file://{tmp_path}/r", "replicated").collect()))
    assert seen == [["a1", "b1", "c1"], ["c1"], ["b4", "c1"]]
