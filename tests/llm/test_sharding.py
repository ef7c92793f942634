"""Runs of few shards whose merged size is near the target."""

from __future__ import annotations

import numpy as np
import pytest

from memspark.llm import sharding

TARGET = 128 << 20


def planned(spark, shares: list[float]) -> list[tuple[int, int]]:
    """(shards, bytes) of each run that is merged."""
    sizes = [int(x * TARGET) for x in shares]
    rows = [(f"p{i:03d}", s, int(np.floor(np.log(s) / np.log(sharding.TIER))), 0) for i, s in enumerate(sizes)]
    shards = spark.createDataFrame(rows, "path string, bytes long, tier int, level int")
    got = sharding.plan(shards, TARGET).groupBy("run").agg({"path": "count", "bytes": "sum"}).collect()
    return sorted((r["count(path)"], r["sum(bytes)"]) for r in got)


@pytest.mark.parametrize("share", [0.35, 0.4, 0.45, 0.6, 0.7])
def test_shards_of_a_good_part_of_the_target_are_merged(spark, share):
    got = planned(spark, [share] * 20)
    assert sum(n for n, _ in got) == 20
    assert all(n > 1 and TARGET / 2 <= b <= 3 * TARGET / 2 for n, b in got)


def test_shards_near_the_target_or_few_small_ones_stay(spark):
    assert planned(spark, [0.95] * 6) == []
    assert planned(spark, [0.01] * 3) == [] and planned(spark, [0.13] * 3) == []
