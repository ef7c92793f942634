"""A small store to look around in, from texts at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators import graph, write


def seed(memories: DataFrame, edges: DataFrame | None, texts: DataFrame, links: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Texts (seq, scope, text) through the write path, and links (a, b) between their numbers; a second time only reinforces."""
    out = write.remember(memories, edges, texts, now, agent="demo")
    ids = out["decisions"].select("seq", "id")
    pairs = links.select("a", "b").join(ids.select(F.col("seq").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("seq").alias("b"), F.col("id").alias("y")), "b")
    more = pairs.filter("x <> y").select(*graph.edge(F.col("x"), F.col("y"), "related_to"))
    out["edges"] = out["edges"].unionByName(more).dropDuplicates(["id"])
    return out
