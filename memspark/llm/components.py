"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links(a, b)``: the smallest node that it reaches.

    Each round takes the smallest label among neighbours, then follows labels once, so path lengths
    halve. Labels are minima, combined before each shuffle; they are broadcast while they are few, and
    beyond that joins on them are open to AQE's splitting of skewed keys. Each round is written to the
    shared folder; nothing is collected but counts. Null ends and links of a node to itself reach
    nothing new.
    """
    links = links.filter("a is not null and b is not null").select("a", "b")
    both = files.saved(links.union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = files.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels0")
    n, k = files.noted(labels), 0
    while True:
        k += 1
        own = labels.select("node", "label", F.col("label").alias("old"))
        near = both.join(files.few(labels, 24, n), both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        low = files.saved(near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), f"low{k}")
        jump = low.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = low.join(files.few(jump, 24, n), low["label"] == jump["at"]).select("node", "old", F.least("label", "further").alias("label"))
        new = files.saved(new, f"labels{k}", moved=F.count_if(F.col("label") != F.col("old")))
        files.drop(low)
        labels = new.select("node", "label")
        if not files.noted(new, "moved"):
            return labels
