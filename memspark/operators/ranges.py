"""Replicas that exchange only what differs: Merkle trees over ranges of keys, compared level by level.

Keys are spread by a digest, whose first digits name a range; a range's hash covers its rows in order, a
node's its sixteen children. Two replicas compare the root, then the children of nodes that differ, and of
the ranges that differ in the end the rows. Where replicas are alike a root is all they exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.session import saved

#: Rows of a range, about, by which the depth is chosen; bytes of a node's name and hash.
RANGE, NODE = 256, 32
FAN = 16


def depth_for(n: int) -> int:
    """Levels below the root, so that ranges of n rows are of some hundred."""
    return max(1, math.ceil(math.log(max(1, n / RANGE), FAN)))


def place(key: str = "id"):
    """The digest whose first digits name a row's range."""
    return F.sha2(F.col(key), 256)


def tree(rows: DataFrame, depth: int, key: str = "id", columns: tuple[str, ...] | None = None) -> DataFrame:
    """level, node, hash, n: all nodes from the ranges, at level depth, up to the root; written."""
    told = [F.coalesce(F.to_json(F.col(c)) if rows.schema[c].dataType.typeName() in ("map", "array", "struct") else F.col(c).cast("string"), F.lit("\x00")) for c in columns or rows.columns]
    each = rows.select(F.substring(place(key), 1, depth).alias("node"), F.sha2(F.concat_ws("\x01", *told), 256).alias("h"))
    level = each.groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("hash"), F.count("*").alias("n"))
    out = level = saved(level.select(F.lit(depth).alias("level"), "node", "hash", "n"), "ranges")
    for k in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat(x["node"], x["hash"]))
        level = level.groupBy(F.substring("node", 1, k).alias("node")).agg(F.sha2(F.array_join(children, ""), 256).alias("hash"), F.sum("n").alias("n"))
        level = level.select(F.lit(k).alias("level"), "node", "hash", "n")
        out = out.unionByName(level)
    return saved(out, "tree")


def compared(mine: DataFrame, theirs: DataFrame, depth: int) -> DataFrame:
    """level, node, differs: the nodes that two trees compare, the root and then the children of those that differ; written.

    What a level exchanges is bounded by what differs above it, so levels are few rows, one job each.
    """
    out = above = None
    for k in range(depth + 1):
        a, b = (t.filter(F.col("level") == k).select("node", F.col("hash").alias(name)) for t, name in ((mine, "a"), (theirs, "b")))
        if above is not None:
            wrong = above.filter("differs").select(F.col("node").alias("_above"))
            a, b = (x.join(wrong, F.substring("node", 1, k - 1) == F.col("_above"), "left_semi") for x in (a, b))
        above = saved(a.join(b, "node", "full_outer").select(F.lit(k).alias("level"), "node", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs")), "level")
        out = above if out is None else out.unionByName(above)
    return out


def within(rows: DataFrame, seen: DataFrame, depth: int, key: str = "id") -> DataFrame:
    """The rows of ranges that differ."""
    wrong = seen.filter((F.col("level") == depth) & F.col("differs")).select(F.col("node").alias("_node"))
    return rows.join(wrong, F.substring(place(key), 1, depth) == F.col("_node"), "left_semi")


def exchange(mine: DataFrame, theirs: DataFrame, depth: int | None = None, key: str = "id", columns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rows of theirs that have to be sent, what was compared on the way)."""
    depth = depth or depth_for(max(mine.count(), theirs.count()))
    seen = compared(tree(mine, depth, key, columns), tree(theirs, depth, key, columns), depth)
    return within(theirs, seen, depth, key), seen


def bill(sent: DataFrame, seen: DataFrame) -> DataFrame:
    """what, n, bytes: nodes compared level by level, and rows sent, with the bytes that either takes."""
    nodes = seen.groupBy("level").agg(F.count("*").alias("n")).select(F.concat(F.lit("level "), F.col("level")).alias("what"), "n", (F.col("n") * NODE).alias("bytes"))
    size = F.octet_length(F.to_json(F.struct(*sent.columns), {"ignoreNullFields": "false"}))
    return nodes.unionByName(sent.agg(F.lit("rows").alias("what"), F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).select("what", "n", "bytes"))
