"""A prefix trie of conversations, built in its compressed (Patricia) form.

Each conversation is a sequence of turns, a turn 128 bits of its role and text; texts are not moved. The
sequences are sorted, so those below a node lie side by side, and how many turns each shares with the one
before tells the tree: a range's task keeps a stack of the points on its current path, where the tree
branches or a conversation ends, with compressed edges between them. A point that closes knows the counts,
sums and smallest id of its members, and its edge is then expanded: the nodes on it have the same members,
and differ by the running sums of words along the edge.

Only points on the path that a range shares with the one before or after may have members elsewhere. Of
those, each range gives its part, a row a turn of that path, and the parts are added up. All that is asked of
a node is a sum or a minimum over its members, so a node with a third of all conversations is as many rows
as ranges, no more. The ids that end at one node are digested in order, joined beforehand into long rows.

Cases: a null role or text is empty; null turns come first, equal turns are ordered by a digest of role and
text, and repeated rows stay. Rows without conv_id belong to no conversation. An empty table gives an empty
result. A conversation is one row of 20 bytes a turn, so it may have some hundred million turns; texts may
have any length. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import files

#: Bytes of a turn's key.
KEY = 16
#: Ids that are joined into one row before they are digested.
JOINED = 8 << 10
_NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "kind string, depth long, key binary, above binary, conv_id long, parent_conv_id long, n long, children long, leaves long, sum long, before long, part int, ids string, ends string"
_KINDS = [pa.string(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.int32(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in NODES.split(", ")]


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id and turns of each conversation in order: structs of turn, key and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    each = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), words.alias("words")).alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations of keyed() with the head of the first of their block in place of their own.

    The block of c begins at c - c % every; its first h turns come first, h being the crc32 of c modulo
    heads, then what c has after its first h.
    """
    first = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = convs.withColumn("_first", F.col("conv_id") - F.col("conv_id") % every).join(first, "_first", "left").withColumn("_h", h)
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.expr("slice(_head, 1, _h)"))
    return both.select("conv_id", F.concat(head, F.expr("slice(turns, _h + 1, greatest(size(turns) - _h, 0))")).alias("turns"))


def _sorted(convs: DataFrame) -> DataFrame:
    """conv_id, keys and words in ranges of the sequences' order, written; part is the range, row the place in it."""
    flat = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns.key", F.hex), "")).alias("keys"), F.col("turns.words").alias("words"))
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = flat.repartitionByRange(n, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    return files.saved(ordered.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "sequences")


def _shared(a: Column, b: Column) -> Column:
    """Turns that two sequences have in common from their first on."""
    most = F.least(F.octet_length(a), F.octet_length(b)) / KEY
    same = F.expr("aggregate(sequence(1, cast(_most as int)), 0, (n, k) -> if(n = k - 1 and substring(_a, 16 * k - 15, 16) = substring(_b, 16 * k - 15, 16), k, n))")
    return F.when(most > 0, same).otherwise(F.lit(0))


def _borders(ranges: DataFrame) -> DataFrame:
    """part, left, right: what a range's first and last sequence share with their neighbours'; a row a range, none with all rows."""
    edge = ranges.groupBy("part").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    # Ranges may be empty; ranks make the others neighbours. A row a range.
    edge = files.saved(edge.withColumn("rank", F.row_number().over(Window.orderBy("part"))), "edges")
    ends = ranges.select("part", "row", "keys").join(files.few(edge), "part").filter("row = lo or row = hi")
    ends = files.saved(ends, "ends")
    firsts, lasts = ends.filter("row = lo").select("part", "rank", F.col("keys").alias("_a")), ends.filter("row = hi").select((F.col("rank") + 1).alias("rank"), F.col("part").alias("prev"), F.col("keys").alias("_b"))
    met = firsts.join(lasts, "rank").withColumn("_most", F.least(F.octet_length("_a"), F.octet_length("_b")) / KEY)
    met = files.saved(met.select("part", "prev", _shared(F.col("_a"), F.col("_b")).alias("lcp")), "met")
    left, right = met.select("part", F.col("lcp").alias("left")), met.select(F.col("prev").alias("part"), F.col("lcp").alias("right"))
    return edge.select("part").join(left, "part", "left").join(right, "part", "left").fillna(-1)


class _Point:
    """A point on the current path: what its members that have been passed give, and edges that wait for its smallest id."""

    __slots__ = ("children", "depth", "ends", "kids", "leaves", "low", "n", "shared", "sum")

    def __init__(self, depth: int, children: int = 0, shared: bool = False):
        self.depth, self.children, self.shared = depth, children, shared
        self.n = self.leaves = self.sum = 0
        self.low: int | None = None
        self.ends: list[int] = []
        self.kids: list[tuple] = []

    def take(self, n: int, low: int, leaves: int, total: int) -> None:
        self.n, self.leaves, self.sum = self.n + n, self.leaves + leaves, self.sum + total
        self.low = low if self.low is None else min(low, self.low)


class Builder:
    """The nodes of one range, from its sequences in order.

    left and right: turns that its first and last sequence share with the neighbours'; -1 where there is none.
    """

    def __init__(self, part: int, left: int, right: int):
        self.part, self.left, self.right = part, left, right
        self.stack = [_Point(d, shared=True) for d in range(left + 1)]
        self.keys, self.sums, self.size = b"", np.zeros(1, np.int64), 0
        self.last: int | None = None
        self.rows: list[tuple] = []

    def _name(self, depth: int) -> bytes:
        """What names the node at a depth of the current path in every range."""
        return hashlib.sha256(self.keys[: KEY * depth]).digest()[:KEY]

    def _before(self, depth: int) -> int:
        """Words of the turns above a node of the current path."""
        return int(self.sums[depth - 1]) if depth else 0

    def _common(self, keys: bytes) -> int:
        most = min(len(keys), len(self.keys))
        a, b = (np.frombuffer(x[:most], np.uint64).reshape(-1, 2) for x in (keys, self.keys))
        differ = np.flatnonzero((a != b).any(1))
        return int(differ[0]) if len(differ) else most // KEY

    def add(self, conv_id: int, keys: bytes, words: np.ndarray) -> None:
        common = self.left
        if self.last is not None:
            common = self._common(keys)
            self._leave(common)
        self.keys, self.size, self.last = keys, len(keys) // KEY, conv_id
        self.sums = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
        if self.stack:  # its top is where this sequence leaves the one before
            self.stack[-1].sum += int(self.sums[common])
            self.stack[-1].children += self.size > common
        if not self.stack or self.stack[-1].depth < self.size:
            self.stack.append(_Point(self.size))
        self.stack[-1].ends.append(conv_id)

    def _leave(self, depth: int) -> None:
        """Count the current sequence, and close the points below a depth of its path; the tree has a point there."""
        self.stack[-1].take(1, self.last, int(depth < self.size), 0)
        while self.stack and self.stack[-1].depth > depth:
            done = self.stack.pop()
            if depth >= 0 and (not self.stack or self.stack[-1].depth < depth):
                self.stack.append(_Point(depth, 1))
            self._close(done)

    def _close(self, done: _Point) -> None:
        parent = self.stack[-1] if self.stack else None
        if done.shared:
            self._parts(done, done.depth - 1)
        else:
            self._expand(done, parent)
        if parent is not None:
            parent.take(done.n, done.low, done.leaves, done.sum)

    def _expand(self, done: _Point, parent: _Point | None) -> None:
        """The nodes along a closed point's edge, by the sums of words from each to its end."""
        self.rows += [(*row[:5], done.low, *row[6:]) for row in done.kids]
        above, n, low = parent.depth if parent else -1, done.n, done.low
        saved = done.sum - (n - 1) * self._before(done.depth)
        for d in range(done.depth, above, -1):
            last = d == done.depth
            suffix = self._before(done.depth) - self._before(d)
            ends = hashlib.sha256(_joined(done.ends).encode()).hexdigest() if last else _NO_ENDS
            row = ("node", d, None, None, low, low, n, int(done.children) if last else 1, done.leaves, saved + (n - 1) * suffix, None, None, None, ends)
            if d > above + 1:
                self.rows.append(row)
            elif parent is None:
                self.rows.append((*row[:5], None, *row[6:]))  # the root
            elif parent.shared:
                self.rows.append((*row[:3], self._name(above), low, None, *row[6:]))
            else:
                parent.kids.append(row)

    def _parts(self, point: _Point, above: int) -> None:
        """What this range gives of the nodes from a point up to the one above, which other ranges have members of."""
        for d in range(point.depth, above, -1):
            last = d == point.depth
            key, up = self._name(d), self._name(d - 1) if d else None
            self.rows.append(("part", d, key, up, point.low, None, point.n, int(point.children) if last else 1, point.leaves, point.sum, self._before(d), self.part, None, None))
            if last:
                self.rows += [(*row[:3], key, row[4], None, *row[6:]) for row in point.kids]
                for k in range(0, len(point.ends), JOINED):
                    self.rows.append(("ids", d, key, None, None, None, k, None, None, None, None, self.part, _joined(point.ends[k : k + JOINED]), None))

    def end(self) -> None:
        """Close the range; what is left on its path goes on in the next."""
        if self.last is None:
            return
        self._leave(self.right)
        while self.stack:
            done = self.stack.pop()
            self._parts(done, self.stack[-1].depth if self.stack else -1)
            if self.stack:
                self.stack[-1].take(done.n, done.low, done.leaves, done.sum)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), _KINDS, strict=True)], names=_NAMES)
        self.rows = []
        return out


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _built(ranges: DataFrame) -> DataFrame:
    """Rows of all ranges: finished nodes, parts of shared ones, and joined ids that end at those."""
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = ranges.join(files.few(_borders(ranges)), "part").select("part", "row", "left", "right", "conv_id", "keys", "words")
    ordered = told.repartition(n, "part").sortWithinPartitions("part", "row")

    def run(batches):
        builder = None
        for batch in batches:
            part, _, left, right, ids = (batch.column(k).to_pylist() for k in range(5))
            for k, conv_id in enumerate(ids):
                if builder is None or builder.part != part[k]:
                    if builder is not None:
                        builder.end()
                        yield builder.batch()
                    builder = Builder(part[k], left[k], right[k])
                builder.add(conv_id, batch.column(5)[k].as_py(), batch.column(6)[k].values.to_numpy())
                if len(builder.rows) >= 20_000:
                    yield builder.batch()
        if builder is not None:
            builder.end()
            yield builder.batch()

    return ordered.mapInArrow(run, NODES)


def _digested(ids: DataFrame) -> DataFrame:
    """key and ends: the digest of the ids that end at each shared node, joined as they come in order."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.select("key", "part", "n", "ids").repartition(n, "key").sortWithinPartitions("key", "part", "n").select("key", "ids")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "ends"])

    return ordered.mapInArrow(run, "key binary, ends string")


def nodes(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of conv_id and turns, as ``keyed`` gives them.

    conv_id and parent_conv_id are the smallest members of the node and of the one above (none above the
    root); n_convs, n_children, n_leaves count members, children and the leaves below; saved_tokens are the
    words that sharing saves below and at the node; ends_sha256 digests the ids that end at it.
    """
    with files.scope(convs.sparkSession):
        built = files.saved(_built(_sorted(convs)), "nodes", keep=True)
    done, parts = built.filter("kind = 'node'"), built.filter("kind = 'part'")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "sum")]
    shared = files.saved(parts.groupBy("depth", "key", "above").agg(F.min("conv_id").alias("conv_id"), F.max("before").alias("before"), *sums), "shared", keep=True)
    up = files.few(shared.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id")))
    ends = _digested(built.filter("kind = 'ids'"))
    last = shared.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(_NO_ENDS))).withColumn("sum", F.col("sum") - (F.col("n") - 1) * F.col("before"))
    columns = ["depth", "conv_id", "n", "children", "leaves", "sum", "ends"]
    below = done.filter("above is not null").select("above", *columns).unionByName(last.select("above", *columns)).join(up, "above", "left")
    every = done.filter("above is null").select(*columns, "parent_conv_id").unionByName(below.select(*columns, "parent_conv_id"))
    return every.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("sum").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def prefixes(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the conversations rebuilt from turns."""
    convs = files.saved(keyed(turns), "conversations", keep=True)
    return nodes(rebuilt(convs, every, heads))
