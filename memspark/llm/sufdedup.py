"""Removal of byte strings that repeat, by blockwise suffix sorting with a difference cover.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else goes. Suffixes are put
into buckets, and one block of buckets is sorted at a time:

1. Texts that are equal as a whole are found by a 128-bit digest; one of them stands for all.
2. The bucket of a string is the smallest hash of its ``K``-byte pieces, its anchor. Equal strings have
   equal anchors at equal places, so a bucket never needs another. The strings that share one anchor
   are a stretch of neighbours; a text gives one row per stretch, some 1.5 % of its bytes. Buckets with
   one stretch are dropped. Equal stretches become one with a count, before they are shuffled: those of
   a text where it is read, others in a counted aggregation.
3. The bytes of all stretches left are fetched and suffix-sorted block by block. A block is laid out
   with anchors on multiples of the period of a difference cover, and suffixes at the cover's places get
   ranks beforehand; a long tie of two suffixes is settled by the ranks of the cover place that both
   reach within one period, and by the bytes before and after it. Memory is bounded by the block.
4. A bucket of over ``BUCKET`` different stretches is split by the bytes that its strings go on with:
   strings ``WIDTHS`` bytes apart at most share all bytes but a few, so a hash of the shared ones names
   a smaller bucket. Those are sorted like others; at the last width all strings of a bucket are equal.

What a row loses travels to it by its place (see ``places``); texts are never shuffled.

Cases: a null text is empty; texts shorter than the length have nothing to remove; matches never cross
documents. Equal rows repeat each other. Null and equal ids make no difference. Extra columns are not
looked at. An empty table gives an empty result. Texts are read as bytes, so no text is invalid, and in
pieces, so long ones take no more memory than their own bytes. Stretches are told apart by two hashes
of 64 bits, the anchor's and their own, of bytes that overlap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, places
from . import text as tx

LENGTH = 200
K = 64
#: Period of the difference cover.
PERIOD = 32
#: Bytes of stretches that are sorted together, and stretches of a bucket up to which it isn't split.
BLOCK_BYTES, BUCKET = 256 << 10, 20_000
#: Strings of a stretch that stay together when a bucket is split, level by level.
WIDTHS = (8, 1)
#: Strings that are sorted together, roughly; bytes of text that anchors are sought in together, and that are worked on at a time.
TILE, SLICE, WINDOW = 50_000, 128 << 10, 1 << 20


def difference_cover(period: int) -> list[int]:
    """Residues of which some pair differs by each d modulo the period; greedy."""
    cover, seen = [0], {0}
    while len(seen) < period:
        new = {r: ({(r - c) % period for c in cover} | {(c - r) % period for c in cover}) - seen for r in range(period) if r not in cover}
        best = max(new, key=lambda r: (len(new[r]), -r))
        cover.append(best)
        seen |= new[best]
    return sorted(cover)


COVER = difference_cover(PERIOD)
#: From each residue, bytes to the next place of the cover.
TO_COVER = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


def stretches(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K):
    """Row, anchor hash, first and last string start, and anchor place, of each stretch."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    begin, stop = offs[:-1], offs[1:] - length + 1
    fits = stop > begin
    if n < length or not fits.any():
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    h = tx.Hasher(buf)
    at = np.arange(n - k + 1)
    grams = h(at, at + k)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    have, want = 1, length - k + 1
    while have * 2 <= want:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < want:
        low = np.minimum(low[: len(low) - (want - have)], low[want - have :])
    edge = np.zeros(n + 1, np.int8)
    edge[begin[fits]] += 1
    edge[stop[fits]] -= 1
    start = np.flatnonzero(np.cumsum(edge[: len(low)]))
    place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(start) != 1))))
    last = np.append(first[1:], len(start)) - 1
    i0, i1, p = start[first], start[last], place[first]
    return np.searchsorted(offs, i0, "right") - 1, grams[p], i0, i1, p


def cover_ranks(text: np.ndarray, word: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks of the 168 bytes from each of the places, which hold the cover's residues of a block."""
    index = np.zeros(len(text), np.int64)
    index[places] = np.arange(len(places))
    w = [word[places + 8 * j].astype(np.uint64) for j in range(4)]
    order = np.lexsort(w[::-1])
    new = np.zeros(len(places), np.uint64)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in w], axis=0)
    r32 = np.zeros(len(places), np.uint64)
    r32[order] = np.cumsum(new).astype(np.uint64)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique((a << np.uint64(32)) | b, return_inverse=True)[1].astype(np.uint64)

    def after(r: np.ndarray, step: int) -> np.ndarray:
        return r[index[np.minimum(places + step, len(text) - 1)]]

    r64 = joined(r32, after(r32, 32))
    r128 = joined(r64, after(r64, 64))
    r160 = joined(r128, after(r32, 128))
    tail = np.unique(word[places + 160].astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return joined(r160, tail)


def sort_block(bucket: np.ndarray, data: np.ndarray, offs: np.ndarray, anchor: np.ndarray, times: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH):
    """Suffix-sort a block of buckets; (stretch, string) of each string that occurs twice in its bucket.

    ``data[offs[k]:offs[k + 1]]`` is a stretch and ``anchor[k]`` the place of its anchor in it. Equal
    stretches are one with their number in ``times``. Strings count that start from ``low[k]`` up to
    ``high[k]`` bytes before the anchor.
    """
    size = np.diff(offs)
    n = size - length + 1
    # Each stretch begins where its anchor meets a multiple of the period.
    room = size + 2 * PERIOD
    room = room + (-room) % PERIOD
    base = np.cumsum(room) - room
    begin = base + (-anchor) % PERIOD
    text = np.zeros(int(room.sum()) + 2 * length, np.uint8)
    text[np.repeat(begin - offs[:-1], size) + np.arange(len(data))] = data
    word = np.ndarray((len(text) - 8,), ">u8", text.data, strides=(1,))
    marked = np.zeros(len(text), bool)
    for c in COVER:
        marked[c::PERIOD] = True
    marked[-length:] = False
    places = np.flatnonzero(marked)
    ranks = np.zeros(len(text), np.uint32)
    ranks[places] = cover_ranks(text, word, places)
    # Strings at different distances from their anchors are never equal, so distances go tile by tile.
    tiles = max(1, int(n.sum()) // TILE)
    width = -(-(length - K + 1) // tiles)
    found = [_sort_tile(bucket, begin, anchor, n, times, ranks, word, np.maximum(low, d), np.minimum(high, d + width - 1), length) for d in range(0, length - K + 1, width)]
    owner, step = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((step, owner))
    return owner[order], step[order]


def _sort_tile(bucket, begin, anchor, n, times, ranks, word, near: np.ndarray, far: np.ndarray, length: int):
    """sort_block() for the strings that start from near to far bytes before their anchor."""
    lo, hi = np.maximum(anchor - far, 0), np.minimum(anchor - near + 1, n)
    m = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(n)), m)
    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + lo[owner]
    start = begin[owner] + step
    tie = ranks[start + TO_COVER[start % PERIOD]].astype(np.uint64)
    distance = (anchor[owner] - step).astype(np.uint64)
    # What no other string has the cover's rank of, in its bucket and at its distance, sorts alone.
    at = np.flatnonzero(tx.repeated(tx.mix(bucket[owner] + tx.mix(tie * np.uint64(512) + distance))))
    s = start[at]
    head = [word[s + 8 * j].astype(np.uint64) for j in range(4)]
    tail = [word[s + length - 32 + 8 * j].astype(np.uint64) for j in range(4)]
    columns = [bucket[owner[at]], distance[at], *head, tie[at], *tail]
    order = np.lexsort(columns[::-1])
    same = np.all([x[order][1:] == x[order][:-1] for x in columns], axis=0)
    hit = times[owner] > 1  # neighbours of equal stretches are equal
    twice = np.zeros(len(at), bool)
    twice[1:] = same
    twice[:-1] |= same
    hit[at[order[twice]]] = True
    return owner[hit], step[hit]


def _ranges(owner: np.ndarray, step: np.ndarray):
    """Runs of consecutive strings of a stretch: owner, first, last."""
    if not len(owner):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(step) != 1))))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], step[first], step[last]


def _pieces(offs: np.ndarray):
    """(row, first byte, past the last) of pieces of rows, or runs of whole rows as (first row, past the last, None)."""
    for a, b in tx.slices(offs, SLICE):
        if b - a == 1 and offs[b] - offs[a] > 2 * SLICE:
            for at in range(int(offs[a]), int(offs[b]) - LENGTH + 1, SLICE):
                yield a, at, min(at + SLICE + LENGTH - 1, int(offs[b]))
        else:
            yield a, b, None


def _emit(docs: DataFrame, folder: str) -> DataFrame:
    """t, anchor, whole, left, right, place, step, times, weight, salt: the stretches of the marked texts.

    A stretch starts ``left`` to ``right`` bytes before its anchor, which is at ``place``, and again each
    ``step`` bytes, ``times`` times in all. weight counts the occurrences of the anchor known to the task
    at this row; salt is 0 for the anchor's first row in the task's batch, and spreads the others.
    """
    schema = "t long, anchor long, whole long, left int, right int, place long, step long, times long, weight long, salt long"
    names = [c.split()[0] for c in schema.split(", ")]

    def stretched(part, offs, rows, base):
        row, anchor, i0, i1, p = stretches(part, offs)
        view = memoryview(part)
        whole = np.array([xxhash.xxh3_64_intdigest(view[s:e], seed=o) for s, e, o in zip(i0.tolist(), (i1 + LENGTH).tolist(), (p - i0).tolist(), strict=True)], np.uint64)
        return rows[row], anchor, whole, p - i0, p - i1, p - offs[row] + base

    def run(batch, table, lo, hi):
        for a, b in tx.slices(tx.flat(batch.column(0))[1], WINDOW) if table is not None else ():
            yield from window(batch.slice(a, b - a), table, lo[a:b], hi[a:b])

    def window(batch, table, lo, hi):
        at = np.flatnonzero(hi > lo)
        ids, twice = table.column("t").to_numpy()[lo[at]], table.column("twice").to_numpy()[lo[at]]
        buf, offs = tx.flat(batch.column(0).take(pa.array(at)))
        got = []
        for a, b, stop in _pieces(offs):
            if stop is None:
                part = np.ascontiguousarray(buf[offs[a] : offs[b]])
                got.append(stretched(part, offs[a : b + 1] - offs[a], np.arange(a, b), 0))
            else:
                part = np.ascontiguousarray(buf[b:stop])
                got.append(stretched(part, np.array([0, len(part)]), np.array([a]), b - int(offs[a])))
        if not got:
            return
        row, anchor, whole, left, right, p = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(row):
            return
        # A text's equal stretches in even distances are one row.
        order = np.lexsort((p, whole, anchor, row))
        row, anchor, whole, left, right, p = (x[order] for x in (row, anchor, whole, left, right, p))
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        gap = np.diff(p, prepend=0)
        cut = fresh.copy()
        cut[1:] |= ~fresh[:-1] & (gap[1:] != gap[:-1])
        first = np.flatnonzero(cut)
        times = np.diff(np.append(first, len(row)))
        step = np.where(times > 1, gap[np.minimum(first + 1, len(row) - 1)], 0)
        row, anchor, whole, left, right, p = (x[first] for x in (row, anchor, whole, left, right, p))
        own = times * (1 + twice[row])
        by = np.argsort(anchor, kind="stable")
        start = np.flatnonzero(np.diff(anchor[by], prepend=~anchor[by[:1]]) != 0)
        known = np.add.reduceat(own[by], start)
        weight, salt = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        lead = by[start]
        weight[lead] = known
        other = np.ones(len(row), bool)
        other[lead] = False
        salt[other] = 1 + (tx.mix(whole[other] + tx.mix(ids[row[other]].view(np.uint64))) >> np.uint64(2)).astype(np.int64)
        weight[other] = 2  # its first row in the batch is known beside it
        cols = [ids[row], anchor.view(np.int64), whole.view(np.int64), left.astype(np.int32), right.astype(np.int32), p, step, times, weight, salt]
        for k in range(0, len(row), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in cols], names=names)

    return places.beside(docs, [_bytes(docs).alias("text")], folder, run, schema)


def _bytes(docs: DataFrame):
    return F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")


def _fetch(docs: DataFrame, folder: str) -> DataFrame:
    """anchor, whole, left, times and bytes of the marked stretches."""

    def run(batch, table, lo, hi):
        for a, b in tx.slices(tx.flat(batch.column(0))[1], WINDOW) if table is not None else ():
            yield from window(batch.slice(a, b - a), table, lo[a:b], hi[a:b])

    def window(batch, table, lo, hi):
        buf, offs = tx.flat(batch.column(0))
        view = memoryview(np.ascontiguousarray(buf))
        row = np.repeat(np.arange(batch.num_rows), hi - lo)
        at = np.repeat(lo, hi - lo) + np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        for k in range(0, len(row), 20_000):
            some, r = table.take(pa.array(at[k : k + 20_000])), row[k : k + 20_000]
            place, left, right = (some.column(c).to_numpy() for c in ("place", "left", "right"))
            start, stop = offs[r] + place - left, offs[r] + place - right + LENGTH
            data = pa.array([view[s:e] for s, e in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())
            cols = [*(some.column(c).combine_chunks() for c in ("anchor", "whole", "left", "times")), data]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "whole", "left", "times", "bytes"])

    return places.beside(docs, [_bytes(docs).alias("text")], folder, run, "anchor long, whole long, left int, times long, bytes binary")


def _sorted(rows: DataFrame) -> DataFrame:
    """bucket, name, near, far of strings found by suffix-sorting: how far before the anchor they start.

    rows has bucket, name, left, times, bytes, and low and high, the distances that count.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("bucket", "name", "left", "times", "bytes", "low", "high").repartition(n, "bucket").sortWithinPartitions("bucket")

    def block(held: pa.Table):
        left, times, low, high = (held[c].to_numpy().astype(np.int64) for c in ("left", "times", "low", "high"))
        data, offs = tx.flat(held["bytes"])
        owner, step = sort_block(held["bucket"].to_numpy().view(np.uint64), data, offs, left, times, low, high)
        owner, first, last = _ranges(owner, step)
        name = [held[c].to_numpy()[owner] for c in ("bucket", "name")]
        return pa.RecordBatch.from_arrays([*map(pa.array, name), pa.array(left[owner] - last), pa.array(left[owner] - first)], names=["bucket", "name", "near", "far"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(4).nbytes
            while size >= BLOCK_BYTES:
                table = pa.Table.from_batches(held)
                buckets = table["bucket"].to_numpy()
                offs = tx.flat(table["bytes"])[1]
                edges = np.flatnonzero(np.diff(buckets)) + 1  # where a bucket begins
                full = edges[offs[edges] <= BLOCK_BYTES]
                cut = full[-1] if len(full) else (edges[0] if len(edges) else 0)
                if not cut:
                    break
                yield block(table.slice(0, cut).combine_chunks())
                rest = table.slice(cut).combine_chunks()
                held, size = rest.to_batches(), int(offs[-1] - offs[cut])
            tx.trim()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield block(table.combine_chunks())

    return rows.mapInArrow(run, "bucket long, name long, near long, far long")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """rows in smaller buckets: strings of up to ``width`` neighbouring distances, by the bytes they share.

    Keeps the bucket and name of each row as they came in up and up_name; name is a hash of all bytes
    that the strings cover.
    """
    lowest = F.least(F.col("high"), F.col("left"))
    tile = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(lowest / width))).alias("tile")
    right = F.col("left") - (F.octet_length("bytes") - LENGTH)  # of the last string that the bytes hold
    each = rows.filter(F.col("low") <= lowest).select("*", right.alias("right"), tile)
    each = each.withColumn("near", F.greatest(F.col("tile") * width, "low", "right")).withColumn("far", F.least(F.col("tile") * width + width - 1, "high", "left")).filter("near <= far")
    # The bytes of all strings of the tile, whether this row has them all or not, and those they have in common.
    near, far = F.col("tile") * width, F.col("tile") * width + width - 1
    shared = F.substring("bytes", (F.col("left") - near + 1).cast("int"), (F.lit(LENGTH) - (far - near)).cast("int"))
    part = F.substring("bytes", (F.col("left") - F.col("far") + 1).cast("int"), (F.lit(LENGTH) + F.col("far") - F.col("near")).cast("int"))
    return each.select(
        F.xxhash64("bucket", "tile", shared).alias("bucket"), F.xxhash64(part, "near", "far").alias("name"), F.col("far").cast("int").alias("left"), "times",
        part.alias("bytes"), F.col("near").alias("low"), F.col("far").alias("high"), F.col("bucket").alias("up"), F.col("name").alias("up_name"),
    )


def _found(rows: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """_sorted(), after splitting buckets of too many rows."""
    crowd = files.saved(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("bucket"), "crowd")
    n = crowd.count()
    if not n or not widths:
        return _sorted(rows)
    apart = files.saved(_split(rows.join(files.few(crowd, 16, n), "bucket", "left_semi"), widths[0]), "split")
    small = apart.groupBy("bucket", "name").agg(F.sum("times").alias("times"), *[F.first(c).alias(c) for c in ("left", "bytes", "low", "high")])
    below = files.saved(_found(files.saved(small, "small"), widths[1:]), "below")
    back = apart.select("bucket", "name", "up", "up_name").join(below, ["bucket", "name"])
    back = back.select(F.col("up").alias("bucket"), F.col("up_name").alias("name"), "near", "far")
    return _sorted(rows.join(files.few(crowd, 16, n), "bucket", "left_anti")).unionByName(back)


def repeats(docs: DataFrame) -> DataFrame:
    """file, row, first, step, times, last: where repeated strings start, per row of a rooted table.

    They start from first to last, and again each step, times times in all.
    """
    key, size = F.unhex(F.md5(_bytes(docs))), F.octet_length(_bytes(docs)).cast("long")
    rows = files.saved(docs.select(*places.place(docs), key.alias("key"), size.alias("size")).filter(F.col("size") >= LENGTH), "texts")
    texts = rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.min(F.struct(places.FILE, places.ROW)).alias("one"))
    texts = files.saved(texts.select(F.monotonically_increasing_id().alias("t"), "key", "n", "size", "one.file", "one.row"), "distinct")
    marks = places.mark(texts.select("file", "row", "t", (F.col("n") > 1).cast("long").alias("twice")))
    # One shuffle brings an anchor's rows together; rows that the task itself knows to be shared are spread.
    near = Window.partitionBy("anchor", "salt")
    known = _emit(docs, marks).withColumn("known", F.sum("weight").over(near))
    shared = files.saved(known.filter("salt <> 0 or known > 1").drop("known", "weight", "salt"), "shared")
    many = texts.filter("n > 1").select("t", F.lit(True).alias("twice"))
    counted = shared.join(many.hint("merge"), "t", "left").withColumn("n", F.col("times") * F.when(F.col("twice"), 2).otherwise(1))
    kinds = counted.groupBy("anchor", "whole").agg(F.sum("n").alias("times"), F.min(F.struct("t", "place", "left", "right")).alias("one"))
    kinds = kinds.select("anchor", "whole", "times", "one.*")
    wanted = kinds.join(texts.select("t", "file", "row").hint("merge"), "t")
    fetched = _fetch(docs, places.mark(wanted.select("file", "row", "place", "left", "right", "anchor", "whole", "times"), "place"))
    stretch = fetched.select(F.col("anchor").alias("bucket"), F.col("whole").alias("name"), "left", "times", "bytes", F.lit(0).cast("long").alias("low"), F.lit(LENGTH - K).cast("long").alias("high"))
    found = files.saved(_found(files.saved(stretch, "edges")), "found")
    spans = shared.join(found.select(F.col("bucket").alias("anchor"), F.col("name").alias("whole"), "near", "far").hint("merge"), ["anchor", "whole"])
    spans = spans.select("t", (F.col("place") - F.col("far")).alias("first"), "step", "times", (F.col("place") - F.col("near")).alias("last"))
    alone = texts.filter("n = 1").select("t", "file", "row")
    copies = rows.join(texts.filter("n > 1").select("key", "size").hint("merge"), ["key", "size"])
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    copies = copies.select("file", "row", zero.alias("first"), zero.alias("step"), one.alias("times"), (F.col("size") - LENGTH).alias("last"))
    return spans.join(alone.hint("merge"), "t").select("file", "row", "first", "step", "times", "last").unionByName(copies)


def _cut(first: np.ndarray, last: np.ndarray, n: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes and runs removed, and what is kept, from first and last starts of repeated strings."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    begin, end = begin[new], end[np.append(new[1:] - 1, len(end) - 1)]
    kept = [(s, e) for s, e in zip([0, *end.tolist()], [*begin.tolist(), n], strict=True) if s < e]
    return int((end - begin).sum()), len(new), kept


def removed(docs: DataFrame) -> DataFrame:
    """One row per document: its bytes, those removed, the runs they form, and a digest of the rest."""
    docs = places.rooted(docs)
    with files.scope(docs.sparkSession):
        return files.saved(_removed(docs, places.mark(files.saved(repeats(docs), "spans"), "first", name="spans")), "removed", keep=True)


def _removed(docs: DataFrame, folder: str) -> DataFrame:
    """removed() from the marks of repeated strings."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batch, table, lo, hi):
        buf, offs = tx.flat(batch.column(1))
        view = memoryview(np.ascontiguousarray(buf))
        first, step, times, last = (table.column(c).to_numpy() for c in ("first", "step", "times", "last")) if table is not None else [None] * 4
        out: list[list] = [[], [], [], []]
        for k in range(batch.num_rows):
            n, a, b = int(offs[k + 1] - offs[k]), int(lo[k]), int(hi[k])
            gone, runs, kept = 0, 0, [(0, n)]
            if a < b:
                m = times[a:b]
                again = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                shift = again * np.repeat(step[a:b], m)
                gone, runs, kept = _cut(np.repeat(first[a:b], m) + shift, np.repeat(last[a:b], m) + shift, n)
            digest = hashlib.sha256()
            for s, e in kept:
                digest.update(view[offs[k] + s : offs[k] + e])
            for col, x in zip(out, (n, gone, runs, digest.hexdigest()), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], names=names)

    columns = [docs["doc_id"].cast("long").alias("doc_id"), _bytes(docs).alias("text")]
    return places.beside(docs, columns, folder, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
