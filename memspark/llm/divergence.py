"""How the sources of each language differ in their words, by group-block by group-block tasks.

Terms are runs of letters, A-Z lower-cased. They are counted where the texts lie, a slice at a time, and
only counts are shuffled. A language keeps the terms found in enough of its documents; they are numbered
and cut into chunks. A group, a source in a language, gives each kept term a share of a billion,
``1 + floor(1e9 * (count + 2) / (N + 2 * V))``; two shares p and q differ by ``floor((p - q)^2 / (p + q))``.

For pairs, the groups of a language are cut into blocks. The packed shares of a block go to every tile of
its row and column, so no task holds more than two blocks, and a tile gets its chunks in order: it lays one
chunk of both blocks out as two matrices and adds to its own small matrix of sums. Long vocabularies are cut
into spans of chunks, a task each, whose sums are added. Chunks that none of a tile's groups has words of
aren't sent, but counted. Shares are computed from exact decimals, differences in 64 bits, sums in 64 bits.

Cases: a null text, lang or source is an empty string. Rows are documents of their own. Each group that
occurs has its rows, also without terms; a language that keeps no term has pairs of value 0. A source alone
in its language has no pairs. Ties are ordered by item. An empty table gives an empty result; texts of any
length are read in pieces; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import files
from . import text as tx

#: Documents of a language that a kept term is in, at least, and ranks of terms of a group.
MIN_DOCS, TOP = 10, 10
#: Groups of a block, terms of a chunk, chunks of a span.
BLOCK, CHUNK, SPAN = 16, 4096, 64
#: Different (group, term) pairs that a task counts before it hands them on.
HELD = 400_000
#: Bytes of text that are split into terms together.
SLICE_BYTES = 2 << 20
#: Bytes of terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased.
LETTERS = tx.lut(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of consecutive rows, and the index of each row's first (one more at the end)."""
    low = tx.LOWER[buf]
    starts, ends, first = tx.words(low, offs, LETTERS)
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    packed = np.ascontiguousarray(low[LETTERS[low]])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(packed)).dictionary_encode(), first


def _pieces(buf: np.ndarray):
    """A long text's pieces, each ending outside terms."""
    at = 0
    while at < len(buf):
        to = min(len(buf), at + SLICE_BYTES)
        while to < len(buf):
            gap = np.flatnonzero(~LETTERS[tx.LOWER[buf[to : to + SLICE_BYTES]]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(len(buf), to + SLICE_BYTES)
        yield buf[at:to]
        at = to


class _Counter:
    """Occurrences and documents of (group, term), gathered over slices."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self._empty()

    def _empty(self) -> None:
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
        self.size, self.merged = 0, 0

    def _put(self, group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((group, terms, n, docs))
        self.size += len(group)

    def add(self, group: np.ndarray, texts: pa.Array) -> None:
        buf, offs = tx.flat(texts)
        for a, b in tx.slices(offs, SLICE_BYTES):
            part = buf[offs[a] : offs[b]]
            if b - a == 1 and len(part) > SLICE_BYTES:
                self._long(int(group[a]), part)
                continue
            coded, first = _terms(part, offs[a : b + 1] - offs[a])
            if not len(coded):
                continue
            code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            row = tx.row_of(first)
            each, n = np.unique(row * size + code, return_counts=True)  # a row for each document and term
            key, inverse = np.unique(group[a:b][each // size] * size + each % size, return_inverse=True)
            self._put(key // size, coded.dictionary.take(pa.array(key % size)), np.bincount(inverse, n, len(key)).astype(np.int64), np.bincount(inverse, minlength=len(key)))

    def _long(self, group: int, buf: np.ndarray) -> None:
        """One long text: its pieces are counted together, as it is one document."""
        whole = _Counter()
        for piece in _pieces(buf):
            coded, _ = _terms(piece, np.array([0, len(piece)]))
            if len(coded):
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                whole._put(np.zeros(len(n), np.int64), coded.dictionary, n, np.zeros(len(n), np.int64))
                if whole.size > HELD + whole.merged:
                    whole.merge()
        whole.merge()
        for _, terms, n, _ in whole.parts:
            self._put(np.full(len(n), group, np.int64), terms, n, np.ones(len(n), np.int64))

    def merge(self) -> None:
        """Equal (group, term) become one."""
        if not self.parts:
            return
        group = np.concatenate([p[0] for p in self.parts])
        coded = pa.chunked_array([p[1] for p in self.parts], pa.string()).combine_chunks()
        if isinstance(coded, pa.ChunkedArray):  # more bytes than one array holds
            coded = coded.cast(pa.large_string()).combine_chunks()
        coded = coded.dictionary_encode()
        size = max(1, len(coded.dictionary))
        key, inverse = np.unique(group * size + coded.indices.to_numpy(), return_inverse=True)
        sums = []
        for k in (2, 3):
            out = np.zeros(len(key), np.int64)
            np.add.at(out, inverse, np.concatenate([p[k] for p in self.parts]))
            sums.append(out)
        self.parts = [(key // size, coded.dictionary.take(pa.array(key % size)), *sums)]
        self.size = self.merged = len(key)

    def flush(self, names: list[tuple[str, str]]) -> pa.RecordBatch | None:
        self.merge()
        if not self.parts:
            return None
        group, terms, n, docs = self.parts[0]
        self._empty()
        told = [pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*told, terms.cast(pa.string()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: occurrences, and documents they are in; a null term tells that the group occurs."""

    def run(batches):
        counter, codes, names = _Counter(), {}, []
        for batch in batches:
            langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
            pair = np.stack([langs.indices.to_numpy(), sources.indices.to_numpy()], 1)
            known, inverse = np.unique(pair, axis=0, return_inverse=True)
            mine, fresh = [], []
            for x, y in known.tolist():
                key = (langs.dictionary[x].as_py(), sources.dictionary[y].as_py())
                if key not in codes:
                    codes[key] = len(names)
                    names.append(key)
                    fresh.append((*key, None, 0, 0))
                mine.append(codes[key])
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*fresh, strict=True), [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
            counter.add(np.array(mine, np.int64)[inverse.reshape(-1)], batch.column(2))
            if counter.size > HELD + counter.merged:
                counter.merge()
                if counter.size > HELD:
                    yield counter.flush(names)
            tx.trim()
        out = counter.flush(names)
        if out is not None:
            yield out

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    each = docs.select(*empty, F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * kept)), exact; 1 where nothing is kept."""
    top = (count + 2).cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, (total + 2 * kept).cast("decimal(19,0)"))).otherwise(F.lit(1)).cast("long")


def _differ(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most a billion and one, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Shares:
    """The shares of a table of documents: of groups and of languages, of kept terms that occur and of those that don't."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        counts = files.saved(counted(docs), "counts", keep=True)
        kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term", "n")
        numbered = files.numbered(files.saved(kept, "kept", keep=True), F.struct("lang", "term"), "number")
        langs = numbered.groupBy("lang").agg(F.min("number").alias("low"), F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
        self.langs = files.saved(langs, "langs", keep=True)
        self.terms = files.saved(numbered.join(files.few(self.langs), "lang").select("lang", "term", F.col("n").alias("lang_n"), (F.col("number") - F.col("low")).alias("slot")), "terms", keep=True)
        own = counts.filter("term is not null").select("lang", "source", "term", "n").join(files.few(self.terms), ["lang", "term"])
        self.own = files.saved(own, "own", keep=True)
        totals = self.own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # The groups of a language in order, in blocks; one row a group.
        order = Window.partitionBy("lang").orderBy("source")
        groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(self.langs.select("lang", "kept", "lang_total"), "lang", "left").fillna(0, ["total", "kept", "lang_total"])
        self.groups = files.saved(groups.withColumn("at", F.row_number().over(order) - 1).withColumn("size", F.count("*").over(Window.partitionBy("lang"))).withColumn("absent", _share(F.lit(0), F.col("total"), F.col("kept"))), "groups", keep=True)

    def occurring(self) -> DataFrame:
        """lang, source, at, size, slot, term, p and q of each kept term that a group has."""
        groups = files.few(self.groups.select("lang", "source", "at", "size", "total", "kept", "lang_total"))
        p, q = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        return self.own.join(groups, ["lang", "source"]).select("lang", "source", "at", "size", "slot", "term", p.alias("p"), q.alias("q"))


TILE = "lang string, i int, j int, a int, b int, value long"


def _tiled(df: DataFrame, block: int) -> DataFrame:
    """A row of df for each tile that its group's block is in: i, j with i <= j."""
    mine = F.floor(F.col("at") / block).cast("int")
    last = F.floor((F.col("size") - 1) / block).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
    return df.select("*", F.explode(tiles).alias("t")).select(*df.columns, "t.i", "t.j")


def _matrix(shape: tuple[int, int], absent: np.ndarray, rows: np.ndarray, slots: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.repeat(absent[:, None], shape[1], 1)
    out[rows, slots] = p
    return out


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)^2 / (p + q)), for each row p of a and q of b."""
    out = np.empty((len(a), len(b)), np.int64)
    for k, p in enumerate(a):
        d = p - b
        out[k] = (d * d // (p + b)).sum(1)
    return out


def pairs(shares: Shares, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """lang, a, b and value of each two groups of a language, a and b their places in it."""
    spark = shares.groups.sparkSession
    packed = shares.occurring().groupBy("lang", "at", "size", F.floor(F.col("slot") / chunk).cast("int").alias("chunk")).agg(
        F.collect_list((F.col("slot") % chunk).cast("int")).alias("slots"), F.collect_list("p").alias("p"),
    )
    # Each tile and span has a head for every group of its two blocks: what it gives terms that it lacks.
    spans = F.sequence(F.lit(0).cast("int"), F.greatest(F.lit(0), F.floor((F.col("kept") - 1) / (chunk * span))).cast("int"))
    heads = shares.groups.select("lang", "at", "size", "kept", "absent", F.explode(spans).alias("span"))
    none = F.array().cast("array<int>")
    heads = heads.select("lang", "at", "size", "span", F.lit(-1).alias("chunk"), none.alias("slots"), F.array("absent", "kept").alias("p"))
    body = packed.select("lang", "at", "size", F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", "slots", "p")
    both = _tiled(heads.unionByName(body), block).select("lang", "i", "j", "span", "chunk", F.col("at").cast("int").alias("at"), "slots", "p")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(n, "lang", "i", "j", "span").sortWithinPartitions("lang", "i", "j", "span", "chunk", "at")

    def run(batches):
        tile, now, held, state = None, None, [], None

        def chunk_done():
            """Add the chunk that is held to the sums."""
            _, _, rest, sums, sides, seen = state
            size = min(chunk, rest - now % span * chunk)
            filled = []
            for side in sides:
                mine = [(side[0][at], s, p) for at, s, p in held if at in side[0]]
                rows = np.concatenate([np.full(len(s), r) for r, s, _ in mine]) if mine else np.zeros(0, np.int64)
                slots, p = (np.concatenate([m[k] for m in mine]) if mine else np.zeros(0, np.int64) for k in (1, 2))
                filled.append(_matrix((len(side[1]), size), side[1], rows, slots, p))
            sums += differences(*filled)
            state[5] = seen + size

        def begin():
            """Two sides, from the heads that are held: places by group, and what absent terms get."""
            i, j, kept = tile[1], tile[2], int(held[0][2][1])
            rest = min(kept - tile[3] * chunk * span, chunk * span)
            sides = []
            for k in (i, j):
                own = [(at, int(p[0])) for at, _, p in held if at // block == k]
                sides.append(({at: r for r, (at, _) in enumerate(own)}, np.array([x for _, x in own], np.int64)))
            return [i, j, rest, np.zeros((len(sides[0][1]), len(sides[1][1])), np.int64), sides, 0]

        def tile_done():
            """The sums, with the terms of chunks that didn't come."""
            i, j, rest, sums, sides, seen = state
            if rest > seen:
                sums = sums + (rest - seen) * differences(sides[0][1][:, None], sides[1][1][:, None])
            a, b = (np.array(list(s[0]), np.int64) for s in sides)
            x, y = np.nonzero(a[:, None] < b[None, :])
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([tile[0]] * len(x), pa.string()), "i": pa.array(np.full(len(x), i, np.int32)), "j": pa.array(np.full(len(x), j, np.int32)),
                "a": pa.array(a[x].astype(np.int32)), "b": pa.array(b[y].astype(np.int32)), "value": pa.array(sums[x, y]),
            })

        def close_chunk():
            nonlocal state, held
            if now == -1:
                state = begin()
            else:
                chunk_done()
            held = []

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
            slots, shares_ = batch.column(6), batch.column(7)
            for k, (lang, i, j, part, which, at) in enumerate(keys):
                if (lang, i, j, part) != tile or which != now:
                    if tile is not None:
                        close_chunk()
                    if (lang, i, j, part) != tile:
                        if tile is not None:
                            yield tile_done()
                        tile = (lang, i, j, part)
                    now = which
                held.append((at, slots[k].values.to_numpy().astype(np.int64), shares_[k].values.to_numpy()))
        if tile is not None:
            close_chunk()
            yield tile_done()

    return ordered.mapInArrow(run, TILE).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _places(groups: DataFrame, name: str) -> DataFrame:
    """The sources of a language by their places in it."""
    return files.few(groups.select("lang", F.col("at").alias(name), F.col("source").alias(f"of_{name}")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` tells how far each other source of the
    language is, part ``term`` the terms that most set the source apart from its language, by their excess."""
    if not docs.limit(1).count():
        return docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    with files.scope(docs.sparkSession):
        shares = Shares(docs, min_docs)
        half = files.saved(pairs(shares, block, chunk, span), "pairs", keep=True)
    named = half.join(_places(shares.groups, "a"), ["lang", "a"]).join(_places(shares.groups, "b"), ["lang", "b"])
    ways = F.explode(F.array(F.struct(F.col("of_a").alias("source"), F.col("of_b").alias("item")), F.struct(F.col("of_b").alias("source"), F.col("of_a").alias("item"))))
    both = named.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    above = shares.occurring().filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    best = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(best)
