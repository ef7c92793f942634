"""Benchmark decontamination by suffix arrays over the training text.

Documents are gathered into shards of some megabytes. Of each a suffix array over all its words is
built, by ranks of words, then of runs of ranks, until they look as deep as a window. Every suffix of
every benchmark item is then binary-searched in it; the interval that it finds are the occurrences of
its first ``width`` words, and neighbouring occurrences on one diagonal join into the longest verbatim
matches with their locations. Documents with a match are removed.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
window. Words are those of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Words are
told apart by 64-bit hashes; a window of ten words only matches another by mistake if a word's hash
does: with 10^9 different words here and 10^6 there, one such pair of words exists with a chance of 5e-5.

The benchmark is cut into blocks of ``BLOCK_BYTES`` of text, written to the shared folder, some 40 bytes
a word; equal items may lie in several. A task holds one shard and one block at a time and takes all blocks
to each shard, so documents are read once whatever the benchmark's size.

Windows meet documents before items come in: which words are hit needs no items at all, and items that own
the same windows are sets with a number, of which a document notes each once. How far a match goes on is
asked of a suffix array of the block's different items, sorted to their ends, so neither many equal items
nor a text that repeats itself makes pairs of items and places.

Cases: null and empty texts have no words and are clean. Equal rows are judged row by row; rows of the
benchmark with one id count as one item, a null id as the empty string. An empty benchmark leaves all
clean; empty documents give an empty result. Extra columns are kept by ``remove``, else not looked at.
A text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import hashlib
import io
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from . import text as tx

WIDTH = 10
_BASE, _INVERSE, _ZERO = tx._BASE, tx._BASE_INV, np.zeros(1, np.uint64)
#: Items, or occurrences of items, that are laid out at once.
LAID_OUT = 2 << 20
#: Bytes of benchmark text in a block, and of documents in a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
_held: dict[str, "Index"] = {}


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each row's first."""
    buf, offs = texts if isinstance(texts, tuple) else tx.flat(texts)
    return tx.word_hashes(buf, offs, tx.ALNUM)


def _scaled(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of words, from running sums of their hashes times powers."""
    x = sums[end] - sums[start]
    if len(start):
        x = x * tx.powers(_INVERSE, len(sums))[start]
    return tx.mix(x + (end - start).astype(np.uint64))


class Index:
    """The items of a block: their words as numbers, and the suffixes that are searched."""

    def __init__(self, ids: list, texts: pa.Array, width: int = WIDTH):
        h, first = _words(texts)
        self.width = width
        self.ids = np.array(["" if x is None else str(x) for x in ids], object)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        self.number = number.astype(np.int32)
        n = np.diff(first)
        items = np.flatnonzero(n)
        length = np.minimum(n[items], width)
        count = n[items] - length + 1
        item = np.repeat(items, count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = first[:-1][item] + step
        long = np.repeat(length, count)
        rows = np.zeros((len(start), width), ">u4")
        for k in range(width):
            ok = long > k
            rows[ok, k] = number[start[ok] + k] + 1
        keys = rows.view(f"S{4 * width}").ravel() if len(rows) else np.zeros(0, f"S{4 * width}")
        #: First word and length of each different suffix; owners of suffix k are owner[bound[k]:bound[k + 1]].
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        self.start, self.length = start[at], long[at].astype(np.int64)
        order = np.argsort(back, kind="stable")
        self.owner, self.offset = item[order].astype(np.int32), step[order].astype(np.int32)
        self.bound = np.searchsorted(back[order], np.arange(len(at) + 1))
        self._sets()
        whole = h.copy()
        whole *= tx.powers(_BASE, len(h))
        self.sum = np.concatenate((_ZERO, np.cumsum(whole, dtype=np.uint64)))
        self.end = np.repeat(first[1:], n)
        self._sort(first[:-1], n)

    def _sets(self) -> None:
        """Number the different sets of items that own suffixes: suffix k is owned by set_of[k], set j by members[edge[j]:edge[j + 1]]."""
        suffix = np.repeat(np.arange(len(self.start)), np.diff(self.bound))
        one = np.ones(len(suffix), bool)  # an item owns a suffix once, wherever it has it; owners are in order
        one[1:] = (suffix[1:] != suffix[:-1]) | (self.owner[1:] != self.owner[:-1])
        suffix, owner = suffix[one], self.owner[one]
        size = np.bincount(suffix, minlength=len(self.start))
        begin = np.concatenate(([0], np.cumsum(size)))
        name = np.concatenate((_ZERO, np.cumsum(tx.mix(owner.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)))
        name = tx.mix(name[begin[1:]] - name[begin[:-1]]) + size.astype(np.uint64)
        _, one, self.set_of = np.unique(name, return_index=True, return_inverse=True)
        n = size[one]
        self.edge = np.concatenate(([0], np.cumsum(n)))
        self.members = owner[np.repeat(begin[one], n) + np.arange(n.sum()) - np.repeat(self.edge[:-1], n)]

    def _sort(self, begin: np.ndarray, n: np.ndarray) -> None:
        """The suffix array of the different items that have a window's words, sorted to the items' ends."""
        name = self._name(begin, begin + n)
        _, one = np.unique(name, return_index=True)
        one = one[n[one] >= self.width]
        n, begin = n[one], begin[one]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        line = np.zeros(len(at) + len(one), np.int64)
        place = np.arange(len(at)) + np.repeat(np.arange(len(one)), n)
        line[place] = self.number[at] + 1
        rank, depth, most = line.astype(np.uint64), 1, int(n.max()) if len(n) else 0
        while depth <= most:
            both = rank << np.uint64(32)
            both[: max(0, len(rank) - depth)] |= rank[depth:]
            order = np.argsort(both, kind="stable")
            both = both[order]
            new = np.ones(len(both), bool)
            new[:1], new[1:] = False, both[1:] != both[:-1]
            rank[order] = np.cumsum(new)
            depth *= 2
        back = np.full(len(line), -1, np.int64)
        back[place] = at
        order = np.argsort(rank, kind="stable")
        #: Words of the block at which suffixes begin, in their order.
        self.array = back[order][back[order] >= 0]

    def _name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scaled(self.sum, start, end)

    def reach(self, h: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """From words h[at] on, up to end, the most words that some item of the block has in a row."""
        if not len(self.array) or not len(at):
            return np.zeros(len(at), np.int64)
        sums = h.copy()
        sums *= tx.powers(_BASE, len(h))
        sums = np.concatenate((_ZERO, np.cumsum(sums, dtype=np.uint64)))

        def shared(suffix: np.ndarray) -> np.ndarray:
            lo, hi = np.zeros(len(at), np.int64), np.minimum(end - at, self.end[suffix] - suffix)
            while (lo < hi).any():
                mid = (lo + hi + 1) >> 1
                same = _scaled(sums, at, at + mid) == self._name(suffix, suffix + mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            return lo

        best = np.zeros(len(at), np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.array))
        padded = np.append(h, np.uint64(0))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, len(self.array) - 1)
            suffix = self.array[mid]
            n = shared(suffix)
            open_ = lo < hi
            best = np.where(open_, np.maximum(best, n), best)  # the nearest suffixes are among those it meets
            # The vocabulary is in the order of hashes, and what ends comes first.
            mine, its = at + n < end, suffix + n < self.end[suffix]
            word = self.vocabulary[self.number[np.minimum(suffix + n, len(self.number) - 1)]]
            after = mine & (~its | (padded[np.minimum(at + n, len(h))] > word))
            lo, hi = np.where(open_ & after, mid + 1, lo), np.where(open_ & ~after, mid, hi)
        return best

    def search(self, shard: "Shard") -> tuple[np.ndarray, np.ndarray]:
        """(word, suffix) for each occurrence of a suffix of the block in the shard."""
        none = np.zeros(0, np.int64)
        if not len(shard.array) or not len(self.start):
            return none, none
        near = np.minimum(np.searchsorted(shard.vocabulary, self.vocabulary), len(shard.vocabulary) - 1)
        there = shard.vocabulary[near] == self.vocabulary
        query = np.where(there, near + 1, 0).astype(np.int32)[self.number]
        # A suffix with a word that the shard hasn't can't occur in it.
        absent = np.zeros(len(query) + 1, np.int64)
        np.cumsum(query == 0, out=absent[1:])
        asked = np.flatnonzero(absent[self.start + self.length] == absent[self.start])
        if not len(asked):
            return none, none
        lo = shard.bound(query, self.start[asked], self.length[asked], False)
        hi = shard.bound(query, self.start[asked], self.length[asked], True)
        n = hi - lo
        where = shard.array[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return shard.word[where].astype(np.int64), np.repeat(asked, n)

    def groups(self, where: np.ndarray, key: np.ndarray, row: np.ndarray):
        """(where, key, first item, item past the last) of groups of rows and items that are laid out together."""
        n = self.bound[key + 1] - self.bound[key]
        cut = np.cumsum(np.bincount(row[where], n, int(row[where].max()) + 1)) // LAID_OUT if len(where) else np.zeros(0)
        for g in np.unique(cut[row[where]]):
            mine = cut[row[where]] == g
            parts = max(1, -(-int(n[mine].sum()) // LAID_OUT))
            step = max(1, -(-len(self.ids) // parts))
            for at in range(0, len(self.ids), step):
                yield where[mine], key[mine], at, at + step

    def matches(self, where: np.ndarray, key: np.ndarray, row: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        """Longest verbatim matches with items from low up to high: row, item, first word, offset in the item, words."""
        # Owners of a suffix are in order, so those of a range are a range.
        name = np.repeat(np.arange(len(self.start)), np.diff(self.bound)) * np.int64(len(self.ids)) + self.owner
        begin = np.searchsorted(name, key * np.int64(len(self.ids)) + low)
        n = np.searchsorted(name, key * np.int64(len(self.ids)) + min(high, len(self.ids))) - begin
        own = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word, item, off = np.repeat(where, n), self.owner[own].astype(np.int64), self.offset[own].astype(np.int64)
        long = np.repeat(self.length[key], n)
        order = np.lexsort((word, word - off, item, row[word]))
        word, item, off, long = word[order], item[order], off[order], long[order]
        new = np.ones(len(word), bool)
        new[1:] = (row[word[1:]] != row[word[:-1]]) | (item[1:] != item[:-1]) | (np.diff(word - off) != 0) | (np.diff(word) != 1)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(word)) - 1
        return [row[word[start]], item[start], word[start], off[start], word[last] - word[start] + long[last]] if len(word) else [np.zeros(0, np.int64)] * 5


class Shard:
    """The words of some documents and their suffix array, sorted as deep as a window."""

    def __init__(self, h: np.ndarray, first: np.ndarray, width: int = WIDTH):
        rows = len(first) - 1
        self.vocabulary, number = np.unique(h, return_inverse=True)
        #: Word numbers from 1, with a 0 after each row that ends its suffixes.
        self.line = np.zeros(len(h) + rows + width, np.int32)
        place = np.arange(len(h)) + tx.row_of(first)
        self.line[place] = number + 1
        self.word = np.full(len(self.line), -1, np.int32)
        self.word[place] = np.arange(len(h))
        del number, place
        # As many neighbouring ranks as fit 64 bits make the next ranks, which look at so many times the words.
        rank, depth, order = self.line.astype(np.uint64), 1, np.zeros(0, np.int64)
        while depth < width or not len(order):
            bits = max(1, int(rank.max()).bit_length()) if len(rank) else 1
            many = max(2, min(64 // bits, -(-width // depth)))
            both = rank.copy()
            for k in range(1, many):
                both <<= np.uint64(bits)
                both[: len(rank) - k * depth] |= rank[k * depth :]
            order = np.argsort(both)
            both = both[order]
            new = np.ones(len(both), bool)
            new[:1], new[1:] = False, both[1:] != both[:-1]
            rank[order] = np.cumsum(new)
            depth *= many
        del rank, both, new
        self.array = order[self.line[order] > 0].astype(np.int32)
        count = np.bincount(self.line[self.array], minlength=len(self.vocabulary) + 2)
        #: Suffixes that begin with a word are array[begin[word]:begin[word + 1]].
        self.begin = np.concatenate(([0], np.cumsum(count)))

    def bound(self, query: np.ndarray, start: np.ndarray, length: np.ndarray, past: bool) -> np.ndarray:
        """Where in the array the suffixes that begin with query[start : start + length] begin, or end."""
        lo, hi = self.begin[query[start]].copy(), self.begin[query[start] + 1].copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            suffix, s, n = self.array[mid].astype(np.int64), start[open_], length[open_]
            less = np.full(len(open_), past)  # what begins with the query is less than the end
            tied = np.arange(len(open_))
            for k in range(1, int(n.max())):
                tied = tied[n[tied] > k]
                x, y = self.line[suffix[tied] + k], query[s[tied] + k]
                less[tied[x < y]], less[tied[x > y]] = True, False
                tied = tied[x == y]
                if not len(tied):
                    break
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]


def blocks(benchmark: DataFrame, width: int = WIDTH):
    """The benchmark's indexes, one for each block of a checked size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.distinct()  # an item twice is one item
    total = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = part.toArrow()
        yield Index(got["item_id"].to_pylist(), got["text"], width)


def _placed(benchmark: DataFrame, width: int) -> list[str]:
    """The blocks, written to the shared folder."""
    folder, paths = files.folder(benchmark.sparkSession, "benchmark"), []
    for k, index in enumerate(blocks(benchmark, width)):
        paths.append(f"{folder}/{k:06d}.block")
        with files.placed(paths[-1]) as out:
            out.write(pickle.dumps(index, protocol=5))
    return paths


def _block(path: str, alone: bool) -> Index:
    if path not in _held:
        with files.opened(path) as f:
            index = pickle.load(io.BytesIO(f.read()))
        if not alone:
            return index
        _held.clear()  # a benchmark of one block stays in the worker
        _held[path] = index
    return _held[path]


def _shards(batches, column: int):
    """Slices of batches of about SHARD_BYTES of text."""
    for batch in batches:
        buf, offs = tx.flat(batch.column(column))
        for a, b in tx.slices(offs, SHARD_BYTES):
            yield batch.slice(a, b - a), buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        tx.trim()


def _hits(paths: list[str], width: int, buf, offs):
    """Block by block: hashes of words, each row's first, the words hit so far, and (index, row of each word, suffix, word) of occurrences."""
    h, first = _words((buf, offs))
    shard, row = Shard(h, first, width), tx.row_of(first)
    hit = np.zeros(len(h), bool)
    for path in paths:
        index = _block(path, len(paths) == 1)
        where, key = index.search(shard)
        if len(where):
            hit |= tx.covered(where, index.length[key], len(h))
        yield h, first, hit, (index, row, key, where)


def _judge(paths: list[str], width: int, buf, offs):
    """Words of each row, whether each is hit, each row's first, and words and place of its longest match; and by block the sets of items found, as (row, set)."""
    rows = len(offs) - 1
    longest, at, sets = np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
    for h, first, hit, told in _hits(paths, width, buf, offs):
        index, row, key, where = told
        if not len(where):
            sets.append(None)
            continue
        pairs = np.unique(row[where] * np.int64(len(index.edge)) + index.set_of[key])
        sets.append((pairs // len(index.edge), pairs % len(index.edge)))
        n = index.length[key]
        full = n == width
        n[full] = index.reach(h, where[full], first[row[where[full]] + 1])
        r, w = row[where], where
        order = np.lexsort((w, -n, r))
        best = order[np.flatnonzero(np.diff(r[order], prepend=-1))]  # of each row the longest, then the first
        r, w, n = r[best], w[best] - first[r[best]], n[best]
        better = (n > longest[r]) | ((n == longest[r]) & (w < at[r]))
        longest[r[better]], at[r[better]] = n[better], w[better]
    return np.diff(first), hit, first, sets, longest, at


def _found(paths: list[str], sets: list, rows: int) -> tuple[np.ndarray, list[str]]:
    """Of each row the number of items found, and the digest of their ids; a few rows' ids are laid out at a time."""
    none = hashlib.sha256(b"").hexdigest()
    count, digest, seen = np.zeros(rows, np.int64), [none] * rows, {}
    touched = np.unique(np.concatenate([s[0] for s in sets if s is not None])) if any(s is not None for s in sets) else []
    for r in touched:
        mine = []
        for k, s in enumerate(sets):
            if s is not None:
                lo, hi = np.searchsorted(s[0], r, "left"), np.searchsorted(s[0], r, "right")
                if hi > lo:
                    mine.append((k, tuple(s[1][lo:hi].tolist())))
        mine = tuple(mine)
        if mine not in seen:  # many rows have the same
            ids: set[str] = set()
            for k, own in mine:
                index = _block(paths[k], len(paths) == 1)
                there = np.zeros(len(index.ids), bool)
                for j in own:
                    there[index.members[index.edge[j] : index.edge[j + 1]]] = True
                ids.update(index.ids[there].tolist())
            seen = {} if len(seen) > 1000 else seen
            seen[mine] = len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        count[r], digest[r] = seen[mine]
    return count, digest


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long"


def score(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: its words, those that are hit, the items found, and the longest match.

    longest is in words, and longest_at the number of its first word, from 0; null without a match.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    paths = _placed(benchmark, width)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(SCHEMA.split(", "), kinds, strict=True)])

    def run(batches):
        for part, buf, offs in _shards(batches, 1):
            n, hit, first, sets, longest, at = _judge(paths, width, buf, offs)
            n_hit = tx.per_row(hit, first)
            cols = [n, n_hit, *_found(paths, sets, len(n)), n_hit > 0, longest]
            cols = [part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=False)], pa.array(at, pa.int64(), mask=longest == 0)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(run, SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The longest verbatim matches: doc_id, item_id, first word in either, and number of words."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    paths = _placed(benchmark, width)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        for part, buf, offs in _shards(batches, 1):
            h, first = _words((buf, offs))
            shard, row = Shard(h, first, width), tx.row_of(first)
            for path in paths:
                index = _block(path, len(paths) == 1)
                for where, key, low, high in index.groups(*index.search(shard), row):
                    r, i, w, o, n = index.matches(where, key, row, low, high)
                    cols = [part.column(0).take(pa.array(r)), pa.array(index.ids[i], pa.string()), pa.array(w - first[r]), pa.array(o), pa.array(n)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, item_id string, doc_word long, item_word long, n_words long")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without a hit word, with the columns they came with."""
    text, paths = docs.columns.index("text"), _placed(benchmark, width)

    def run(batches):
        for part, buf, offs in _shards(batches, text):
            for _, first, hit, _ in _hits(paths, width, buf, offs):  # no more than which words are hit
                pass
            yield part.filter(pa.array(tx.per_row(hit, first) == 0))

    return docs.mapInArrow(run, docs.schema)
