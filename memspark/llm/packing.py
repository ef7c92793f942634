"""Sequences of a fixed width, by concatenating all documents and cutting.

``tokenise`` turns each document into ids, in the order of the scan, with its place in its partition's
stream. The partitions' totals, summed in order, give every document a global place. ``sequences`` streams
each partition again and cuts it at the multiples of the width: windows that lie inside a partition are
whole, the one at either end is a boundary record, and only boundary records are shuffled and stitched.
So nothing but the last sequence needs padding, and no task sees more than its partition.

A byte-level BPE whose merges are in the order of their ids is the same vocabulary to a faster library, which
encodes texts of the plain Latin letters and signs that both tell apart alike; all else goes to the
tokenizer itself. Long texts are cut before a space between two ASCII letters, where no token can lie across.

Cases: a null or empty text is the end id alone. Rows are documents of their own, also those that share a
doc_id or have none. A text of any length may fill many sequences; its ids are one row, encoded piece by
piece. An empty table has no sequences. Extra columns are not looked at.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from . import text as tx

#: Tokens of a sequence, and the id that ends a document.
WIDTH, END = 1024, 0
#: Bytes of a text that are encoded together.
SLICE_BYTES = 1 << 20
_LETTER = tx.lut(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
PIECE = "doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint"
TOKENS = "part int, at long, doc_id long, n long, ids binary"
FRAGMENTS = f"sequence_id long, first int, ids binary, pieces array<struct<{PIECE}>>"
#: Bytes that may stand in texts for the faster library: printable ASCII, tab, line ends, and U+00A0 to U+027F.
_PLAIN = tx.lut(lambda b: 0x20 <= b <= 0x7E or b in (9, 10, 13) or 0x80 <= b <= 0xBF or 0xC2 <= b <= 0xC9)
# Fixed value: the pattern that a byte-level pre-tokeniser cuts texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[int, Encoder] = {}


def vocabulary() -> str:
    """The path of the vocabulary that is used unless another is named."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else the next free one from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(told: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes and ranks, or None where ids don't tell the order of merges or texts are changed first."""
    model, pre = told.get("model") or {}, told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or told.get("normalizer") or told.get("truncation") or model.get("dropout") or model.get("ignore_merges"):
        return None
    letters, vocab = _bytes_of(), model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or any(c not in vocab for c in letters) or max(vocab[c] for c in letters) > made[0]:
        return None
    known = {*made, *(vocab[c] for c in letters)}
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if i in known}


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places before which a text may be cut without changing its ids."""
    if len(buf) < 3:
        return np.zeros(0, np.int64)
    letter = _LETTER[buf]
    return np.flatnonzero((buf[1:-1] == 0x20) & letter[:-2] & letter[2:]) + 1


class Encoder:
    """Ids of texts, as the tokenizer of a vocabulary gives them."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        told = json.loads(vocabulary)
        self.tokenizer, ranks = Tokenizer.from_str(vocabulary), _ranks(told)
        self.special = [x["content"].encode() for x in told.get("added_tokens") or []]
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def ids(self, buf: np.ndarray) -> np.ndarray:
        """Ids of one text."""
        if len(buf) <= SLICE_BYTES:
            return self._piece(buf)
        return np.concatenate([self._piece(buf[a:b]) for a, b in pieces_of(buf)])

    def _piece(self, buf: np.ndarray) -> np.ndarray:
        data = buf.tobytes()
        # U+0080 to U+009F are control characters.
        plain = self.fast and _PLAIN[buf].all() and not ((buf[1:] < 0xA0) & (buf[:-1] == 0xC2)).any() and not any(x in data for x in self.special)
        if plain:
            return self.fast.encode_to_numpy(data.decode(), disallowed_special=())
        return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, np.uint32)


def pieces_of(buf: np.ndarray):
    """(first, past the last) bytes of a long text's pieces, each up to the first cut past a slice."""
    at = 0
    while at < len(buf):
        to, low = len(buf), at + SLICE_BYTES
        while low < len(buf):
            found = cuts(buf[low : low + SLICE_BYTES + 2])
            if len(found):
                to = low + int(found[0])
                break
            low += SLICE_BYTES
        yield at, to
        at = to


def tokenise(docs: DataFrame, path: str | None = None) -> DataFrame:
    """part, at, doc_id, n and ids (little-endian, 32 bits) of every document; at is its place in its part.

    The vocabulary is read here and sent along; it is a file of fixed size.
    """
    with open(path or vocabulary(), encoding="utf-8") as f:
        told = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        key, part, at = hash(told.value), TaskContext.get().partitionId(), 0
        if key not in _encoders:
            _encoders[key] = Encoder(told.value)
        encode, last = _encoders[key].ids, np.array([END], np.uint32)
        for batch in batches:
            buf, offs = tx.flat(batch.column(1))
            for a, b in tx.slices(offs, SLICE_BYTES):
                each = [x for k in range(a, b) for x in (encode(buf[offs[k] : offs[k + 1]]), last)]
                n = np.array([len(x) + 1 for x in each[::2]], np.int64)
                ends = np.cumsum(n)
                bounds = np.concatenate(([0], ends * 4)).astype(np.int64)
                data = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(np.concatenate(each).astype("<u4"))])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(b - a, part, np.int32)), "at": pa.array(at + ends - n), "doc_id": batch.column(0).slice(a, b - a), "n": pa.array(n), "ids": data.cast(pa.binary()),
                })
                at += int(ends[-1])
            tx.trim()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, TOKENS)


def placed(tokens: DataFrame) -> DataFrame:
    """A saved table of tokenise() with g, each document's place in the concatenation of all."""
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return tokens.join(files.few(base, 16), "part").select((F.col("base") + F.col("at")).alias("g"), "doc_id", "n", "ids")


class _Cutter:
    """Consecutive documents of a stream, cut at the multiples of the width."""

    def __init__(self, width: int):
        self.width, self.next, self.rows = width, None, []
        self._open(0)

    def _open(self, g: int) -> None:
        self.first, self.sequence = g % self.width, g // self.width
        self.ids, self.pieces, self.size = [], [], 0

    def close(self) -> None:
        """Hand on what is open."""
        if self.size:
            self.rows.append((self.sequence, self.first, b"".join(self.ids), self.pieces))
            self.ids, self.pieces, self.size = [], [], 0

    def add(self, g: int, doc_id, n: int, ids: bytes) -> None:
        if g != self.next:
            self.close()
            self._open(g)
        self.next, start = g + n, 0
        while start < n:
            room = self.width - self.first - self.size
            take = min(room, n - start)
            self.ids.append(ids[4 * start : 4 * (start + take)])
            self.pieces.append({"doc_id": doc_id, "start": start, "length": take, "doc_tokens": n, "offset": self.first + self.size})
            self.size, start = self.size + take, start + take
            if take == room:
                self.close()
                self._open(g + start)

    def batch(self) -> pa.RecordBatch:
        seq, first, ids, pieces = zip(*self.rows, strict=True)
        self.rows = []
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("doc_id", "start", "length", "doc_tokens", "offset")]))
        return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(first, pa.int32()), pa.array(ids, pa.binary()), pa.array(pieces, kind)], names=["sequence_id", "first", "ids", "pieces"])


def fragments(tokens: DataFrame, width: int = WIDTH) -> DataFrame:
    """Windows of each partition's stream: whole ones, and boundary records where it begins or ends inside one."""

    def run(batches):
        cutter = _Cutter(width)
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for g, doc_id, n, ids in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3], strict=True):
                cutter.add(g, doc_id, n, ids.as_buffer().to_pybytes())
                if len(cutter.rows) >= 1000:
                    yield cutter.batch()
        cutter.close()
        if cutter.rows:
            yield cutter.batch()

    return placed(tokens).mapInArrow(run, FRAGMENTS)


def sequences(docs: DataFrame, width: int = WIDTH, path: str | None = None) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian, 32 bits) and pieces of every sequence.

    All but the last have the full width. A piece tells doc_id, start (ids of its document before it),
    length, doc_tokens and its offset in the sequence.
    """
    if width < 1:
        raise ValueError("a sequence holds one token or more")
    spark = docs.sparkSession
    with files.scope(spark):
        tokens = files.saved(tokenise(docs, path), "tokens")
        cut = files.saved(fragments(tokens, width), "fragments", keep=True)
    whole = (F.col("first") == 0) & (F.octet_length("ids") == 4 * width)
    ordered = F.array_sort(F.collect_list(F.struct("first", "ids", "pieces")))
    stitched = cut.filter(~whole).groupBy("sequence_id").agg(ordered.alias("f")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("f.ids", F.hex), "")).alias("ids"), F.flatten("f.pieces").alias("pieces"),
    )
    both = cut.filter(whole).select("sequence_id", "ids", "pieces").unionByName(stitched)
    return both.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "pieces")


def pieces(docs: DataFrame, width: int = WIDTH, path: str | None = None) -> DataFrame:
    """A row for each piece of a document in a sequence, with the checksum of its ids there."""
    each = sequences(docs, width, path).select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    return each.select("p.doc_id", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
