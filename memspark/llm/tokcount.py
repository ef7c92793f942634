"""Token counts by a separator scan over flat token files.

``write`` tokenises documents into flat files of unsigned integers, each document followed by the
end-of-document identifier, with no index. ``scan`` reads such files in blocks, finds the separators of
a block in one vectorised comparison, and stitches documents that cross block bounds with a prefix scan
over the blocks' counts and last separators. ``count`` ties the lengths to the documents again through
the order in which they were written.

Cases: null and empty texts have no tokens but a separator; equal rows are documents of their own; a
null doc_id stays null. A file without a separator, or with tokens after its last, ends in an open
document, reported with ``closed`` false. An empty table writes nothing and gives an empty result; very
long texts may cross many blocks. Extra columns are not looked at. A text can't hold the separator, as
text is tokenised as ordinary text. Files are written under a temporary name and moved into place, and
named after the attempt that wrote them: a task that runs twice leaves a file that no row names, and only
files that rows name are scanned.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from . import text as tx

#: Merge ranks of a byte-level BPE, a line of base64 and rank each, and its free id for the separator.
VOCABULARY, SEPARATOR = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
# Fixed value: the pattern that this vocabulary's texts are cut by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KIND = "<u2"
#: Tokens of a file, and of a block.
FILE_TOKENS, BLOCK_TOKENS = 32 << 20, 1 << 20
_encoders: dict[int, object] = {}


def _encoder(ranks: bytes):
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """file, ordinal, doc_id of every document, in the order the files hold them.

    Lazy: the files are written when the result is evaluated. The vocabulary is read here and sent
    along; it is a file of fixed size.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = _encoder(ranks.value).encode_ordinary
        context, k, at = TaskContext.get(), 0, 0
        part, attempt = context.partitionId(), context.taskAttemptId()
        name, now, out = None, None, None
        try:
            for batch in batches:
                texts = batch.column(1)
                names, ordinals = [], []
                for i in range(batch.num_rows):
                    if out is None:
                        name, at = f"part-{part:06d}-{k:04d}-{attempt}.bin", 0
                        now = files.placed(f"{path}/{name}")
                        out = now.__enter__()
                    tokens = np.array(encode(texts[i].as_py() or ""), KIND)
                    out.write(tokens.tobytes())
                    out.write(np.array([SEPARATOR], KIND).tobytes())
                    names.append(name)
                    ordinals.append(at)
                    at += 1
                    if out.tell() >= FILE_TOKENS * np.dtype(KIND).itemsize:
                        now.__exit__(None, None, None)
                        out, k = None, k + 1
                yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "ordinal": pa.array(ordinals, pa.int64()), "doc_id": batch.column(0)})
            if out is not None:
                now.__exit__(None, None, None)
                out = None
        except BaseException as e:
            if out is not None:  # a part of a file is no file
                now.__exit__(type(e), e, e.__traceback__)
            raise

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "file string, ordinal long, doc_id long")


def separators(tokens: np.ndarray, separator: int = SEPARATOR) -> tuple[np.ndarray, int]:
    """Lengths of the documents that end in a block, the first as far as the block has it, and the rest."""
    at = np.flatnonzero(tokens == separator)
    lengths = np.diff(at, prepend=-1) - 1
    return lengths, len(tokens) - (int(at[-1]) + 1 if len(at) else 0)


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = 0, only: DataFrame | None = None) -> DataFrame:
    """file, ordinal, n_tokens, closed of every document in the flat files of a folder, or ``only`` in those named."""
    block = block or BLOCK_TOKENS
    width = np.dtype(KIND).itemsize
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", (F.col("length") / width).cast("long").alias("size"))
    if only is not None:
        found = found.withColumn("file", F.regexp_extract("path", r"[^/]+$", 0)).join(only.select("file").distinct(), "file", "left_semi")
    parts = found.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("begin"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(max(n, spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with files.opened(row["path"]) as f:
                    f.seek(row["begin"] * width)
                    tokens = np.frombuffer(f.read(min(block, row["size"] - row["begin"]) * width), KIND)
                lengths, rest = separators(tokens, separator)
                yield pa.RecordBatch.from_pydict({
                    "file": [row["path"].rsplit("/", 1)[-1]], "begin": pa.array([row["begin"]], pa.int64()), "ends": pa.array([len(lengths)], pa.int64()),
                    "rest": pa.array([rest], pa.int64()), "tokens": pa.array([len(tokens)], pa.int64()), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())),
                })

    blocks = files.saved(parts.mapInArrow(run, "file string, begin long, ends long, rest long, tokens long, lengths array<long>"), "blocks")
    order = Window.partitionBy("file").orderBy("begin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Where the document that is open at a block's begin began: after the last separator before it.
    after_last = F.when(F.col("ends") > 0, F.col("begin") + F.col("tokens") - F.col("rest"))
    bounds = blocks.select("file", "begin", "ends", "rest", "tokens").withColumn("after_last", after_last)
    opened = F.coalesce(F.max("after_last").over(before), F.lit(0))
    bounds = bounds.withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("carry", F.col("begin") - opened).withColumn("final", F.lead("begin").over(order).isNull())
    each = blocks.join(bounds.select("file", "begin", "base", "carry"), ["file", "begin"]).select("file", "base", "carry", F.posexplode("lengths").alias("k", "length"))
    closed = each.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    # A block without separators is all rest, on top of what was open at its begin.
    left = F.col("rest") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)
    ends = bounds.filter("final").select("file", (F.col("base") + F.col("ends")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(ends.filter("n_tokens > 0"))


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every document, by writing flat files and scanning them."""
    spark = docs.sparkSession
    path = files.folder(spark, "tokens")
    order = files.saved(write(docs, path, vocabulary), "token-order")
    if not order.limit(1).count():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    return order.join(scan(spark, path, only=order), ["file", "ordinal"]).select("doc_id", "n_tokens")
