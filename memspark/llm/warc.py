"""WARC archives: writing them, and normalising monolithic gzip streams.

``write`` makes archives of which each is one gzip stream over all its records, as Spark's text writer
compresses them. ``normalise`` inflates each stream once, rewrites every record as a gzip member of its
own, and writes a sidecar index of member offsets beside the archive. ``read`` goes through the index
and inflates each record by itself.

Pages of equal payload are stored once: the largest page_id has the response record, the others are
revisit records that name it. Payloads under ``min_bytes`` are always stored. Digests are ``sha1:`` and base32.

Cases: a null html is an empty payload; a null url becomes a URN, and white space and controls of a url
are percent-encoded. Rows that repeat the largest page_id are all responses; a row without page_id
revisits one that has it, and is a response where none has. Equal rows get equal records. Extra columns
are not looked at. An empty table makes no archive and gives an empty result. Archives are read in
pieces, and records of any length are held one at a time; archives hold ``RECORDS`` at most.

Archives are files in the shared folder, written under a temporary name and moved into place, so a task
that runs twice leaves the same files. Python opens them through Arrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Records of an archive.
RECORDS = 2000
LEVEL = 5
_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SUFFIX = ".idx.jsonl"


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed):
    """A SHA-1 in hexadecimal as base32: five digits hold four of its characters."""
    quanta = [F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substring(F.lit(_ALPHABET), F.shiftright(q, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for q in quanta for j in range(4)])


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One text record per page, without its closing blank lines."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    equal = pages.groupBy("sha1", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("kept_id")).filter((F.col("n") > 1) & F.col("kept_id").isNotNull() & (F.col("size") >= min_bytes))
    equal = equal.select(F.col("sha1").alias("same"), "kept_id")
    equal = files.saved(equal, "equal")
    pages = pages.join(files.few(equal, 72), F.col("sha1") == F.col("same"), "left")
    revisit = F.col("kept_id").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    uri = F.coalesce(F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20"), name)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(_END))
    line = lambda key, *value: F.concat(F.lit(f"{key}: "), *value, F.lit("\r\n"))
    body = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.lit("<"), name, F.lit(">")), line("WARC-Target-URI", uri), F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.lit("sha1:"), base32(F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.lit("<urn:x-page:"), F.col("kept_id"), F.lit(">")), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", body), F.lit("\r\n"), http,
    )
    return pages.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives of pages, each one gzip stream."""
    out = records(pages, min_bytes).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.option("lineSep", _END).option("maxRecordsPerFile", RECORDS).text(path)


class Stream:
    """Records of an inflated stream, of which no more than one is held at a time."""

    def __init__(self, chunks):
        self.chunks, self.held = iter(chunks), bytearray()

    def _fill(self) -> bool:
        more = next(self.chunks, None)
        if more is None:
            return False
        self.held += more
        return True

    def __iter__(self):
        at = 0
        while True:
            end = self.held.find(b"\r\n\r\n", at)
            while end < 0:
                before = max(at, len(self.held) - 3)
                if not self._fill():
                    if bytes(self.held[at:]).strip():
                        raise ValueError("a record's header is cut off")
                    return
                end = self.held.find(b"\r\n\r\n", before)
            head = bytes(self.held[at:end]).decode()
            if not head.startswith("WARC/"):
                raise ValueError("no WARC record where one should begin")
            fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
            stop = end + 4 + int(fields["Content-Length"]) + 4
            while len(self.held) < stop:
                if not self._fill():
                    raise ValueError("a record is cut off")
            yield fields, bytes(self.held[at:stop]), bytes(self.held[end + 4 : stop - 4])
            at = stop
            if at > 1 << 20:
                del self.held[:at]
                at = 0


def pieces(data, size: int = 1 << 18):
    """Bytes, or what a file still has, piece by piece."""
    if isinstance(data, bytes):
        view = memoryview(data)
        yield from (view[k : k + size] for k in range(0, len(view), size))
        return
    while piece := data.read(size):
        yield piece


def inflate(data, size: int = 1 << 18):
    """The stream inside gzip data, bytes or a file, of one member or more, piece by piece."""
    z, fresh = zlib.decompressobj(31), True
    for rest in pieces(data, size):
        while rest:
            out, fresh = z.decompress(rest, size), False
            if out:
                yield out
            rest = z.unconsumed_tail
            if z.eof:
                rest, z, fresh = z.unused_data, zlib.decompressobj(31), True
    while not fresh and (out := z.decompress(z.unconsumed_tail, size)):
        yield out
    if not fresh and not z.eof:
        raise ValueError("a gzip stream is cut off")


def member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive of a folder record by record; archive, records, bytes of each.

    Lazy: the archives are written when the result is evaluated.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # contents are read by the tasks
    found = found.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
                offset, count = 0, 0
                with files.opened(path) as data, files.placed(f"{target}/{name}") as out, files.placed(f"{target}/{name}{INDEX_SUFFIX}") as index:
                    for fields, record, _ in Stream(inflate(data)):
                        packed = member(record)
                        out.write(packed)
                        index.write((json.dumps({"offset": offset, "length": len(packed), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"]}) + "\n").encode())
                        offset, count = offset + len(packed), count + 1
                yield pa.RecordBatch.from_pydict({"archive": [f"{target}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([offset], pa.int64())})

    return found.mapInArrow(run, "archive string, records long, bytes long")


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives, each read by its index entry."""

    def number(uri: str | None):
        last = uri.strip("<>").rsplit(":", 1)[-1] if uri else "none"
        return None if last == "none" else int(last)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.opened(path) as data, files.opened(path + INDEX_SUFFIX) as index:
                    for line in index.read().decode().splitlines():
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        fields, _, block = next(iter(Stream(inflate(data.read(entry["length"])))))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                        size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                        rows.append((number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of pages, normalise them, and read the records back."""
    spark = pages.sparkSession
    raw = files.folder(spark, "warc-raw")
    write(pages, raw, min_bytes)
    archives = files.saved(normalise(spark, raw, files.folder(spark, "warc")), "archives")
    files.remove(spark, raw)
    n = max(1, archives.count())
    return read(archives.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)))
