"""Versioned snapshots of the relations, and bundles for exchange.

A version is a small folder that tells, of each table, the files that hold it: a base, and deltas on top,
rows that are new or changed and keys that are gone. A verb writes its delta and the next version; what it
leaves alone is referred to. A version is published by one rename that fails if it exists, and on a stated
version before it: who has read an older one is told by ``Conflict`` and does its work again on the newer
one, so no update is lost. Readers see a version whole, whatever is written meanwhile.

Where a table has ``MAX_DELTAS`` of them, the next commit folds them into one, or into the base once they
hold a good part of its rows; so a reader merges few files, and a row is rewritten few times.
"""

from __future__ import annotations

import dataclasses
import hashlib
import hmac
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions.text import fingerprint, iso
from memspark.operators.trust import merkle_levels
from memspark.schema import complete
from memspark.session import BROADCAST_BYTES, file_system

#: Deltas of a table before they are folded, and the part of the base's rows from which they go into the base.
MAX_DELTAS, FOLD = 8, 0.25
SCHEMES = {"file": "directory", "hdfs": "directory", "s3": "object store", "s3a": "object store", "gs": "object store", "abfss": "object store"}


def backend(uri: str) -> str:
    """The kind of store behind a URI; a path without scheme is a directory."""
    scheme = uri.split("://", 1)[0] if "://" in uri else "file"
    if scheme not in SCHEMES:
        raise ValueError(f"no store for {scheme}://")
    return SCHEMES[scheme]


def put(spark: SparkSession, root: str, name: str, data: bytes) -> None:
    """An object of a store, of any kind that the cluster has a file system for; it appears whole."""
    backend(root)
    fs, p = file_system(spark, f"{root}/{name}")
    draft = p.getParent().suffix(f"/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(data))
    out.close()
    _rename(spark, draft, p, "OVERWRITE")  # in one step, so readers find one or the other


def _rename(spark: SparkSession, src, goal, how: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(getattr(hadoop, "Options$Rename"), how)
    uri = file_system(spark, goal.toString())[0].makeQualified(goal).toUri()
    hadoop.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration()).rename(src, goal, options)


def _publish(spark: SparkSession, draft: str, root: str, version: int) -> int:
    fs, src = file_system(spark, draft)
    try:
        _rename(spark, src, file_system(spark, f"{root}/v={version}")[1], "NONE")
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(src, True)
        raise Conflict(f"another writer has published version {version}") from e
    return version


def get(spark: SparkSession, root: str, name: str) -> bytes:
    """put()'s object."""
    backend(root)
    fs, p = file_system(spark, f"{root}/{name}")
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(spark: SparkSession, root: str) -> list[str]:
    """The objects of a store."""
    fs, p = file_system(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith("_")) if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a store, in order."""
    fs, p = file_system(spark, root)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in found if n.startswith("v="))


class Conflict(Exception):
    """Another writer has published a version since the one that was read."""


@dataclasses.dataclass
class Change:
    """What a verb does to a table: rows that are new, or take the place of those of equal key, and keys that go.

    Without a key rows are added only. Both come from a table of their own, so they are read once.
    """

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    key: str | None = "id"


def _written(df: DataFrame, path: str, parts: tuple[str, ...] = ()) -> int:
    """Write a table; its rows."""
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def _put_table(spark: SparkSession, draft: str, name: str, schema: T.StructType, files: dict) -> None:
    put(spark, draft, f"{name}.schema", schema.json().encode())
    put(spark, draft, f"{name}.files", json.dumps(files).encode())


def _full(df: DataFrame, root: str, name: str) -> dict:
    path = f"{root}/data/{uuid.uuid4().hex[:12]}-{name}"
    return {"base": path, "rows": _written(df, path, ("status",) if name == "memories" and "status" in df.columns else ()), "key": None, "deltas": []}


def push(tables: dict[str, DataFrame], root: str, same: tuple[str, ...] = (), base: int | None = None) -> int:
    """Write tables whole as the next version; those named in ``same`` stay those of the version before."""
    spark = next(iter(tables.values())).sparkSession
    return commit(spark, root, tables, same=same, base=base)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame | Change], same: tuple[str, ...] = (), base: int | None = None) -> int:
    """Publish the next version: tables written whole or changed, and those of the version before in ``same``.

    With ``base``, it must still be the newest; else ``Conflict`` is raised, and nothing of this is seen.
    """
    backend(root)
    have = versions(spark, root)
    last = base if base is not None else (have or [0])[-1]
    if base is not None and have and have[-1] != base:
        raise Conflict(f"version {base} was read, and {have[-1]} is there")
    draft = f"{root}/_draft-{last + 1}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        if isinstance(df, Change):
            schema, files = _entry(spark, root, name, last)
            _put_table(spark, draft, name, schema, _with(spark, root, name, schema, files, df))
        else:
            _put_table(spark, draft, name, df.schema, _full(df, root, name))
    for name in same:
        put(spark, draft, f"{name}.same", str(_holder(spark, root, name, last)).encode())
    return _publish(spark, draft, root, last + 1)


def _with(spark: SparkSession, root: str, name: str, schema: T.StructType, files: dict, change: Change) -> dict:
    """The files of a table after a change, its delta written."""
    delta, token = {}, uuid.uuid4().hex[:12]
    for kind, df in (("put", change.rows), ("gone", change.gone)):
        if df is not None:
            df = df.select(*schema.names) if kind == "put" else df.select(change.key).distinct()
            n = _written(df.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name in df.columns]), path := f"{root}/data/{token}-{name}-{kind}")
            if n:
                delta[kind] = [path, n]
    out = {**files, "key": change.key or files["key"], "deltas": [*files["deltas"], *([delta] if delta else [])]}
    if len(out["deltas"]) <= MAX_DELTAS:
        return out
    rows = sum(x[k][1] for x in out["deltas"] for k in x)
    if rows >= FOLD * max(1, out["rows"]):
        return _full(_merged(spark, schema, out), root, name)
    put_, gone = _folded(spark, schema, out)
    token, delta = uuid.uuid4().hex[:12], {}
    for kind, df in (("put", put_), ("gone", gone)):
        if df is not None and (n := _written(df, path := f"{root}/data/{token}-{name}-{kind}")):
            delta[kind] = [path, n]
    return {**out, "deltas": [delta]}


def _holder(spark: SparkSession, root: str, table: str, version: int) -> int:
    """The version that tells a table's files for this one."""
    fs, p = file_system(spark, f"{root}/v={version}/{table}.same")
    return int(get(spark, f"{root}/v={version}", f"{table}.same")) if fs.exists(p) else version


def _entry(spark: SparkSession, root: str, table: str, version: int) -> tuple[T.StructType, dict]:
    folder = f"{root}/v={_holder(spark, root, table, version)}"
    return T.StructType.fromJson(json.loads(get(spark, folder, f"{table}.schema"))), json.loads(get(spark, folder, f"{table}.files"))


def _folded(spark: SparkSession, schema: T.StructType, files: dict) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows that deltas put, the last of each key, and the keys that are gone in the end."""
    key, put_, marks = files["key"], None, None
    for k, delta in enumerate(files["deltas"]):
        for kind, (path, _) in delta.items():
            df = spark.read.schema(schema if kind == "put" else T.StructType([schema[key]])).parquet(path)
            if kind == "put":
                rows = df.select(*schema.names, F.lit(k).alias("_delta"))
                put_ = rows if put_ is None else put_.unionByName(rows)
            if key:
                # In one change rows come after what goes.
                mark = df.select(F.col(key).alias("_key"), F.lit(2 * k + (kind == "put")).alias("_at"))
                marks = mark if marks is None else marks.unionByName(mark)
    if not key or marks is None:
        return (None if put_ is None else put_.drop("_delta")), None
    last = marks.groupBy("_key").agg(F.max("_at").alias("_at"))
    live = None if put_ is None else put_.join(last, (F.col(key) == F.col("_key")) & (F.col("_at") == 2 * F.col("_delta") + 1)).select(*schema.names)
    return live, last.filter("_at % 2 = 0").select(F.col("_key").alias(key))


def _merged(spark: SparkSession, schema: T.StructType, files: dict) -> DataFrame:
    """A table as its base and deltas make it; keys of deltas are broadcast if they are few by the counts kept."""
    base = spark.read.schema(schema).parquet(files["base"]).select(*schema.names)
    if not files["deltas"]:
        return base
    put_, gone = _folded(spark, schema, files)
    key = files["key"]
    if key:
        n = sum(x[k][1] for x in files["deltas"] for k in x)
        keys = None
        for df in (put_, gone):
            if df is not None:
                keys = df.select(key) if keys is None else keys.unionByName(df.select(key))
        base = base.join(F.broadcast(keys) if n * 64 <= BROADCAST_BYTES else keys, key, "left_anti").select(*schema.names)
    return base if put_ is None else base.unionByName(put_)


def pull(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a version, the newest if none is given; older ones serve as backups to go back to."""
    return _merged(spark, *_entry(spark, root, table, versions(spark, root)[-1] if version is None else version))


def rows(spark: SparkSession, root: str, table: str, version: int) -> int:
    """Rows of a table that is only added to, by the counts kept; nothing is read."""
    files = _entry(spark, root, table, version)[1]
    return files["rows"] + sum(x["put"][1] for x in files["deltas"] if "put" in x)


def tables_of(spark: SparkSession, root: str, version: int) -> list[str]:
    return sorted({n.rsplit(".", 1)[0] for n in names(spark, f"{root}/v={version}") if n.endswith((".schema", ".same"))})


def rollback(spark: SparkSession, root: str, version: int) -> int:
    """An older version as the newest; those in between stay, and nothing is copied."""
    while True:
        newest = versions(spark, root)[-1]
        draft = f"{root}/_draft-{newest + 1}-{uuid.uuid4().hex[:8]}"
        for t in tables_of(spark, root, version):
            put(spark, draft, f"{t}.same", str(_holder(spark, root, t, version)).encode())
        try:
            return _publish(spark, draft, root, newest + 1)
        except Conflict:
            continue


def pull_merge(spark: SparkSession, root: str, memories: DataFrame, edges: DataFrame | None, tombstones: DataFrame, now: Column, version: int | None = None) -> dict[str, DataFrame]:
    """Another store's memories merged into this one through consolidation."""
    from memspark.operators.merge import merge_strand

    return merge_strand(memories, edges, pull(spark, root, "memories", version), tombstones, now)


FORMAT, STANDARD = "portable-agent-memory", "1.0"


def records(memories: DataFrame) -> DataFrame:
    """id, record: portable JSON records of memories, with lineage and, where there is one, the signature."""
    m = complete(memories)
    said = F.transform("provenance", lambda p: F.struct(p["agent"].alias("agent"), p["extractor"].alias("extractor"), p["origin"].alias("origin"))).alias("provenance")
    times = [iso(F.col(c)).alias(c) for c in ("valid_from", "valid_to", "created_at")]
    signature = F.when(F.col("sig").isNotNull(), F.struct(F.col("sig_scheme").alias("scheme"), "signer", "sig")).alias("signature")
    fields = ["id", "type", "content", "scope", F.bround("confidence", 3).alias("confidence"), F.bround("importance", 3).alias("importance"), *times, said, signature]
    return m.select("id", F.to_json(F.struct(*fields)).alias("record"))


def portable(memories: DataFrame, edges: DataFrame, generator: str, now: Column) -> dict[str, DataFrame]:
    """A portable export: records, edges but those of hubs, and a header with the Merkle root over all fingerprints."""
    m = complete(memories).filter("status = 'active' and not hub")
    links = edges.filter("relation <> 'has_member'").select(F.to_json(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "relation")).alias("edge"))
    root = merkle_levels(m.select(fingerprint(F.col("type"), F.col("content")).alias("leaf")))
    counted = m.agg(F.count("*").alias("n")).crossJoin(root.limit(1)) if m.limit(1).count() else m.agg(F.count("*").alias("n")).withColumn("root", F.lit(None).cast("string"))
    integrity = F.when(F.col("root").isNotNull(), F.struct(F.lit("sha256").alias("algo"), F.col("root").alias("merkle_root")))
    header = counted.select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(STANDARD).alias("version"), F.lit(generator).alias("generator"), iso(now).alias("created_at"), F.col("n").alias("count"), integrity.alias("integrity"))).alias("header"))
    return {"records": records(m), "edges": links, "header": header}


def write_portable(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as lines of JSON."""
    for name, df in parts.items():
        df.select(df.columns[-1]).write.mode("overwrite").text(f"{path}/{name}")


RECORD = (
    "id string, type string, content string, scope string, confidence double, importance double, valid_from string, valid_to string, created_at string, "
    "provenance array<struct<agent:string,extractor:string,origin:string>>, signature struct<scheme:string,signer:string,sig:string>"
)


def read_portable(spark: SparkSession, path: str) -> DataFrame:
    """The records of write_portable()."""
    return spark.read.schema(RECORD).json(f"{path}/records")


def write_bundle(facts: DataFrame, path: str, contributor: str) -> None:
    """Shared facts as JSON lines, each with its contributor."""
    facts.withColumn("contributor", F.lit(contributor)).write.mode("overwrite").json(path)


def read_bundle(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _digest(df: DataFrame) -> DataFrame:
    """Of each row's canonical JSON a hash."""
    return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("leaf"))


def export_container(tables: dict[str, DataFrame], root: str, key: bytes, strand: str) -> dict:
    """Tables with a signed manifest: counts and Merkle roots over their rows. Returns the manifest.

    What stands in the container can be read with any Parquet reader; the signature is a keyed MAC, and
    there is no encryption.
    """
    spark = next(iter(tables.values())).sparkSession
    held = {}
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{root}/data/{name}")
        written = spark.read.schema(df.schema).parquet(f"{root}/data/{name}")
        n = written.count()
        held[name] = {"rows": n, "merkle_root": merkle_levels(_digest(written)).first()["root"] if n else None, "schema": df.schema.json()}
    manifest = {"format": "memspark-container", "version": 1, "strand": strand, "algo": "sha256", "tables": held}
    body = json.dumps(manifest, sort_keys=True)
    put(spark, root, "manifest.json", json.dumps({"manifest": manifest, "mac": hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}).encode())
    return manifest


def read_manifest(spark: SparkSession, root: str, key: bytes) -> dict:
    """The manifest of a container; raises where its signature doesn't hold."""
    got = json.loads(get(spark, root, "manifest.json"))
    body = json.dumps(got["manifest"], sort_keys=True)
    if not hmac.compare_digest(got["mac"], hmac.new(key, body.encode(), hashlib.sha256).hexdigest()):
        raise ValueError("the manifest is not signed with this key")
    return got["manifest"]


def verify_container(spark: SparkSession, root: str, key: bytes) -> dict[str, bool]:
    """Whether each table is as the manifest says."""
    out = {}
    for name, held in read_manifest(spark, root, key)["tables"].items():
        df = spark.read.schema(T.StructType.fromJson(json.loads(held["schema"]))).parquet(f"{root}/data/{name}")
        n = df.count()
        out[name] = n == held["rows"] and (not n or merkle_levels(_digest(df)).first()["root"] == held["merkle_root"])
    return out


def import_container(spark: SparkSession, root: str, key: bytes) -> dict[str, DataFrame]:
    """The tables of a container, once verified."""
    broken = [name for name, ok in verify_container(spark, root, key).items() if not ok]
    if broken:
        raise ValueError(f"not as the manifest says: {', '.join(broken)}")
    return {name: spark.read.parquet(f"{root}/data/{name}") for name in read_manifest(spark, root, key)["tables"]}
