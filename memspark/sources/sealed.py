"""An encrypted container: blocks of rows under AES-GCM, each bound to its container, table and number.

A block can be read by itself, and one that was altered, or stands in another's place, isn't opened. The
container has a key of its own, which the signed manifest holds wrapped under the owner's; it tells also how
many blocks there are, so none can be left out. Spark encrypts and decrypts, block by block in its tasks.
The container's key is a part of their plans, so plans belong to those who may read the data.

Cases: a null stays null; a table without rows has no block; equal rows are kept as often as they come.
Columns are read back by the schema in the manifest, so any names do.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.session import numbered
from memspark.sources.snapshots import get, put

#: Rows of a block.
BLOCK = 1000
FORMAT = "memspark-sealed"
_RANDOM = b""  # a fresh initial vector for each block


class Broken(ValueError):
    """A container, or a part of it, isn't what its owner has sealed."""


def _bound(strand: str, name: str, block: Column) -> Column:
    """What a block is sealed together with."""
    return F.concat_ws("|", F.lit(strand), F.lit(name), block.cast("string")).cast("binary")


def seal(tables: dict[str, DataFrame], root: str, key: bytes, strand: str, block: int = BLOCK) -> dict:
    """Tables as a sealed container at root, under a key of 16, 24 or 32 bytes; its manifest."""
    spark = next(iter(tables.values())).sparkSession
    own = secrets.token_hex(16).encode()  # 32 bytes
    wrapped = spark.range(1).select(F.base64(F.aes_encrypt(F.lit(own), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(_RANDOM), F.lit(strand.encode()))).alias("k")).first()["k"]
    held = {}
    for name, df in sorted(tables.items()):
        text = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))
        rows = numbered(text.withColumn("tie", F.monotonically_increasing_id()), F.xxhash64("row"), F.col("row"), F.col("tie"), name="k")
        blocks = rows.groupBy(F.floor(F.col("k") / block).alias("block")).agg(F.to_json(F.collect_list("row")).cast("binary").alias("body"), F.count("*").alias("n"))  # block rows
        shut = F.aes_encrypt(F.col("body"), F.lit(own), F.lit("GCM"), F.lit("DEFAULT"), F.lit(_RANDOM), _bound(strand, name, F.col("block")))
        blocks.select("block", "n", shut.alias("sealed")).write.mode("overwrite").parquet(f"{root}/sealed/{name}")
        n = spark.read.parquet(f"{root}/sealed/{name}").agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        held[name] = {"rows": n["rows"], "blocks": n["blocks"], "schema": df.schema.json()}
    manifest = {"format": FORMAT, "version": 1, "strand": strand, "key": wrapped, "tables": held}
    put(spark, root, "manifest.json", json.dumps({"manifest": manifest, "mac": _mac(manifest, key)}).encode())
    return manifest


def _mac(manifest: dict, key: bytes) -> str:
    return hmac.new(key, json.dumps(manifest, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def manifest_of(spark: SparkSession, root: str, key: bytes) -> dict:
    """The manifest, once its signature holds under the key."""
    got = json.loads(get(spark, root, "manifest.json"))
    if not hmac.compare_digest(got["mac"], _mac(got["manifest"], key)):
        raise Broken("the manifest is not signed with this key")
    return got["manifest"]


def opened(spark: SparkSession, root: str, key: bytes, name: str) -> DataFrame:
    """block, n, body: the blocks of a table, body null where one isn't what was sealed there; to be filtered by block."""
    manifest = manifest_of(spark, root, key)
    wrapped = F.aes_decrypt(F.unbase64(F.lit(manifest["key"])), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(manifest["strand"].encode()))
    own = bytes(spark.range(1).select(wrapped.alias("k")).first()["k"])
    blocks = spark.read.schema("block long, n long, sealed binary").parquet(f"{root}/sealed/{name}")
    body = F.try_aes_decrypt("sealed", F.lit(own), F.lit("GCM"), F.lit("DEFAULT"), _bound(manifest["strand"], name, F.col("block")))
    return blocks.select("block", "n", body.cast("string").alias("body"))


def verified(spark: SparkSession, root: str, key: bytes) -> dict[str, bool]:
    """Whether each table has just the blocks that were sealed."""
    out = {}
    for name, held in manifest_of(spark, root, key)["tables"].items():
        got = opened(spark, root, key, name).agg(F.count("*"), F.count_distinct("block"), F.count("body"), F.coalesce(F.max("block") + 1, F.lit(0))).first()
        out[name] = all(x == held["blocks"] for x in got)
    return out


def unseal(spark: SparkSession, root: str, key: bytes, name: str, blocks: list[int] | None = None) -> DataFrame:
    """A table of a container, whole or some blocks of it; ``Broken`` if any block of the table, or of those asked for, isn't what was sealed."""
    held = manifest_of(spark, root, key)["tables"][name]
    got = opened(spark, root, key, name)
    if blocks is None:
        ok = verified(spark, root, key)[name]
    else:
        got = got.filter(F.col("block").isin(list(blocks)))
        ok = got.agg(F.count("body")).first()[0] == len(set(blocks))
    if not ok:
        raise Broken(f"{name} is not what was sealed")
    schema = T.StructType.fromJson(json.loads(held["schema"]))
    rows = got.select(F.explode(F.from_json("body", "array<string>")).alias("row"))
    return rows.select(F.from_json("row", schema).alias("x")).select(*[F.col("x").getField(c).alias(c) for c in schema.names])
