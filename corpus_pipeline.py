"""From raw documents to shards for training, in five stages.

Each stage takes (spark, docs, sf_dir), sees all that the one before kept, and returns documents with
the columns they came with; the last returns what its shards hold, with the shard that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import decontam, files, minhash, mixing, quality, sharding
from memspark.session import ship

#: Similarity from which near_dedup links documents; op4's 85 is of that query alone.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands and the base rules; null, empty and short texts go.

    Rows are judged one by one, so repeated rows and ids stay or go alike.
    """
    ship(spark)
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, linked from a similarity of 0.80 up.

    Rows without doc_id stay; of rows that share an id and a component one stays.
    """
    ship(spark)
    return minhash.deduplicate(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark; texts without words share none."""
    ship(spark)
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, each as often as it is taken; a null source is one of its own."""
    ship(spark)
    return mixing.mix(docs)


def _unused(name: str, docs: DataFrame) -> str:
    """The name, with underscores after it where docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents read back from the committed shards, with shard_file, the shard's name, and manifest_version.

    Where docs has columns of those names, the new ones get underscores after theirs.
    """
    out, _, version = sharding.shard(docs, file=_unused("shard_file", docs))
    return out.withColumn(_unused("manifest_version", docs), F.lit(version))


STAGES = [(f.__name__, f) for f in (quality_rules, near_dedup, decontaminate, mix_sources, shard_documents)]

#: Zstandard ratios and the cube method have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again.

    What a stage worked with goes once its result is written, and its input with it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with files.scope(spark):
            docs = files.saved(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            files.drop(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    files.drop(docs)  # the shards hold all of it by now
    return out
