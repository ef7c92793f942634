"""Size-tiered compaction of immutable shards under a versioned manifest.

``append`` writes arrivals as they come, in one pass and without a shuffle: small shards, a folder for each
arrival. ``compact`` puts the shards of a version into tiers by size and cuts runs of one tier; each run is
rewritten by a task of its own as one file near the target size, wave by wave, and other shards are left
alone. A version is a manifest: its rows are written to a folder of their own beside the schema, and one
rename that fails if the version exists publishes it. A writer that loses that race builds its manifest anew
on the version that won. Where nothing is to be merged, nothing is committed. Readers see a version whole or
not at all, and every version stays readable, as replaced shards are kept until ``vacuum``; a job that dies
leaves files that no manifest names. Only DataFrame operations and, on the driver, renames are used. The
rename is atomic on file systems such as HDFS; on object stores it is only as good as the connector's.

A version's schema has the columns of all that was ever appended: later columns come behind, and are null in
older rows; a column that comes back with another type is refused.

Cases: null values, repeated rows and extra columns go through as they are, whatever their names; an
empty table makes a version without rows, read back as an empty table; very long texts make a shard
larger than others of so many rows, which then sits in a higher tier.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

#: Bytes that a merged file aims at; shards over three quarters of it are never rewritten.
TARGET_BYTES = 128 << 20
#: Files that a small table is compacted into, about, where no target is given, and the least target then.
FILES, LEAST_TARGET = 4, 64 << 10
#: Arrivals that ``shard`` takes a table as; the k-th has k shares of the rows.
ARRIVALS = 8
#: Runs that one job merges, a task each, and jobs at a time.
RUNS_A_JOB, JOBS = 128, 8
#: Rows of a small shard at most.
SMALL_ROWS = 50_000
#: Shards of one tier that are merged at least if they stay far below the target; each tier spans sizes of a factor of ``TIER``.
MIN_RUNS, TIER = 4, 4
#: Shards that one window of the planning sees at most, roughly.
SECTION = 4096
#: Bytes and shards that a wave rewrites, about; the driver sees the names of one wave's shards at a time.
WAVE_BYTES, WAVE_SHARDS = 1 << 40, 50_000
#: The folder of an append or a wave, in a shard's path.
_FOLDER = r"/data/((?:small|merged)-[0-9a-f]{12})/"
_ONE_TASK = "spark.sql.unionOutputPartitioning"
_MANIFEST = "path string, bytes long, tier int, level int, folder_files int"


def _data(root: str, kind: str) -> str:
    return f"{root}/data/{kind}-{uuid.uuid4().hex[:12]}"


def _listed(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Manifest rows of the shards under a folder; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    tier = F.floor(F.log(float(TIER), F.greatest(F.col("length"), F.lit(1)))).cast("int")
    n = found.select("path").count()
    return found.select("path", F.col("length").alias("bytes"), tier.alias("tier"), F.lit(level).alias("level"), F.lit(n).cast("int").alias("folder_files"))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, in order."""
    fs, p = files._fs(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Shards of a version, the newest if none is given: path, bytes, tier, level."""
    version = versions(spark, root)[-1] if version is None else version
    return spark.read.schema(_MANIFEST).parquet(f"{root}/versions/v{version:010d}")


def _commit(spark: SparkSession, root: str, shards: DataFrame, version: int, schema: T.StructType | None = None) -> int:
    """Publish shards as this version, without a schema with the newest one's; fails if another writer has published it."""
    schema = _schema(spark, root, versions(spark, root)[-1]) if schema is None else schema
    ready = f"{root}/staged/{uuid.uuid4().hex}"
    shards.coalesce(1 + shards.sparkSession.sparkContext.defaultParallelism // 8).write.parquet(ready)
    spark.createDataFrame([], schema).write.parquet(f"{ready}/_schema")
    jvm = spark.sparkContext._jvm
    fs, parent = files._fs(spark, f"{root}/versions")
    fs.mkdirs(parent)
    hadoop = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    context = hadoop.FileContext.getFileContext(parent.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(hadoop.Path(ready), hadoop.Path(f"{root}/versions/v{version:010d}"), options)
    return version


def _publish(spark: SparkSession, root: str, change, schema: T.StructType | None = None) -> int:
    """Commit change(newest manifest or None) as the next version, on top of whatever others commit meanwhile."""
    while True:
        have = versions(spark, root)
        now = manifest(spark, root, have[-1]) if have else None
        both = _merged(_schema(spark, root, have[-1]) if have else None, schema)
        try:
            return _commit(spark, root, change(now), (have[-1] if have else 0) + 1, both)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise


def _schema(spark: SparkSession, root: str, version: int) -> T.StructType:
    return spark.read.parquet(f"{root}/versions/v{version:010d}/_schema").schema


def _merged(old: T.StructType | None, new: T.StructType | None) -> T.StructType:
    """The columns of both, old ones first; refuses one column of two types."""
    if old is None or new is None:
        return old or new
    held = {f.name.lower(): f for f in old}
    for f in new:
        if f.name.lower() in held and held[f.name.lower()].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {held[f.name.lower()].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([*old, *(f for f in new if f.name.lower() not in held)])


def append(docs: DataFrame, root: str, arrivals: int = 1) -> int:
    """Write docs as small shards and commit them beside those of the newest version.

    With several arrivals, rows are dealt to folders of unlike size in the same pass, by their place.
    """
    spark = docs.sparkSession
    have = versions(spark, root)
    _merged(_schema(spark, root, have[-1]) if have else None, docs.schema)  # before anything is written
    write = lambda df: df.write.option("compression", "zstd").option("maxRecordsPerFile", SMALL_ROWS)
    paths = [_data(root, "small")]
    if arrivals == 1:
        write(docs).parquet(paths[0])
    else:
        name, draft = f"_arrival_{files.token()}", f"{root}/staged/{uuid.uuid4().hex}"
        shares = arrivals * (arrivals + 1) // 2
        dealt = [F.lit(k) for k in range(arrivals) for _ in range(k + 1)]
        write(docs.withColumn(name, F.element_at(F.array(*dealt), (F.monotonically_increasing_id() % shares + 1).cast("int")))).partitionBy(name).parquet(draft)
        fs, top = files._fs(spark, draft)
        found = sorted(x.getPath().toString() for x in fs.listStatus(top) if x.isDirectory())
        if found:
            paths = [_data(root, "small") for _ in found]
            for path, arrival in zip(paths, found, strict=True):
                goal = files._fs(spark, path)[1]
                fs.mkdirs(goal.getParent())
                if not fs.rename(files._fs(spark, arrival)[1], goal):
                    raise OSError(f"{arrival} could not be put in place")
        else:
            write(docs).parquet(paths[0])
        files.remove(spark, draft)
    shards = _listed(spark, paths[0], 0)
    for path in paths[1:]:
        shards = shards.unionByName(_listed(spark, path, 0))
    return _publish(spark, root, lambda now: shards if now is None else shards.unionByName(now), docs.schema)


def plan(shards: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(path, bytes, tier, run): which shards are merged, and the run that each belongs to.

    Within a tier, in order of their paths, runs are cut as their bytes pass the target. A run is merged
    if it has MIN_RUNS shards, or two or more that make half of the target at least. Shards over half of
    it are taken in pairs, and those over three quarters are near enough to stay, so no merged file is
    over one and a half targets. The planning windows see a section of the shards each, so no task sees
    all.
    """
    n = shards.count()
    small = shards.filter(F.col("bytes") * 4 <= 3 * target)
    small = small.withColumn("large", F.col("bytes") * 2 > target).withColumn("section", F.pmod(F.xxhash64("path"), F.lit(max(1, -(-n // SECTION)))))
    order = Window.partitionBy("tier", "large", "section").orderBy("path")
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    pair = F.floor((F.row_number().over(order) - 1) / 2)
    cut = small.withColumn("cut", F.when(F.col("large"), pair).otherwise(F.floor(before / target)))
    run = Window.partitionBy("tier", "large", "section", "cut")
    cut = cut.withColumn("runs", F.count("*").over(run)).withColumn("sum", F.sum("bytes").over(run))
    cut = cut.filter((F.col("runs") >= MIN_RUNS) | (F.col("runs") > 1) & (F.col("sum") * 2 >= target))
    return cut.select("path", "bytes", "tier", F.concat_ws("-", "tier", "section", "cut", F.col("large").cast("string")).alias("run"))


class Replaced(Exception):
    """Another writer has replaced shards that a wave was about to replace."""


def compact(spark: SparkSession, root: str, target: int = TARGET_BYTES) -> int:
    """Merge runs of similar size wave by wave, each committed by itself; the last version.

    Replaced shards stay for the readers of older versions; see ``vacuum``. Where another compaction was
    faster, its result stands and this one plans again. Without a run to merge the version stays.
    """
    while True:
        version = versions(spark, root)[-1]
        with files.scope(spark):
            chosen = files.saved(plan(manifest(spark, root, version), target), "compaction")
            total = chosen.agg(F.sum("bytes"), F.count("*")).first()
            waves = max(1, -(-(total[0] or 0) // WAVE_BYTES), -(-total[1] // WAVE_SHARDS))
            try:
                for w in range(waves if total[1] else 0):
                    part = chosen if waves == 1 else chosen.filter(F.pmod(F.xxhash64("run"), F.lit(waves)) == w)
                    version = _wave(spark, root, part, target)
                return version
            except Replaced:
                continue


def _wave(spark: SparkSession, root: str, part: DataFrame, target: int) -> int:
    """Rewrite the runs of part, each in one task as one file, and commit."""
    runs = part.groupBy("run").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()  # names of a wave's shards
    base = versions(spark, root)[-1]
    if not runs:
        return base
    path, schema, gone = _data(root, "merged"), _schema(spark, root, base), part.select("path")

    def merge(k: int) -> None:
        out = None
        for r in runs[k : k + RUNS_A_JOB]:
            docs = spark.read.schema(schema).parquet(*r["paths"]).coalesce(1)
            out = docs if out is None else out.union(docs)
        out.write.option("compression", "zstd").parquet(f"{path}/job={k}")

    # Else a union of single partitions is a single partition, and one task writes all runs of a job.
    before = spark.conf.get(_ONE_TASK, None)
    spark.conf.set(_ONE_TASK, "false")
    try:
        with ThreadPoolExecutor(JOBS) as pool:
            list(pool.map(merge, range(0, len(runs), RUNS_A_JOB)))
    finally:
        spark.conf.unset(_ONE_TASK) if before is None else spark.conf.set(_ONE_TASK, before)
    merged = _listed(spark, path, 1)

    def change(now: DataFrame) -> DataFrame:
        if now.join(F.broadcast(gone), "path", "left_semi").count() < sum(len(r["paths"]) for r in runs):  # bounded by WAVE_SHARDS
            files.remove(spark, path)
            raise Replaced
        return now.join(F.broadcast(gone), "path", "left_anti").unionByName(merged)

    return _publish(spark, root, change)


def vacuum(spark: SparkSession, root: str, retain: int = 1, grace_seconds: int = 86_400) -> None:
    """Forget all but the newest versions, and delete folders of shards that none of those names.

    Folders younger than the grace period may belong to a writer that hasn't committed yet and stay.
    """
    have = versions(spark, root)
    for v in have[:-retain]:
        files.remove(spark, f"{root}/versions/v{v:010d}")
    live = set()
    for v in have[-retain:]:
        live |= {r["folder"] for r in _folders(manifest(spark, root, v))}
    fs, p = files._fs(spark, f"{root}/data")
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    for s in fs.listStatus(p) if fs.exists(p) else []:
        if s.getPath().getName() not in live and now - s.getModificationTime() >= grace_seconds * 1000:
            fs.delete(s.getPath(), True)


def _folders(shards: DataFrame) -> list:
    """folder, live, all: one row for each append or wave, of which a store has few."""
    folder = F.regexp_extract("path", _FOLDER, 1).alias("folder")
    return shards.groupBy(folder).agg(F.count("*").alias("live"), F.first("folder_files").alias("all")).collect()


def read(spark: SparkSession, root: str, version: int | None = None, file: str | None = None) -> DataFrame:
    """The documents of a version, as they were appended, on request with the name of each one's shard.

    Folders whose shards are all live are read as they are; of others, rows of replaced shards are left
    out. No list of shards passes through the driver's plan.
    """
    version = versions(spark, root)[-1] if version is None else version
    shards, schema = manifest(spark, root, version), _schema(spark, root, version)
    whole, partly = [], []
    for r in _folders(shards):
        (whole if r["live"] == r["all"] else partly).append(r["folder"])
    name = file or f"_file_{files.token()}"
    out = None
    for some, all_live in ((whole, True), (partly, False)):
        if some:
            docs = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{root}/data/{x}" for x in some])
            named = docs.select("*", docs.metadataColumn("_metadata")["file_name"].alias(name))
            if not all_live:
                live = shards.filter(F.regexp_extract("path", _FOLDER, 1).isin(some)).select(F.regexp_extract("path", r"[^/]+$", 0).alias(name))
                named = named.join(files.few(live, 128), name, "left_semi").select(*docs.columns, name)
            out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], schema) if file is None else spark.createDataFrame([], schema).withColumn(name, F.lit(""))
    return out if file else out.drop(name)


def fitting(spark: SparkSession, root: str) -> int:
    """A target that makes some files of a small table, and those of ``TARGET_BYTES`` of a large one."""
    total = manifest(spark, root).agg(F.sum("bytes")).first()[0] or 0
    return min(TARGET_BYTES, max(LEAST_TARGET, total // FILES))


def shard(docs: DataFrame, root: str | None = None, target: int | None = None, file: str | None = None) -> tuple[DataFrame, str, int]:
    """Append docs as several arrivals and compact them; what the manifest then reads back, the root, and the version."""
    spark = docs.sparkSession
    root = root or files.folder(spark, "shards")
    append(docs, root, ARRIVALS)
    version = compact(spark, root, target or fitting(spark, root))
    return read(spark, root, version, file), root, version
