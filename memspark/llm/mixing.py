"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source gets the same expected number of repeats, target / source size. Its whole
part is taken for certain; its fraction is an inclusion probability, and the cube method turns the
fractions into 0 or 1. The flight moves the probabilities along the null space of the two
balancing constraints (words and documents of the source), so both totals stay as they are while at
least one probability lands at each move. Blocks of a source fly side by side and leave some two fractions
each; those fly together level by level, until a small landing problem per source remains.

Rows that agree in id, source and text are one unit with their number as its weight, made in a counted
aggregation, so a million of them weigh no more than one; what the unit takes is dealt out among its
rows. Decisions travel to the rows by their place (see ``places``): no text is shuffled, at any size.

Cases: a null text has size 0; null sources are a source of their own; equal rows share their unit's
copies as evenly as can be; a document with null id takes part like any other. Sources without words
have target 0. An empty table gives an empty result. Extra columns are kept by ``mix`` and not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, places

WORD = r"[^\x20\x09-\x0D]+"
#: Units of a block of the flight; the fractions of so many blocks meet on the next level.
BLOCK, FAN = 1024, 256
#: Rows of a unit that are numbered together.
EQUAL_ROWS = 1 << 16
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
_EPS = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """Place, doc_id, source, size and a 128-bit name of the unit of every row of a rooted table."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    doc_id = F.col("doc_id").cast("long")
    # A null is not the empty string, and no value runs into the next.
    said = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (doc_id.cast("string"), source, text)]
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*places.place(docs), doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), F.unhex(F.md5(F.concat(*said))).alias("unit"))


def level(per: DataFrame) -> float:
    """The level at which targets min(level * w, cap) share all sizes.

    Sources above their cap give the excess to the others, again and again, until none is above: a pass
    over one row per source each time. Sums are whole numbers, so their order has no bearing.
    """
    total, weight = per.agg(F.sum("source_size"), F.sum("w")).first()
    now = total / weight if weight else 0.0
    while weight:
        full = F.col("cap") <= F.lit(now) * F.col("w")
        capped, free = per.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("w")))).first()
        if not free or (total - capped) / free <= now:
            break
        now = (total - capped) / free
    return now


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: its size, number of documents, target and expected repeats."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = files.numbered(per, F.col("source").asc_nulls_last(), "source_no")
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    per = files.saved(per.withColumn("w", w).withColumn("cap", F.col("source_size") * MAX_REPEATS), "sources")
    target = F.least(F.lit(level(per)) * F.col("w"), F.col("cap").cast("double"))
    repeats = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select("source", "source_no", "source_size", "n_docs", "target", repeats.alias("repeats"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities within the null space of (size, 1) until no move is left.

    Units come in the order given, large ones first. A move follows the projection of the first
    unit's axis on the null space, so many small units make up for a large one, and what is left for
    the landing is small: two units, or a few where all but one are of equal size.
    """
    out = pi.copy()
    out[out < _EPS], out[out > 1 - _EPS] = 0.0, 1.0
    at = np.flatnonzero((out > 0) & (out < 1))
    p, x = out[at], size[at].astype(float)
    draws, k, pivot = rng.random(len(at) + 1), 0, 0
    while len(p) > 2 and pivot < len(p):
        z = x - x.mean()
        spread = z @ z
        u = np.full(len(p), -1.0 / len(p))
        if spread > 0:
            u -= z * (z[pivot] / spread)
        u[pivot] += 1
        if abs(u[pivot]) < 1e-7:  # it can't move on its own; another may
            pivot += 1
            continue
        u[np.abs(u) < 1e-12] = 0.0
        with np.errstate(divide="ignore"):
            room_up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf))
            room_down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf))
        up, down = room_up.min(), room_down.min()
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        p += step * u
        p[(room_up if step > 0 else room_down).argmin()] = round(p[(room_up if step > 0 else room_down).argmin()])
        p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
        left = (p > 0) & (p < 1)
        out[at[~left]] = p[~left]
        p, x, at = p[left], x[left], at[left]
        pivot = 0
    out[at] = p
    return out


def landing(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last fractions: of the roundings, the one that misses the words least; then at random."""
    at = np.flatnonzero((pi > 0) & (pi < 1))
    out = pi.copy()
    while len(at) > 12:  # only where all but one are of one size: their order is as good as any
        first, second = at[-1], at[-2]
        both = out[first] + out[second]
        out[second], out[first] = (both, 0.0) if both <= 1 else (1.0, both - 1)
        at = np.flatnonzero((out > 0) & (out < 1))
    want = float(out[at] @ size[at])
    best, ties = None, []
    for k in range(1 << len(at)):
        pick = np.array([(k >> j) & 1 for j in range(len(at))], float)
        miss = (round(abs(float(pick @ size[at]) - want), 6), round(abs(pick.sum() - out[at].sum()), 6))
        if best is None or miss < best:
            best, ties = miss, [pick]
        elif miss == best:
            ties.append(pick)
    if len(at):
        out[at] = ties[int(rng.integers(len(ties)))]
    return out


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little"))


def _units(sizes: DataFrame, seed: int) -> DataFrame:
    """unit, n, copies: how often the rows of each unit are taken in all."""
    per = files.saved(targets(sizes), "targets")
    n_sources, most = per.agg(F.count("*"), F.max("n_docs")).first()
    once = sizes.groupBy("unit", F.col("source").alias("_s"), "size").agg(F.count("*").alias("n"))
    units = once.join(files.few(per, 200, n_sources), F.col("_s").eqNullSafe(F.col("source")))
    mixed, want = F.xxhash64(F.col("unit"), F.lit(seed)), F.col("n") * F.col("repeats")
    units = units.select(
        "unit", "source_no", "size", "n", F.floor(want).cast("long").alias("whole"), (want - F.floor(want)).alias("pi"),
        F.pmod(mixed, F.ceil(F.col("n_docs") / BLOCK)).cast("long").alias("block"), mixed.alias("mixed"),
    )

    def fly(level: int, last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "mixed", "unit"], ascending=[False, True, True], ignore_index=True)
            rng = _seed(seed, level, int(key[0]), int(key[1]))
            x = pdf["size"].to_numpy(np.int64)
            pi = flight(pdf["pi"].to_numpy(float), x, rng)
            if last:
                pi = landing(pi, x, rng)
            pdf["pi"] = pi
            return pdf

        return run

    blocks, level_, settled = max(1, -(-int(most or 0) // BLOCK)), 0, None
    while True:
        flown = units.groupBy("source_no", "block").applyInPandas(fly(level_, blocks == 1), units.schema)
        flown = files.saved(flown, f"flight{level_}")
        if blocks == 1:
            done = flown
        else:
            done = flown.filter("pi = 0 or pi = 1")
            units = flown.filter("pi > 0 and pi < 1").withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        settled = done if settled is None else settled.unionByName(done)
        if blocks == 1:
            break
        blocks, level_ = -(-blocks // FAN), level_ + 1
    copies = (F.col("whole") + F.round("pi").cast("long")).alias("copies")
    # A source's row again, as its name may be null and was not carried along.
    named = settled.join(files.few(per.select("source_no", "source_size", "target"), 24, n_sources), "source_no")
    return named.select("unit", "n", copies, "source_size", "target")


def _dealt(sizes: DataFrame, units: DataFrame) -> DataFrame:
    """Rows with their own copies; rows of one unit get as many each, and the rest goes to its first."""
    both = files.saved(sizes.join(units.hint("merge"), "unit"), "matched")
    alone = both.filter("n = 1").drop("unit", "n")
    many = both.filter("n > 1").withColumn("salt", F.pmod(F.xxhash64(places.FILE, places.ROW), F.ceil(F.col("n") / EQUAL_ROWS)))
    before = Window.partitionBy("unit").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = many.groupBy("unit", "salt").agg(F.count("*").alias("c")).select("unit", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("unit", "salt").orderBy(places.FILE, places.ROW)) + F.col("base")
    own = F.floor(F.col("copies") / F.col("n")) + (number <= F.col("copies") % F.col("n")).cast("long")
    many = many.join(base, ["unit", "salt"]).withColumn("copies", own.cast("long"))
    return alone.unionByName(many.drop("unit", "n", "salt", "base"))


def decide(docs: DataFrame, seed: int = 7) -> DataFrame:
    """file, row, doc_id, source, size, source_size, target, copies: how often each row of a rooted table is taken."""
    with files.scope(docs.sparkSession):
        sizes = files.saved(sized(docs), "sizes")
        return files.saved(_dealt(sizes, _units(sizes, seed)), "decided", keep=True)


def taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix per document, in words."""
    got = decide(places.rooted(docs), seed)
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs as the mix takes them, each as often as it is taken."""
    docs = places.rooted(docs)
    decided = decide(docs, seed)
    # A row without a mark is taken once.
    folder = places.mark(decided.filter("copies <> 1").select(places.FILE, places.ROW, "copies"), name="copies")
    files.drop(decided)

    def run(batch, table, lo, hi):
        copies = np.ones(batch.num_rows, np.int64)
        if table is not None:
            at = np.flatnonzero(hi > lo)
            copies[at] = table.column(1).to_numpy()[lo[at]]
        for k in range(max(1, int(copies.max()))):  # never more than one batch of rows at a time
            more = batch.filter(pa.array(copies > k))
            if more.num_rows:
                yield more

    return places.beside(docs, [docs[c] for c in docs.columns], folder, run, docs.schema)
