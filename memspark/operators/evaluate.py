"""Retrieval quality."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.session import few, saved

#: Bytes of gold texts that one pass over the documents is matched with.
GOLD_BYTES = 1 << 20


def matches(found: Column, gold: Column) -> Column:
    """Equal, or one inside the other, ignoring case and outer blanks."""
    a, b = F.lower(F.trim(found)), F.lower(F.trim(gold))
    return a.contains(b) | b.contains(a)


def containing(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, item_id where matches() holds between docs (doc_id, text) and gold (item_id, text).

    One automaton over the gold texts finds those inside a document in one pass over it. For the other
    way, a document goes through the gold texts only if its first characters occur in one. Gold beyond
    ``GOLD_BYTES`` takes further passes. Empty texts are inside every other.
    """
    norm = F.lower(F.trim("text")).alias("text")
    spark, out = docs.sparkSession, None
    wanted = saved(gold.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), norm), "gold")
    parts = max(1, -(-(wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GOLD_BYTES))
    for p in range(parts):
        got = (wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)).toArrow()
        held = spark.sparkContext.broadcast((got["item_id"].to_pylist(), got["text"].to_pylist()))

        def run(batches, held=held):
            import ahocorasick

            ids, texts = held.value
            same: dict[str, list[int]] = {}
            for i, t in zip(ids, texts, strict=True):
                same.setdefault(t, []).append(i)
            machine, every = ahocorasick.Automaton(), same.pop("", [])
            for t in same:
                machine.add_word(t, t)
            if same:
                machine.make_automaton()
            width, longest = 8, max(map(len, same), default=0)
            starts = {t[k : k + width] for t in same for k in range(len(t))}
            for batch in batches:
                doc, item = [], []
                for d, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = {t for _, t in machine.iter(low)} if same and low else set()
                    if len(low) <= longest and any(x.startswith(low) for x in starts) if len(low) < width else low[:width] in starts and len(low) <= longest:
                        found |= {t for t in same if low in t}
                    hits = [i for t in found for i in same[t]] + every
                    doc += [d] * len(hits)
                    item += hits
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "item_id": pa.array(item, pa.int64())})

        found = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), norm).mapInArrow(run, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """a, b, sim: pairs of sets (id, words) whose Jaccard similarity is large enough.

    Words are put in order from the rarest up; two sets that similar share one of the first few, so only
    those meet, and a set's common words bring it together with nobody.
    """
    words = sets.filter(F.size("words") > 0).select("id", F.array_distinct("words").alias("words"))
    each = words.select("id", F.explode("words").alias("word"))
    rare = saved(each.join(each.groupBy("word").agg(F.count("*").alias("n")), "word"), "words")
    lists = saved(rare.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words")), "sets")
    head = F.slice("words", F.lit(1), (F.size("words") - F.ceil(F.lit(least - 1e-9) * F.size("words")) + 1).cast("int"))
    heads = lists.select("id", F.explode(head).alias("word"))
    pairs = heads.withColumnRenamed("id", "a").join(heads.withColumnRenamed("id", "b"), "word").filter("a < b").select("a", "b").distinct()
    side = lambda n: lists.select(F.col("id").alias(n), F.col("words").alias(f"w{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("sim", ft.jaccard(F.col("wa"), F.col("wb")))
    return both.filter(F.col("sim") >= least).select("a", "b", "sim")


def at_k(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """qid, precision, recall, rr over ranked (qid, rank from 0, content) and gold (qid, gold_id, text)."""
    top = ranked.filter(F.col("rank") < k)
    hit = top.join(gold, "qid", "left").withColumn("ok", F.coalesce(matches(F.col("content"), F.col("text")), F.lit(False)))
    per = hit.groupBy("qid").agg(
        F.count_distinct(F.when(F.col("ok"), F.col("rank"))).alias("good"), F.count_distinct("rank").alias("shown"),
        F.count_distinct(F.when(F.col("ok"), F.col("gold_id"))).alias("found"), F.min(F.when(F.col("ok"), F.col("rank"))).alias("first"),
    )
    wanted = gold.groupBy("qid").agg(F.count_distinct("gold_id").alias("wanted"))
    both = wanted.join(per, "qid", "left").fillna(0, ["good", "shown", "found"])
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return both.select("qid", F.round(F.col("good") / one("shown"), 6).alias("precision"), F.round(F.col("found") / one("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 6).alias("rr"))


def nearest_rank(values: DataFrame, column: str, group: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Percentiles by nearest rank: the value at round(p / 100 * (n - 1)) in order. Null values don't count.

    Counts per value are written in ranges of values; the ranges' sums tell which holds a percentile, and
    only those are looked through. A group of all rows is as many ranges as there are tasks.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(group).alias("g"), F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranges = saved(counts.repartitionByRange("g", "v").sortWithinPartitions("g", "v"), "ranges")
    part = F.regexp_extract(ranges.metadataColumn("_metadata")["file_name"], r"^part-(\d+)", 1).cast("long").alias("part")
    placed = ranges.select("g", "v", "c", part)
    sums = placed.groupBy("g", "part").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy("g")  # a row for each range of the group
    upto = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumns({"upto": upto, "n": F.sum("c").over(whole)})
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.bround(F.lit(p / 100) * (F.col("n") - 1)).alias("rank")) for p in percents]))
    wanted = sums.withColumn("x", wanted).select("g", "part", F.col("x.p").alias("p"), "x.rank", (F.col("upto") - F.col("c")).alias("before"), "upto")
    wanted = saved(wanted.filter("rank >= before and rank < upto").drop("upto"), "wanted")
    held = wanted.select(F.col("g").alias("_g"), F.col("part").alias("_part"), "before").distinct()
    near = placed.join(few(held), F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))
    within = F.sum("c").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # of one range
    near = near.select("g", "part", "v", (F.col("before") + within - F.col("c")).alias("from"), (F.col("before") + within).alias("to"))
    asked = wanted.select(F.col("g").alias("_g"), F.col("part").alias("_part"), "p", "rank")
    hit = near.join(few(asked), F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    return hit.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def capabilities(memories: DataFrame, planted: DataFrame, stale: DataFrame) -> DataFrame:
    """name, rate, n: how often what should hold does.

    ``memories`` are those that a store kept of texts with secrets and personal data. ``planted`` (kind,
    text) has the personal data that must be in none of them. ``stale`` (should, flagged) tells of facts
    whether they had to be flagged and were. ``conflict`` of memories counts as handled if the pair is
    flagged or one is superseded; see ``conflict_rate``.
    """
    m = memories.filter("status = 'active' and not coalesce(hub, false)")
    open_ = (F.size(ft.secret_kinds(F.col("content"))) > 0) | (F.size(ft.high_entropy(F.col("content"))) > 0)
    rate = lambda df, name, ok: df.agg(F.round(F.avg(ok.cast("double")), 3).alias("rate"), F.count("*").alias("n")).select(F.lit(name).alias("name"), "rate", "n")
    out = rate(m, "secret_block", ~open_)
    number = lambda c: F.xxhash64(c)
    pairs = containing(m.select(number("id").alias("doc_id"), F.col("content").alias("text")), planted.filter("text <> ''").select(number("text").alias("item_id"), "text"))
    held = pairs.join(m.select("id", number("id").alias("doc_id"), "content"), "doc_id").join(planted.select(number("text").alias("item_id"), "text"), "item_id")
    leaky = held.filter(F.lower("content").contains(F.lower(F.trim("text")))).select("id").distinct().withColumn("leak", F.lit(True))
    out = out.unionByName(rate(m.select("id").join(leaky, "id", "left"), "pii_block", F.col("leak").isNull()))
    return out.unionByName(rate(stale, "stale_catch", F.col("should") == F.col("flagged")))


def conflict_rate(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """name, rate, n: of contradicting pairs (a, b, ids) those that are flagged on both sides, or of which one is closed."""
    side = lambda n: memories.select(F.col("id").alias(n), F.col("conflict").alias(f"{n}_flag"), F.col("status").alias(f"{n}_status"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    ok = (F.col("a_flag") & F.col("b_flag")) | (F.col("a_status") == "superseded") | (F.col("b_status") == "superseded")
    return both.agg(F.round(F.avg(ok.cast("double")), 3).alias("rate"), F.count("*").alias("n")).select(F.lit("conflict_handling").alias("name"), "rate", "n")


def benchmark(memories: DataFrame, edges: DataFrame | None, questions: DataFrame, gold: DataFrame, now, k: int = 5) -> DataFrame:
    """qid, precision, recall, rr: how well recall answers questions (qid, text, scope) from memories with vectors.

    ``gold`` (qid, gold_id, text) tells what an answer has to hold.
    """
    from memspark.operators import retrieve

    asked = questions.select("qid", "text", "scope").withColumn("vec", ft.hash_embed(F.coalesce("text", F.lit(""))))
    none = memories.sparkSession.createDataFrame([], "from_id string, to_id string")
    hits = retrieve.recall(asked, memories, none if edges is None else edges, now, k)
    return at_k(hits.select("qid", F.col("place").alias("rank"), "content"), gold, k)
