"""The write path: candidates meet what is known, in order, and change it.

Each candidate is decided against the nearest memory in its sight (its scope and the global one) as all
earlier candidates have left it: a near copy is a NOOP, the same subject an UPDATE or, where the text
contradicts, a SUPERSEDE, all else an ADD, in conflict if it contradicts something close.

Only memories and candidates at least ``GRAY`` similar bear on a decision, so candidates fall into
clusters that know nothing of each other: those that are that near to one another, in each other's sight, or
share a memory that near. Who is near is found by a join of tiles; clusters by labels that spread along what
it links. They fold side by side, each streaming through one task in order; a task holds the memories of
one cluster, not its candidates.

A candidate knows its ``KNOWN`` nearest memories. Where earlier candidates have changed all of those,
a further one could be nearer than what is left; the cluster stops there, and what is left of it
goes through another round, on the memories as they are by then.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.functions import tiles
from memspark.operators import graph, lifecycle
from memspark.operators.lifecycle import BUMP, DUPLICATE, GRAY, UPDATE
from memspark.schema import GLOBAL, cognitive_of, complete, provenance
from memspark.session import few, numbered, saved
from memspark.sources.notes import extract

KNOWN = 8
_NEGATION = re.compile(ft.NEGATION_CUE, re.IGNORECASE)
DECISIONS = "seq long, op string, id string, near_id string, sim double, conflict boolean"
#: (existing content, new content) -> duplicate, update, contradict, distinct, or None where it can't tell.
Adjudicator = Callable[[str, str], str | None]


def _clusters(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """seq, label: the smallest seq of each candidate's cluster. known has seq and id of near memories.

    Similar candidates are found once; then only labels move, along links and through memories.
    """
    links = tiles.linked(candidates.select("seq", "scope", "vec"), GRAY)
    ways = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(candidates.select("seq", F.col("seq").alias("label")), "labels")
    while True:
        near = ways.join(labels.withColumnRenamed("seq", "b"), "b").groupBy(F.col("a").alias("seq")).agg(F.min("label").alias("near"))
        held = known.join(labels, "seq")
        by_memory = held.groupBy("id").agg(F.min("label").alias("least"))
        through = held.join(by_memory, "id").groupBy("seq").agg(F.min("least").alias("through"))
        low = labels.join(near, "seq", "left").join(through, "seq", "left").select("seq", "label", F.least("label", "near", "through").alias("low"))
        low = saved(low, "low")
        further = low.select(F.col("seq").alias("low"), F.col("low").alias("jump"))
        new = saved(low.join(further, "low").select("seq", F.least("low", "jump").alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("seq", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels


class _Cluster:
    """The memories of a cluster while its candidates stream past."""

    def __init__(self):
        self.ids, self.scopes, self.types, self.texts, self.untouched = [], [], [], [], []
        self.stopped, self._codes = False, {GLOBAL: 0}
        self._matrix, self._sight = np.zeros((0, 0)), np.zeros(0, int)  # room for more rows than there are; a code is -1 once closed

    def add(self, i: str, scope: str, kind: str, text: str, vec, known: bool) -> None:
        n = len(self.ids)
        if n == len(self._sight):
            matrix, sight = np.zeros((max(8, 2 * n), len(vec))), np.zeros(max(8, 2 * n), int)
            if n:
                matrix[:n], sight[:n] = self._matrix, self._sight
            self._matrix, self._sight = matrix, sight
        self._matrix[n], self._sight[n] = vec, self._codes.setdefault(scope, len(self._codes))
        self.ids.append(i), self.scopes.append(scope), self.types.append(kind), self.texts.append(text), self.untouched.append(known)

    def change(self, at: int, text: str, vec) -> None:
        self.texts[at], self._matrix[at], self.untouched[at] = text, vec, False

    def close(self, at: int) -> None:
        self._sight[at] = -1

    def nearest(self, scope: str, vec: np.ndarray) -> tuple[int | None, float]:
        codes = self._sight[: len(self.ids)]
        seen = np.flatnonzero((codes == 0) | (codes == self._codes.get(scope, 0)))
        if not len(seen):
            return None, 0.0
        sims = np.round(self._matrix[: len(codes)] @ vec, 6)[seen]
        top = seen[sims == sims.max()]
        return int(min(top, key=lambda k: self.ids[k])), float(sims.max())


def _decide(c: _Cluster, r: dict, adjudicate: Adjudicator | None) -> tuple | None:
    """One candidate's decision, applied to the cluster; None where a memory that isn't known may be nearer."""
    if r["vec"] is None:  # it meets nobody, and nobody meets it
        return "ADD", r["id"], None, 0.0, False
    vec = np.array(r["vec"], float)
    best, sim = c.nearest(r["scope"], vec)
    if r["floor"] is not None and not (best is not None and (sim > r["floor"] or (sim == r["floor"] and c.untouched[best]))):
        return None
    near, sim = (c.ids[best], sim) if best is not None and sim >= GRAY else (None, 0.0)  # what is further off isn't known of
    same = near is not None and c.types[best] == r["type"]
    against = r["type"] == "identity" or bool(_NEGATION.search(r["content"]))
    verdict = adjudicate(c.texts[best], r["content"]) if adjudicate and same and GRAY <= sim < DUPLICATE else None
    if same and (sim >= DUPLICATE or verdict == "duplicate"):
        return "NOOP", near, near, sim, False
    if verdict == "distinct":
        op = "ADD"
    elif verdict in ("contradict", "update"):
        op = "SUPERSEDE" if verdict == "contradict" else "UPDATE"
    else:
        op = "ADD" if not same or sim < UPDATE else "SUPERSEDE" if against else "UPDATE"
    if op == "UPDATE":
        if len(r["content"]) > len(c.texts[best]):
            c.change(best, r["content"], vec)
        return op, near, near, sim, False
    if op == "SUPERSEDE":
        c.close(best)
    c.add(r["id"], r["scope"], r["type"], r["content"], vec, False)
    return op, r["id"], near, sim, op == "ADD" and verdict is None and same and sim >= GRAY and against


def _round(candidates: DataFrame, memories: DataFrame, adjudicate: Adjudicator | None) -> DataFrame:
    """DECISIONS of the candidates; op is null for those that another round has to decide."""
    asked = candidates.select(F.col("seq").alias("qid"), "vec", "scope")
    known = saved(tiles.best(asked, memories, KNOWN, GRAY).withColumnRenamed("qid", "seq"), "known")
    labels = saved(_clusters(candidates, known.select("seq", "id")), "clusters")
    # The least similarity known of, where the list is full and further memories may follow.
    floor = known.groupBy("seq").agg(F.when(F.count("*") >= KNOWN, F.min("sim")).alias("floor"))
    columns = ["label", "seq", "id", "scope", "type", "content", F.col("vec").cast("array<double>").alias("vec"), "floor"]
    new = candidates.join(labels, "seq").join(floor, "seq", "left").select(*columns)
    inside = known.join(labels, "seq").select("label", "id").distinct()
    old = memories.join(inside, "id").select("label", F.lit(None).cast("long").alias("seq"), *columns[2:-1], F.lit(None).cast("double").alias("floor"))
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = old.unionByName(new).repartition(n, "label").sortWithinPartitions("label", F.col("seq").asc_nulls_first(), "id")

    def run(batches):
        label, cluster = None, _Cluster()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["label"] != label:
                    label, cluster = r["label"], _Cluster()
                if r["seq"] is None:
                    cluster.add(r["id"], r["scope"], r["type"], r["content"] or "", r["vec"], True)
                    continue
                r["content"] = r["content"] or ""
                got = None if cluster.stopped else _decide(cluster, r, adjudicate)
                cluster.stopped = got is None
                out.append((r["seq"], *(got or (None, None, None, None, None))))
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
                names = [c.split()[0] for c in DECISIONS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, DECISIONS)


def decisions(candidates: DataFrame, memories: DataFrame, adjudicate: Adjudicator | None = None) -> DataFrame:
    """DECISIONS of candidates (seq, id, scope, type, content, vec) against active memories, in the order of seq.

    A candidate without vector is an ADD.

    id is the memory that the candidate became or went into, near_id and sim the nearest it met, null and 0
    where nothing was at least ``GRAY`` similar.
    """
    state = saved(memories.select("id", "scope", "type", "content", F.col("vec").cast("array<double>").alias("vec")), "state")
    left, done = saved(candidates.select("seq", "id", "scope", "type", "content", F.col("vec").cast("array<double>").alias("vec")), "candidates"), None
    while True:
        got = saved(_round(left, state, adjudicate), "decisions")
        settled = got.filter("op is not null")
        done = settled if done is None else done.unionByName(settled)
        rest = got.filter("op is null").select("seq")
        if not rest.limit(1).count():
            return done
        state = saved(_after(state, left, settled), "state")
        left = saved(left.join(rest, "seq", "left_semi"), "candidates")


def _longest(rows: DataFrame) -> DataFrame:
    """id, new_content, new_vec: of the updates of each memory the longest content, of equal ones the first."""
    first = F.struct(F.length("content"), -F.col("seq"))
    return rows.groupBy("id").agg(F.max_by(F.struct("content", "vec"), first).alias("x")).select("id", F.col("x.content").alias("new_content"), F.col("x.vec").alias("new_vec"))


def _after(state: DataFrame, candidates: DataFrame, made: DataFrame) -> DataFrame:
    """The memories that later candidates can meet."""
    by_seq = candidates.withColumnRenamed("id", "own").join(made.select("seq", "op", "id", "near_id"), "seq")
    fresh = by_seq.filter("op in ('ADD', 'SUPERSEDE')").select("id", "scope", "type", "content", "vec")
    closed = made.filter("op = 'SUPERSEDE'").select(F.col("near_id").alias("id")).distinct()
    all_ = state.unionByName(fresh).join(closed, "id", "left_anti").join(_longest(by_seq.filter("op = 'UPDATE'")), "id", "left")
    longer = F.length("new_content") > F.length("content")
    return all_.select("id", "scope", "type", F.when(longer, F.col("new_content")).otherwise(F.col("content")).alias("content"), F.when(longer, F.col("new_vec")).otherwise(F.col("vec")).alias("vec"))


def apply(memories: DataFrame, edges: DataFrame, candidates: DataFrame, made: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What decisions leave: memories, and of them those that are new or changed, edges, and history (seq, op, memory_id, detail).

    NOOP and UPDATE reinforce a memory, add to its confidence and provenance; an UPDATE keeps the longer
    content, with its vector, the larger importance, and adds attributes, later ones first. A SUPERSEDE
    closes the old memory and flags what mentions the subjects it dropped. Both sides of a conflict are
    flagged. Equal provenance counts once. Whether something is stale is judged on what the batch leaves.
    """
    cand = complete(candidates, "seq").drop("conflict")
    by_seq = saved(cand.withColumnRenamed("id", "own").join(made.select("seq", "op", "id", "near_id", "sim", "conflict"), "seq"), "applied")
    fresh = by_seq.filter("op in ('ADD', 'SUPERSEDE')")
    for name in ("valid_from", "recorded_at", "created_at", "updated_at", "last_seen_at"):
        fresh = fresh.withColumn(name, now)
    for name in ("valid_to", "stale_reason"):
        fresh = fresh.withColumn(name, F.lit(None))
    fresh = complete(fresh.withColumn("status", F.lit("active")).withColumn("reinforced", F.lit(0.0)))
    all_ = complete(memories).unionByName(fresh)
    # Only what decisions name changes, and is written; the rest is read as it is.
    own = by_seq.select("id").unionByName(by_seq.filter("op = 'SUPERSEDE' or conflict").select(F.col("near_id").alias("id"))).distinct()
    own = few(saved(own, "ids"))
    mine = all_.join(own, "id", "left_semi")

    touch = by_seq.filter("op in ('NOOP', 'UPDATE')")
    per = touch.groupBy("id").agg(F.count("*").alias("n"), F.max(F.when(F.col("op") == "UPDATE", F.col("importance"))).alias("new_importance"))
    each = touch.select("id", "seq", F.posexplode("provenance").alias("at", "p")).groupBy("id", "p").agg(F.min(F.struct("seq", "at")).alias("first"))
    said = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "p"))), lambda x: x["p"]).alias("more"))
    named = touch.filter("op = 'UPDATE'").select("id", "seq", F.explode("attributes").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    named = named.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new_attributes"))
    closed = by_seq.filter("op = 'SUPERSEDE'").select(F.col("near_id").alias("id")).distinct().withColumn("closed", F.lit(True))
    torn = by_seq.filter("conflict").select(F.explode(F.array("id", "near_id")).alias("id")).distinct().withColumn("torn", F.lit(True))
    x = mine.join(per, "id", "left").join(said, "id", "left").join(named, "id", "left").join(_longest(touch.filter("op = 'UPDATE'")), "id", "left").join(closed, "id", "left").join(torn, "id", "left")
    n, longer, gone = F.coalesce("n", F.lit(0)), F.coalesce(F.length("new_content") > F.length("content"), F.lit(False)), F.coalesce("closed", F.lit(False))
    x = x.withColumns({
        **{c: F.when(~longer, F.col(c)) for c in ("sig", "signer", "sig_scheme")},  # another content is not what was signed
        "vec": F.when(longer, F.col("new_vec")).otherwise(F.col("vec")), "content": F.when(longer, F.col("new_content")).otherwise(F.col("content")),
        "importance": F.greatest("importance", "new_importance"), "confidence": F.when(n > 0, F.least(F.col("confidence") + BUMP * n, F.lit(1.0))).otherwise(F.col("confidence")),
        "reinforced": F.coalesce("reinforced", F.lit(0.0)) + n, "last_seen_at": F.when(n > 0, now).otherwise(F.col("last_seen_at")),
        "provenance": F.concat("provenance", F.array_except(F.coalesce("more", F.array().cast(all_.schema["provenance"].dataType)), "provenance")),
        "attributes": F.when(F.col("new_attributes").isNull(), F.col("attributes")).otherwise(F.map_concat(F.map_filter("attributes", lambda k, _: ~F.map_contains_key("new_attributes", k)), "new_attributes")),
        "updated_at": F.when((n > 0) | gone, now).otherwise(F.col("updated_at")), "valid_to": F.when(gone, now).otherwise(F.col("valid_to")),
        "status": F.when(gone, F.lit("superseded")).otherwise(F.col("status")), "conflict": F.coalesce("conflict", F.lit(False)) | F.coalesce("torn", F.lit(False)),
    })
    mine = saved(x.select(*all_.columns), "changed")
    x = all_.join(own, "id", "left_anti").select(*all_.columns).unionByName(mine)

    old = x.select(F.col("id").alias("old_id"), F.col("scope").alias("old_scope"), F.col("content").alias("old_content"))
    replaced = by_seq.filter("op = 'SUPERSEDE'").select("seq", F.col("near_id").alias("old_id"), F.col("content").alias("new_content"), F.col("id").alias("new_id")).join(old, "old_id")
    flags = lifecycle.stale_dependents(replaced.select(F.col("old_scope").alias("scope"), "old_id", "old_content", "new_content"), x.filter(~F.col("hub") & ~F.coalesce("stale", F.lit(False))))
    flags = flags.join(replaced.select("old_id", "seq", "new_id"), "old_id").filter(F.col("id") != F.col("new_id"))
    flags = saved(flags.groupBy("id").agg(F.min_by(F.struct("reason", "old_id"), F.struct("seq", "old_id")).alias("because")).select("id", F.col("because.reason").alias("why"), "because.old_id"), "stale")
    hit = F.col("why").isNotNull()
    out = x.join(few(flags.select("id", "why")), "id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | hit).withColumn("stale_reason", F.coalesce("why", "stale_reason"))
    out = out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).select(*all_.columns)
    moved = few(saved(mine.select("id").union(flags.select("id")).distinct(), "ids"))

    made_edges = by_seq.filter("op = 'SUPERSEDE'").select(*graph.edge(F.col("id"), F.col("near_id"), "supersedes"))
    made_edges = made_edges.unionByName(by_seq.filter("conflict").select(*graph.edge(F.col("id"), F.col("near_id"), "conflicts_with")))
    member = by_seq.filter(F.col("scope").startswith("project:")).select(*graph.edge(graph.hub_id(F.col("scope")), F.col("id"), "has_member")).distinct()
    made_edges = made_edges.unionByName(member)
    hubs = graph.hubs(by_seq.select("scope"), now).join(out.select("id"), "id", "left_anti")
    kept = ["id", "from_id", "to_id", "relation", "weight"]
    both = made_edges if edges is None else edges.select(*kept).unionByName(made_edges).dropDuplicates(["id"])
    detail = F.to_json(F.struct(F.when(F.col("op") != "ADD", F.round("sim", 3)).alias("sim"), F.when(F.col("op") == "ADD", F.col("type")).alias("type"), F.when(F.col("op") == "SUPERSEDE", F.col("near_id")).alias("superseded")))
    history = by_seq.select("seq", F.lower("op").alias("op"), F.col("id").alias("memory_id"), detail.alias("detail"))
    history = history.unionByName(by_seq.filter("conflict").select("seq", F.lit("conflict").alias("op"), F.col("id").alias("memory_id"), F.to_json(F.struct(F.col("near_id").alias("with"), F.round("sim", 3).alias("sim"))).alias("detail")))
    history = history.unionByName(flags.select(F.lit(None).cast("long").alias("seq"), F.lit("stale-suspect").alias("op"), F.col("id").alias("memory_id"), F.to_json(F.struct(F.col("old_id").alias("because"))).alias("detail")))
    return {"memories": out.unionByName(complete(hubs)), "changed": out.join(moved, "id", "left_semi").unionByName(complete(hubs)), "edges": both, "history": history, "decisions": made}


def consolidate(memories: DataFrame, edges: DataFrame | None, candidates: DataFrame, now: Column, adjudicate: Adjudicator | None = None) -> dict[str, DataFrame]:
    """decisions() and apply() in one."""
    seen = complete(memories).filter("status = 'active' and not hub and vec is not null")
    return apply(memories, edges, candidates, saved(decisions(candidates, seen, adjudicate), "made"), now)


def candidates_of(texts: DataFrame, now: Column, agent: str = "cli", extractor: str = "deterministic", origin: str = "user-asserted", force: bool = True) -> DataFrame:
    """Candidates of texts (seq, scope, text): redacted, extracted, scrubbed again, embedded, numbered in order."""
    clean = texts.select(F.col("seq").alias("text_seq"), "scope", ft.redact(F.col("text")).alias("text")).filter("text is not null")
    facts = extract(clean, force=force).withColumn("content", ft.redact(F.col("content")))
    facts = facts.withColumn("id", new_id(F.col("type"), F.col("content"), F.col("scope"), F.col("text_seq"), F.col("part")))
    facts = facts.withColumn("cognitive", cognitive_of(F.col("type"))).withColumn("vec", ft.hash_embed(F.col("content")))
    facts = facts.withColumn("provenance", F.array(provenance(agent, extractor, origin, at=now)))
    columns = ["text_seq", "part", "id", "type", "cognitive", "content", "scope", "importance", "confidence", "provenance", "vec"]
    return numbered(facts.select(*columns), F.col("text_seq"), F.col("part"), name="seq").drop("text_seq", "part")


def new_id(kind: Column, content: Column, *more: Column) -> Column:
    """An id that tells kind and subject; what makes it unique follows from its arguments, so reruns agree."""
    return F.concat_ws("_", F.substring(kind, 1, 4), ft.slug(content), F.substring(F.sha2(F.concat_ws("|", kind, content, *more), 256), 1, 12))


def remember(memories: DataFrame, edges: DataFrame | None, texts: DataFrame, now: Column, **how) -> dict[str, DataFrame]:
    """Texts (seq, scope, text) through the whole write path."""
    adjudicate = how.pop("adjudicate", None)
    return consolidate(memories, edges, saved(candidates_of(texts, now, **how), "candidates"), now, adjudicate)


def tally(made: DataFrame) -> DataFrame:
    """op, n over all operations, with 0 for those that didn't occur."""
    spark = made.sparkSession
    ops = spark.createDataFrame([(x,) for x in ("ADD", "UPDATE", "NOOP", "SUPERSEDE")], "op string")
    return ops.join(made.groupBy("op").agg(F.count("*").alias("n")), "op", "left").fillna(0, ["n"])
