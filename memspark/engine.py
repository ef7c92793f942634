"""A store and its verbs in one place: each reads the newest version at a root folder and publishes the next.

Verbs take tables, so one call serves one memory or millions. A verb writes the rows that it changes and
refers to the rest; what it has read is the version that it builds on, and where another writer was faster it
does its work again on the newer one. Time is the caller's, or the clock's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.operators import analytics, governance, graph, lifecycle, merge, ranges, retrieve, store, trust, write
from memspark.schema import MEMORIES, complete
from memspark.session import few, numbered, saved, ship
from memspark.sources import demo, notes, snapshots
from memspark.sources.snapshots import Change

TABLES = {
    "memories": ", ".join(f"{n} {k}" for n, (k, _) in MEMORIES.items()),
    "edges": "id string, from_id string, to_id string, relation string, weight double",
    "history": "seq long, op string, memory_id string, detail string",
    "tombstones": "fp string",
    "audit": governance.AUDIT,
    "trusted": "contributor string",
}


class _State:
    """The version that a verb builds on."""

    def __init__(self, engine: Engine, version: int):
        self.engine, self.version = engine, version

    def __call__(self, name: str) -> DataFrame:
        return self.engine.table(name, self.version)

    def some(self, ids: DataFrame) -> DataFrame:
        """The memories of these ids, written for the verb."""
        return saved(self("memories").join(few(ids.select("id").distinct()), "id", "left_semi"), "touched")

    def new(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows whose id the table hasn't."""
        return rows.join(self(name).select("id"), "id", "left_anti")

    def differing(self, new: DataFrame, name: str = "memories") -> Change:
        """How a table as it should be differs from what it is; rows are told apart by digests."""
        old = self(name)
        told = [F.to_json(F.col(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in old.schema]
        digest = F.xxhash64(*told, *[c.isNull() for c in told])
        rows = new.select(*old.columns).withColumn("_digest", digest).join(old.select("id", digest.alias("_digest")), ["id", "_digest"], "left_anti").drop("_digest")
        return Change(rows, old.select("id").join(new.select("id"), "id", "left_anti"))

    def buried(self, tombstones: DataFrame) -> Change:
        return Change(tombstones.select("fp").distinct().join(self("tombstones"), "fp", "left_anti"), key=None)

    def log(self, new: DataFrame) -> Change:
        """New entries (op, memory_id, detail) of the history, numbered on."""
        last = snapshots.rows(self.engine.spark, self.engine.root, "history", self.version)
        more = numbered(new.select("op", "memory_id", "detail"), F.col("op"), F.col("memory_id"), F.col("detail"), name="k")
        return Change(more.select((F.col("k") + last).alias("seq"), "op", "memory_id", "detail"), key=None)

    def entries(self, op: str, ids: DataFrame) -> Change:
        return self.log(ids.select(F.lit(op).alias("op"), F.col("id").alias("memory_id"), F.lit("{}").alias("detail")))

    def audit(self, action: str, ids: DataFrame, actor: str = "user") -> Change:
        stamp = ft.iso(self.engine.now).alias("ts")
        entries = ids.select(F.col("id").alias("at"), stamp, F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.col("id").alias("target"), F.lit("").alias("detail"))
        return Change(governance.append_audit(self("audit"), entries).join(self("audit").select("seq"), "seq", "left_anti"), key=None)


class Engine:
    """A store at ``root``; ``key`` signs facts and containers, ``me`` names this replica."""

    def __init__(self, spark: SparkSession, root: str, key: bytes = b"", me: str = "local", now: dt.datetime | None = None):
        ship(spark)
        self.spark, self.root, self.key, self.me, self._now = spark, root, key, me, now
        if not snapshots.versions(spark, root):
            snapshots.push({n: spark.createDataFrame([], s) for n, s in TABLES.items()}, root)

    @property
    def now(self) -> Column:
        return F.lit(self._now or dt.datetime.now()).cast("timestamp")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return snapshots.pull(self.spark, self.root, name, version)

    def _do(self, verb: Callable[[_State], dict[str, DataFrame | Change]]) -> int:
        """What a verb makes of the newest version, published on it; done again where that has moved on."""
        while True:
            state = _State(self, snapshots.versions(self.spark, self.root)[-1])
            tables = verb(state)
            try:
                return snapshots.commit(self.spark, self.root, tables, tuple(n for n in TABLES if n not in tables), state.version)
            except snapshots.Conflict:
                continue

    def _wrote(self, make: Callable[[_State], dict[str, DataFrame]], more: Callable[[_State], dict[str, Change]] = lambda _: {}) -> dict[str, DataFrame]:
        """A write path's outcome, of which rows that it changed are kept; the outcome."""
        out: dict[str, DataFrame] = {}

        def verb(t: _State) -> dict[str, Change]:
            out.clear()
            out.update(make(t))
            out["decisions"] = saved(out["decisions"], "made")
            return {"memories": Change(out["changed"]), "edges": Change(t.new("edges", out["edges"])), "history": t.log(out["history"]), **more(t)}

        self._do(verb)
        return out

    # Writing.

    def remember(self, texts: DataFrame, **how) -> DataFrame:
        """Texts (seq, scope, text) through the write path; the decisions."""
        return self._wrote(lambda t: write.remember(t("memories"), t("edges"), texts, self.now, **how))["decisions"]

    def put(self, memories: DataFrame) -> None:
        """Memories as they are, in place of those of equal id."""
        rows = complete(memories)
        self._do(lambda _: {"memories": Change(rows)})

    def ingest(self, texts: DataFrame, scope: str = "global") -> DataFrame:
        """Notes (path, text) sliced into facts; operations by kind."""
        lines = notes.slices(texts.select("path", "text"))
        rows = numbered(lines, F.col("path"), F.col("slice"), name="seq").select("seq", F.lit(scope).alias("scope"), "text")
        return write.tally(self.remember(rows, agent="ingest", origin="agent-ingested"))

    def ingest_dir(self, path: str, scope: str = "global", pattern: str = "*.md") -> DataFrame:
        return self.ingest(notes.read_files(self.spark, path, pattern), scope)

    def ingest_repo(self, path: str, scope: str = "global") -> DataFrame:
        """What the files of a repository's folder tell of it; operations by kind."""
        found = notes.read_repo(self.spark, path)
        rows = numbered(found, F.col("path"), F.col("text"), name="seq").select("seq", F.lit(scope).alias("scope"), "text")
        return write.tally(self.remember(rows, agent="repo", origin="agent-ingested"))

    def seed_demo(self, texts: DataFrame, links: DataFrame) -> DataFrame:
        """Texts (seq, scope, text), and links (a, b) between their numbers."""
        return self._wrote(lambda t: demo.seed(t("memories"), t("edges"), texts, links, self.now))["decisions"]

    def learn(self, recipes: DataFrame) -> None:
        new = saved(lifecycle.learn_procedures(recipes, self.now), "learned")
        self._do(lambda t: {"memories": Change(t.new("memories", new)), "history": t.entries("learn-procedure", new)})

    def record_outcomes(self, results: DataFrame) -> None:
        self._do(lambda t: {"memories": Change(lifecycle.record_outcomes(t.some(results), results, self.now))})

    def relate(self, pairs: DataFrame) -> None:
        """Edges for pairs (from_id, to_id, relation)."""
        new = pairs.select(*graph.edge(F.col("from_id"), F.col("to_id"), F.col("relation"))).dropDuplicates(["id"])
        self._do(lambda t: {"edges": Change(t.new("edges", new)), "history": t.entries("relate", pairs.select(F.col("from_id").alias("id")))})

    # Reading.

    def _asked(self, questions: DataFrame) -> DataFrame:
        return questions.withColumn("vec", ft.hash_embed(F.coalesce("text", F.lit(""))))

    def recall(self, questions: DataFrame, k: int = retrieve.TOP, touch: bool = False, **how) -> DataFrame:
        """Hits of questions (qid, text, scope); with ``touch`` they count as used."""
        hits = saved(retrieve.recall(self._asked(questions), self.table("memories"), self.table("edges"), self.now, k, **how), "hits")
        if touch:
            self._do(lambda t: {"memories": Change(retrieve.touch(t.some(hits), hits, self.now))})
        return hits

    def context(self, questions: DataFrame, budget: int = retrieve.BUDGET) -> DataFrame:
        return retrieve.context(self._asked(questions), self.table("memories"), self.table("edges"), self.now, budget)

    def about(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        return retrieve.about(self._asked(questions), self.table("memories"), self.table("edges"), self.now)

    def proactive(self, questions: DataFrame) -> DataFrame:
        return retrieve.proactive(self._asked(questions), self.table("memories"), self.table("edges"), self.now)

    def export_subject(self, questions: DataFrame, k: int = 200) -> DataFrame:
        return governance.subject_export(self.recall(questions, k), self.table("memories"))

    def listed(self, scope: str | None = None, limit: int = 1000) -> DataFrame:
        return store.public(store.listed(self.table("memories"), scope, limit))

    def conflicts(self) -> DataFrame:
        return graph.conflicts(self.table("edges"), self.table("memories"))

    def review_queue(self) -> DataFrame:
        return graph.review_queue(self.table("memories"), self.table("edges"))

    def changes(self, limit: int = 100) -> DataFrame:
        return graph.newest_changes(self.table("edges"), self.table("memories"), limit)

    def as_of(self, at: Column) -> DataFrame:
        return graph.as_of(self.table("memories"), at)

    def stats(self) -> DataFrame:
        return analytics.stats(*(self.table(n) for n in ("memories", "edges", "tombstones", "history")))

    def analytics(self) -> DataFrame:
        return analytics.overview(self.table("memories"), self.table("edges"), self.table("tombstones"))

    def history(self, limit: int = 100) -> DataFrame:
        return store.history(self.table("history"), limit)

    def audit_log(self, limit: int = 100) -> DataFrame:
        return governance.audit_log(self.table("audit"), limit)

    # Upkeep.

    def forget(self, ids: DataFrame) -> None:
        self._do(lambda t: {"memories": Change(lifecycle.forget(t.some(ids), ids, self.now)), "history": t.entries("forget", ids)})

    def edit(self, edits: DataFrame) -> None:
        clock = lambda t: t("memories").agg(F.coalesce(F.max("clock"), F.lit(0))).first()[0]  # noqa: E731  one column is read
        self._do(lambda t: {"memories": Change(lifecycle.edit(t.some(edits), edits, self.now, self.me, clock(t))), "history": t.entries("edit", edits)})

    def resolve_stale(self, verdicts: DataFrame) -> None:
        self._do(lambda t: {"memories": Change(lifecycle.resolve_stale(t.some(verdicts), verdicts, self.now)), "history": t.entries("review", verdicts)})

    def erase(self, ids: DataFrame) -> None:
        def verb(t: _State) -> dict[str, Change]:
            gone = saved(t.some(ids).select("id", "type", "content"), "erased")
            left = trust.erase(gone, t("edges"), ids)
            derived = saved(left["derived"], "derived")
            flagged = t.some(derived).withColumns({"stale": F.lit(True), "stale_reason": F.lit("a source fact was erased")})
            cut = t("edges").join(few(left["edges"].select("id")), "id", "left_anti").select("id")
            return {
                "memories": Change(flagged, gone.select("id")), "edges": Change(gone=cut), "tombstones": t.buried(left["tombstones"]),
                "history": t.entries("erase", ids), "audit": t.audit("erase", ids),
            }

        self._do(verb)

    def maintain(self) -> None:
        self._do(lambda t: {"memories": t.differing(lifecycle.maintain(t("memories"), self.now))})

    def purge(self, days: int = lifecycle.RETENTION_DAYS) -> None:
        def verb(t: _State) -> dict[str, Change]:
            left, buried = lifecycle.purge(t("memories"), self.now, days)
            gone = saved(t("memories").select("id").join(left.select("id"), "id", "left_anti"), "purged")
            return {"memories": Change(gone=gone), "tombstones": t.buried(buried), "audit": t.audit("purge", gone)}

        self._do(verb)

    def sleep(self) -> None:
        self._do(lambda t: {"memories": t.differing(lifecycle.promote(t("memories")))})

    def reembed(self, embed=ft.hash_embed) -> None:
        """All vectors anew; the one verb that rewrites the table."""
        self._do(lambda t: {"memories": lifecycle.reembed(t("memories"), embed)})

    # Trust and exchange.

    def propose(self, facts: DataFrame) -> None:
        made = saved(governance.propose(facts, self.now), "proposed")

        def verb(t: _State) -> dict[str, Change]:
            new = saved(t.new("memories", made), "new")
            return {"memories": Change(new), "history": t.entries("propose", new), "audit": t.audit("propose", new, "proposer")}

        self._do(verb)

    def review_incoming(self, limit: int = 100) -> DataFrame:
        return governance.review_incoming(self.table("memories"), limit)

    def approve(self, ids: DataFrame) -> None:
        self._do(lambda t: {"memories": Change(governance.approve(t.some(ids), ids, self.now)), "history": t.entries("approve-incoming", ids), "audit": t.audit("approve", ids)})

    def reject(self, ids: DataFrame) -> None:
        def verb(t: _State) -> dict[str, Change]:
            _, buried = governance.reject(t.some(ids), ids)
            return {"memories": Change(gone=ids), "tombstones": t.buried(buried), "history": t.entries("reject-incoming", ids), "audit": t.audit("reject", ids)}

        self._do(verb)

    def sign_facts(self) -> None:
        self._do(lambda t: {"memories": t.differing(governance.sign(t("memories"), self.key, self.now))})

    def verify_facts(self) -> DataFrame:
        return governance.verify(self.table("memories"), self.key)

    def verify_audit(self) -> bool:
        return not trust.chain_breaks(self.table("audit")).filter("not ok").limit(1).count()

    def trust_contributor(self, name: str) -> None:
        new = self.spark.createDataFrame([(name,)], "contributor string")
        self._do(lambda t: {"trusted": Change(new.join(t("trusted"), "contributor", "left_anti"), key=None)})

    def share(self, path: str, scope: str) -> None:
        """A scope's facts as a bundle; each is signed as it is shared, if this store has a key."""
        facts = trust.bundle(self.table("memories"), scope).drop("id")
        sig = governance.hmac(governance.payload(), self.key) if self.key else F.lit(None).cast("string")
        snapshots.write_bundle(facts.withColumns({"sig": sig, "sig_scheme": F.when(sig.isNotNull(), F.lit(governance.HMAC)), "signer": F.lit(governance.signer_of(self.key) if self.key else None)}), path, self.me)

    def import_share(self, path: str, keys: tuple[bytes, ...] = ()) -> DataFrame:
        """A bundle's facts by their verdict. ``keys`` are those of others that are known here.

        What the sender says of signatures isn't looked at: a fact counts as signed if its signer's key is
        known, and its signature holds if it follows from type and content under that key.
        """
        shape = "type string, content string, scope string, confidence double, importance double, visibility string, fingerprint string, sig string, sig_scheme string, signer string, contributor string"
        facts = governance.checked(snapshots.read_bundle(self.spark, path, shape), [self.key, *keys])
        out = self._wrote(lambda t: governance.import_share(t("memories"), t("edges"), facts, t("tombstones"), t("trusted"), self.now))
        return saved(out["verdicts"], "verdicts")

    def handoff(self, ids: DataFrame, scope: str, agent: str = "agent") -> DataFrame:
        return self._wrote(lambda t: merge.handoff(t("memories"), t("edges"), ids, scope, t("tombstones"), self.now, agent), lambda t: {"audit": t.audit("handoff", ids, agent)})["decisions"]

    def merge(self, other: str) -> DataFrame:
        """Another store's newest version merged into this one; operations by kind."""
        out = self._wrote(lambda t: snapshots.pull_merge(self.spark, other, t("memories"), t("edges"), t("tombstones"), self.now))
        return saved(out["tally"], "tally")

    def merge_replica(self, other: str, keys: tuple[bytes, ...] = ()) -> None:
        """Another replica's edits by clock: existence adds up, and of two versions the later wins.

        Facts that their signer's key, where it is known, shows to be forged are left out. Trees over ranges of
        ids tell which rows differ, and only the rows of such ranges are taken over.
        """
        def verb(t: _State) -> dict[str, Change]:
            mine = complete(t("memories"))
            sent, _ = ranges.exchange(mine.filter("not hub"), complete(snapshots.pull(self.spark, other, "memories")).filter("not hub"))
            fit = merge.without_tombstoned(sent, t("tombstones"))
            theirs = merge.without_forged(governance.checked(fit, [self.key, *keys])).select(*mine.columns)
            theirs = saved(theirs, "theirs")
            both = t.some(theirs).select(*mine.columns).unionByName(theirs)
            won = merge.last_writer(both).select("id", *[F.col(c).alias(f"_{c}") for c in ("content", "type", "scope", "clock", "replica", "importance", "confidence", "provenance")])
            ticket = F.struct("clock", "replica", "updated_at", "content", "type", "scope")
            rows = both.groupBy("id").agg(F.max_by(F.struct(*both.columns), ticket).alias("x")).select("x.*").join(won, "id")
            new = {c: F.col(f"_{c}") for c in ("importance", "confidence", "provenance")}
            return {"memories": Change(rows.withColumns(new).select(*mine.columns))}

        self._do(verb)

    def export(self, path: str) -> dict:
        return snapshots.export_container({n: self.table(n) for n in TABLES}, path, self.key, self.me)

    def import_(self, path: str) -> int:
        """Replace all tables by those of a container; the versions before stay."""
        tables = snapshots.import_container(self.spark, path, self.key)
        return self._do(lambda _: tables)

    def rollback(self, version: int) -> int:
        return snapshots.rollback(self.spark, self.root, version)
