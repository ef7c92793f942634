"""The store's everyday verbs on a command line: python -m memspark ROOT VERB .."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from memspark.engine import Engine


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="memspark")
    parser.add_argument("root")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("remember", "search", "context", "about", "proactive"):
        verb = verbs.add_parser(name)
        verb.add_argument("text", nargs="?")
        verb.add_argument("--scope", default="global" if name == "remember" else None)
    for name in ("forget", "erase", "approve", "reject"):
        verbs.add_parser(name).add_argument("id")
    for name in ("ingest", "repo", "seed", "export", "share", "import-share", "merge", "merge-replica"):
        verb = verbs.add_parser(name)
        verb.add_argument("path")
        verb.add_argument("--scope", default="global")
    for name in ("list", "conflicts", "review", "changes", "stats", "analytics", "log", "audit", "maintain", "purge", "sleep", "incoming"):
        verbs.add_parser(name)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, a.root)
    one = lambda: spark.createDataFrame([(0, a.text, a.scope)], "qid long, text string, scope string")
    ids = lambda: spark.createDataFrame([(a.id,)], "id string")
    run = {
        "remember": lambda: engine.remember(spark.createDataFrame([(0, a.scope, a.text)], "seq long, scope string, text string")),
        "search": lambda: engine.recall(one()).select("place", "id", "score", "content").orderBy("place"), "context": lambda: engine.context(one()).select("context"),
        "about": lambda: engine.about(one())[0].orderBy("place"), "proactive": lambda: engine.proactive(one()).select("id", "score", "content"),
        "forget": lambda: engine.forget(ids()), "erase": lambda: engine.erase(ids()), "approve": lambda: engine.approve(ids()), "reject": lambda: engine.reject(ids()),
        "ingest": lambda: engine.ingest_dir(a.path, a.scope), "export": lambda: engine.export(a.path), "share": lambda: engine.share(a.path, a.scope),
        "import-share": lambda: engine.import_share(a.path), "merge": lambda: engine.merge(a.path), "list": engine.listed, "conflicts": engine.conflicts, "review": engine.review_queue,
        "changes": engine.changes, "stats": engine.stats, "analytics": engine.analytics, "log": engine.history, "audit": engine.audit_log, "repo": lambda: engine.ingest_repo(a.path, a.scope), "merge-replica": lambda: engine.merge_replica(a.path),
        "seed": lambda: engine.seed_demo(spark.read.schema("seq long, scope string, text string").json(a.path), spark.createDataFrame([], "a long, b long")),
        "maintain": engine.maintain, "purge": engine.purge, "sleep": engine.sleep, "incoming": engine.review_incoming,
    }
    out = run[a.verb]()
    if hasattr(out, "show"):
        out.show(100, truncate=120)


if __name__ == "__main__":
    main(sys.argv[1:])
