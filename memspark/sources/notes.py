"""Text sources: notes and repositories become facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as ft
from memspark.session import file_system

# Files, substrings and dependencies that tell a fact about a repository.
TOOLING = [
    ("pyproject.toml", "", "This project is written in Python."),
    ("pyproject.toml", "[tool.ruff", "This project uses ruff for linting."),
    ("pyproject.toml", "[tool.black", "This project uses black for formatting."),
    ("pyproject.toml", "[tool.mypy", "This project uses mypy for type checking."),
    ("pyproject.toml", "pytest", "This project uses pytest for tests."),
    ("pyproject.toml", "[tool.uv", "This project is managed with uv."),
    ("package.json", "", "This project uses Node.js / JavaScript."),
    ("Cargo.toml", "", "This project is written in Rust."),
    ("go.mod", "", "This project is written in Go."),
    ("Gemfile", "", "This project is written in Ruby."),
    ("pom.xml", "", "This project uses Java/Maven."),
    ("Dockerfile", "", "This project ships a Dockerfile."),
]
DEPENDENCIES = [
    ("typescript", "This project uses TypeScript."),
    ("react", "This project uses React."),
    ("vue", "This project uses Vue."),
    ("eslint", "This project uses ESLint for linting."),
    ("prettier", "This project uses Prettier for formatting."),
    ("vitest", "This project uses Vitest for tests."),
]
# Where guides and owners are looked for, in order.
CONTRIBUTING = ["CONTRIBUTING.md", ".github/CONTRIBUTING.md", "AGENTS.md", "CLAUDE.md"]
OWNERS = ["CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS"]


def read_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """path, text of files below a folder that match a pattern; a byte order mark is dropped."""
    found = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return found.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def slices(notes: DataFrame, text: str = "text") -> DataFrame:
    """Candidate lines of notes: no headers, rules, blank or fenced lines; bullets stripped; three words or more.

    A line is fenced if an odd number of fence marks stands before it in its note.
    """
    keys = [c for c in notes.columns if c != text]
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s﻿]+|\s+$", ""), "^﻿", ""))
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("kept"))

    def step(s, line):
        fence = line.startswith("```")
        bare = F.trim(F.regexp_replace(line, r"^([-*+]|\d+[.)])\s+", ""))
        plain = ~s["fenced"] & (line != "") & ~line.startswith("#") & ~line.rlike(r"^[-=*_]+$") & (ft.n_words(bare) >= 3)
        return F.when(fence, F.struct((~s["fenced"]).alias("fenced"), s["kept"].alias("kept"))).otherwise(
            F.struct(s["fenced"].alias("fenced"), F.when(plain, F.concat(s["kept"], F.array(bare))).otherwise(s["kept"]).alias("kept"))
        )

    return notes.select(*keys, F.posexplode(F.aggregate(lines, start, step)["kept"]).alias("slice", "text"))


def extract(slices_: DataFrame, force: bool = True, cutoff: float = 0.75, text: str = "text") -> DataFrame:
    """Typed candidate facts of each slice: its sentences, or the slice as a whole if none is long enough.

    Without force only sentences pass whose gate reaches the cutoff.
    """
    parts = ft.sentences(F.col(text))
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(text)) if force else parts)
    each = slices_.select(*[c for c in slices_.columns if c != text], F.posexplode(whole).alias("part", "content"))
    gate = ft.gate(F.col("content"))
    each = each.withColumn("gate", F.round(gate, 6)).withColumn("type", ft.infer_type(F.col("content")))
    each = each if force else each.filter(F.col("gate") >= cutoff)
    confidence = F.lit(0.6) if force else F.lit(0.5) + 0.3 * F.col("gate")
    return each.withColumn("importance", ft.importance(F.col("type"), F.col("gate"))).withColumn("confidence", F.round(confidence, 6))


def repository_facts(files: DataFrame) -> DataFrame:
    """root, fact for repositories given as files (root, path within it, text)."""
    rules = [F.when((F.col("path") == p) & F.col("text").contains(s), F.lit(f)) for p, s, f in TOOLING]
    deps = F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")])
    names = F.map_keys(F.when(F.col("path") == "package.json", deps))
    rules += [F.when(F.array_contains(names, n), F.lit(f)) for n, f in DEPENDENCIES]
    rules.append(F.when(F.col("path") == "uv.lock", F.lit("This project is managed with uv.")))
    rules.append(F.when(F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$"), F.lit("CI runs via GitHub Actions.")))
    facts = files.select("root", F.explode(F.array_compact(F.array(*rules))).alias("fact")).distinct()
    rank = F.array_position(F.array(*[F.lit(o) for o in OWNERS]), F.col("path"))
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.trim(x).startswith("#"))
    named = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.regexp_replace(F.trim(x), r"^\S+", ""), F.lit(r"(?:^|\s)(@\S+)"), F.lit(1))))
    owners = files.filter(rank > 0).select("root", rank.alias("rank"), F.array_sort(F.array_distinct(named)).alias("owners")).filter(F.size("owners") > 0)
    first = owners.groupBy("root").agg(F.min_by("owners", "rank").alias("owners"))
    return facts.unionByName(first.select("root", F.concat(F.lit("Code ownership (CODEOWNERS): "), F.concat_ws(", ", F.slice("owners", 1, 6)), F.lit(".")).alias("fact")))


def read_repo(spark: SparkSession, root: str) -> DataFrame:
    """path, text of what a repository's folder tells: facts of its tooling and owners, and the lines of its guide for contributors."""
    fs, top = file_system(spark, root)
    base = fs.makeQualified(top).toString().rstrip("/")
    wanted = sorted({p for p, _, _ in TOOLING} | {"package.json", "uv.lock", *OWNERS, *CONTRIBUTING})
    found = [f"{base}/{p}" for p in wanted if fs.exists(file_system(spark, f"{base}/{p}")[1])]
    flows = file_system(spark, f"{base}/.github/workflows")[1]
    found += [s.getPath().toString() for s in fs.listStatus(flows) if s.isFile()] if fs.exists(flows) else []
    if not found:
        return spark.createDataFrame([], "path string, text string")
    text = spark.read.option("wholetext", "true").text(found)
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    inside = F.split(at, re.escape(base.removeprefix("file:")) + "/", 2)[1]
    files = text.select(F.lit(root).alias("root"), inside.alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    guide = files.join(contributing(files), ["root", "path"]).select("path", "text")
    return repository_facts(files).select(F.lit("").alias("path"), F.col("fact").alias("text")).unionByName(slices(guide).select("path", "text"))


def contributing(files: DataFrame) -> DataFrame:
    """root, path of each repository's guide for contributors, by preference."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CONTRIBUTING]), F.col("path"))
    return files.filter(rank > 0).groupBy("root").agg(F.min_by("path", rank).alias("path"))


def parse_model_facts(replies: DataFrame, types: list[str], column: str = "raw") -> DataFrame:
    """Facts of a model's JSON replies; unknown types become facts, scores are clamped, broken replies give none."""
    shape = "array<struct<type:string,content:string,importance:double>>"
    facts = F.coalesce(F.from_json(F.get_json_object(column, "$.facts"), shape), F.array().cast(shape))
    each = replies.select(*[c for c in replies.columns if c != column], F.posexplode(facts).alias("n", "f"))
    kind = F.when(F.col("f.type").isin(*types), F.col("f.type")).otherwise(F.lit("fact"))
    importance = F.least(F.greatest(F.coalesce(F.col("f.importance"), F.lit(0.6)), F.lit(0.0)), F.lit(1.0))
    each = each.filter(F.length(F.trim(F.coalesce("f.content", F.lit("")))) > 0)
    return each.select(*[c for c in each.columns if c != "f"], kind.alias("type"), F.col("f.content").alias("content"), importance.alias("importance"), F.lit(0.7).alias("confidence"))


def markdown(memories: DataFrame) -> DataFrame:
    """section, place, line: memories as lines of Markdown, by scope and type; each section is headed by its scope.

    Lines come one by one, ordered by (section, place), so no scope is too large; see ``write_markdown``.
    """
    line = F.concat(F.lit("- **"), F.col("type"), F.lit("**: "), F.col("content"))
    rows = memories.select(F.col("scope").alias("section"), F.concat(F.lit("1"), F.col("type"), F.lit(" "), F.col("id")).alias("place"), line.alias("line"))
    head = memories.select(F.col("scope").alias("section")).distinct().select("section", F.lit("0").alias("place"), F.concat(F.lit("## "), F.col("section")).alias("line"))
    return rows.unionByName(head)


def write_markdown(memories: DataFrame, path: str) -> None:
    """markdown() as text files that follow one another in order."""
    lines = markdown(memories)
    ordered = lines.repartitionByRange("section", "place").sortWithinPartitions("section", "place")
    ordered.select(F.when(F.col("place") == "0", F.concat(F.lit("\n"), F.col("line"), F.lit("\n"))).otherwise(F.col("line")).alias("value")).write.mode("overwrite").text(path)
