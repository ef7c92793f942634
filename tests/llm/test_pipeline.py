"""The pipeline's stages against brute force on a small folder of tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import zstandard
from test_operators import brute_components, odd_rows, vary

import corpus_pipeline
from memspark.llm import mixing, quality


def folder(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, vary(i, 120 + int(rng.integers(0, 200)), edits=i % 3, base=i % 50), "en", f"s{i % 4}", 1) for i in range(150)]
    rows += [(500, None, "en", "s0", 0), (501, "too short", "en", "s1", 9), (502, "again " * 400, "en", "s2", 9), (503, vary(9, 300, base=77), None, None, None)]
    rows += [(600 + i, vary(i, 200, base=60 + i), "en", "s1", 1) for i in range(6)]
    item = " ".join(vary(3, 200, base=63).split()[50:75])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, item


def brute_quality(text):
    w = (text or "").split()
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    if len(w) < 50 or 100 * len(hit) > 50 * len(w):
        return False
    data, bands = text.encode(), quality.Bands()
    lo, hi = [b[1:] for b in bands.whole if len(data) >= b[0]][-1]
    pack = lambda d: len(zstandard.ZstdCompressor(level=bands.level, write_content_size=True).compress(d)) / len(d)
    parts = [data[i : i + bands.chunk] for i in range(0, len(data), bands.chunk)] if len(data) > bands.chunk else []
    odd = [not bands.chunk_low <= pack(p) <= bands.chunk_high for p in parts if 2 * len(p) >= bands.chunk]
    return lo <= pack(data) <= hi and sum(odd) <= bands.chunk_share * len(odd)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _spans array<long>, _items string, shard_file string, manifest_version int, _run string, file string, row long, copies int, hub long, t long"


def test_stages_take_empty_odd_and_clashing_tables(spark, tmp_path):
    rows = [(*r[:5], [1], "i", "mine", 5, "r", "f", 2, 9, 3, 4) for r in odd_rows()]
    rows += [(300 + i, vary(i, 300, base=40 + i), *[None] * 13) for i in range(3)] + [(None, vary(1, 300, base=41), *[None] * 13)]
    spark.createDataFrame([("b", vary(2, 300, base=42))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part, table in enumerate((spark.createDataFrame(rows, ODD).repartition(3), spark.createDataFrame([], ODD))):
        docs, n = table, table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"{tmp_path}")
            last = name == "shard_documents"
            assert out.columns == table.columns + ["shard_file_", "manifest_version_"] * last, name
            out.write.parquet(f"{tmp_path}/{part}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{part}-{name}")
            assert docs.count() <= (n if name != "mix_sources" else 3 * n), name
            n = docs.count()
            if name == "decontaminate":
                clean = {r.doc_id for r in docs.collect()}
                assert clean == ({11, 13, 300, 301, None} if not part else set())
        assert {r.doc_id for r in docs.collect()} <= clean
        assert {r.shard_file for r in docs.collect()} <= {"mine", None}


def test_stages_match_brute_force(spark, tmp_path):
    rows, item = folder(spark, tmp_path)
    d = f"{tmp_path}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = [r for r in rows if brute_quality(r[1])]
    comps = brute_components([(r[0], r[1]) for r in good], corpus_pipeline.NEAR_PERCENT)
    one = {c for _, _, c in comps}
    clean = {r[0] for r in good if r[0] in one and item not in r[1]}
    want = [{r[0] for r in good}, one, clean]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, d)
        assert out.columns == columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        assert {r.doc_id for r in docs.collect()} == want[k] and docs.count() == len(want[k]), name
    assert 603 not in clean and {600, 601, 602, 604, 605} <= clean and not {500, 501, 502} & one
    said = {r.doc_id: r.copies for r in mixing.taken(docs).collect()}
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, d).collect())
    assert mixed == Counter({k: n for k, n in said.items() if n})
    final = corpus_pipeline.run(spark, d)
    assert Counter(r.doc_id for r in final.collect()) == mixed and set(columns) < set(final.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard_documents"]
