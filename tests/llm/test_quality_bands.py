"""The bands on texts that the base rules miss, and on clean text of each language."""

from __future__ import annotations

import base64
import string
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from memspark.llm import quality

SIZES = (700, 1000, 2000, 4000, 9000, 40_000, 200_000)


def odd_texts() -> dict[tuple, str]:
    rng = np.random.default_rng(6)
    letters = list(string.ascii_letters + string.digits)
    out = {}
    for size in SIZES:
        out["words", size] = " ".join("".join(rng.choice(letters, 8)) for _ in range(size // 9))
        raw = base64.b64encode(rng.bytes(size)).decode()[:size]
        out["base64", size] = "\n".join(raw[i : i + 12] for i in range(0, size, 12))
        if size >= 2000:
            out["lines", size] = "\n".join("Item {} price {} stock {} sold {}".format(*rng.integers(0, 10**4 if size < 10**5 else 10**5, 4)) for _ in range(size // 32))
    return out


def test_bands_reject_what_the_base_rules_miss(spark):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    assert not [k for i, k in enumerate(texts) if got[i].base_failed]
    assert not [(k, got[i].ratio) for i, k in enumerate(texts) if got[i].kept]
    assert all(got[i].chunks_high == got[i].chunks for i, k in enumerate(texts) if k[0] != "lines")
    assert all(got[i].chunks_low == got[i].chunks for i, k in enumerate(texts) if k[0] == "lines")


def test_bands_leave_clean_text_of_each_language_alone(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in table], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    clean = Counter(r["lang"] for r in table if not got[r["doc_id"]].base_failed)
    assert min(clean[x] for x in ("en", "fr", "de", "es")) > 50
    assert clean == Counter(r["lang"] for r in table if got[r["doc_id"]].kept)
    # Repetitive texts of some length are out of band, whatever the base rules say.
    twice = [r for r in got.values() if r.n_words >= 50 and r.base_failed]
    b = quality.Bands()
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in table}
    assert twice and not [r for r in twice if quality.in_band(sizes[r.doc_id], r.ratio, r.chunks, r.chunks_low, r.chunks_high, b)]
