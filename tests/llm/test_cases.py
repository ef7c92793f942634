"""Hot groups, long texts, many blocks and languages, and the models in slow plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_repeats, odd_rows, rows_of, vary

from memspark.llm import decontam, files, langid, minhash, mixing, places, quality, sufdedup, tokcount, warc


def test_copies_and_hot_passages_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sufdedup, "BUCKET", 20)
    passage = vary(1, 60, base=5)
    rows = [(i, "same text " + vary(0, 70, base=6)) for i in range(500)]
    rows += [(1000 + i, f"{vary(i, 8, base=100 + i)} {passage} {vary(i, 8, base=400 + i)}") for i in range(120)]
    rows += [(2000 + i, "x" * (300 + i)) for i in range(40)] + [(3000, "ab" * 2000), (3001, "xyz " * 900), (3002, passage * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(sufdedup.removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_a_text_of_several_pieces_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    raw = rng.integers(97, 123, 2 * sufdedup.SLICE + 300_000, dtype=np.uint8).tobytes().decode()
    cut = sufdedup.SLICE
    text = raw[: cut - 150] + raw[10:400] + raw[cut:] + "q" * 5000 + raw[cut - 50 : cut + 700]
    data = text.encode()
    seen = Counter(hash(data[i : i + 200]) for i in range(len(data) - 199))
    gone = np.zeros(len(data), bool)
    for i in range(len(data) - 199):
        if seen[hash(data[i : i + 200])] > 1:
            gone[i : i + 200] = True
    got = sufdedup.removed(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert (got.n_bytes, got.n_removed) == (len(data), int(gone.sum()))
    assert got.kept_sha256 == hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def test_marks_reach_their_rows(spark, tmp_path):
    docs = spark.range(0, 5000, 1, 3).select("id", F.concat(F.lit("t"), "id").alias("text"))
    docs.write.option("maxRecordsPerFile", 700).parquet(f"{tmp_path}/d")
    docs = places.rooted(spark.read.parquet(f"{tmp_path}/d"))
    marks = docs.select(*places.place(docs), "id").filter("id % 7 = 0").withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int"))))
    folder = places.mark(marks, "n")

    def run(batch, table, lo, hi):
        import pyarrow as pa

        told = [table.column("id").to_pylist()[a:b] if b > a else [] for a, b in zip(lo, hi, strict=True)]
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "told": pa.array(told, pa.list_(pa.int64()))})

    got = places.beside(docs, [docs["id"]], folder, run, "id long, told array<long>").collect()
    assert len(got) == 5000 and all(r.told == ([r.id] * (r.id % 3 + 1) if r.id % 7 == 0 else []) for r in got)


@pytest.mark.parametrize("text", ["word " * 30, "é" * 40, "a b" + "c" * 100 + " d", ""])
def test_hashes_of_pieces_are_those_of_the_whole(monkeypatch, text):
    from memspark.llm import text as tx

    rows = [text, "", "tail " + text, "x"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offs = np.cumsum([0] + [len(r.encode()) for r in rows])
    want = tx.word_hashes(data, offs, tx.SPACELESS)
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(tx, "SLICE_BYTES", size)
        got = tx.word_hashes(data, offs, tx.SPACELESS)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize(("percent", "first", "partners"), [(85, 1, 2), (80, 4, 256)])
def test_rounds_and_chunks_lose_no_link(spark, monkeypatch, percent, first, partners):
    monkeypatch.setattr(minhash, "FIRST", first)
    monkeypatch.setattr(minhash, "PARTNERS", partners)
    rows = [(i, vary(i, 150, edits=i % 7, base=i % 3)) for i in range(90)] + [(200 + i, vary(200 + i, 150, edits=3 + i % 5, base=9)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(minhash.near_duplicates(docs, percent), "doc_id", "n_shingles", "component_id") == brute_components(rows, percent)


def slow_targets(sizes: dict) -> dict:
    """Share by weight, cut at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 * max(1, sum(sizes.values())) and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=repr):
            out[s] += share * weight[s]
            if out[s] >= 3 * sizes[s]:
                left += out[s] - 3 * sizes[s]
                out[s] = 3.0 * sizes[s]
                open_.discard(s)
    return out


def test_targets_are_where_resharing_ends(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60):
        sizes = {f"s{i}" if i else None: int(10 ** rng.uniform(0, 5)) * (i != 3) for i in range(n)}
        rows = [(s, x) for s, x in sizes.items()]
        got = mixing.targets(spark.createDataFrame(rows, "source string, size long").repartition(3)).collect()
        want = slow_targets(sizes)
        assert {r.source for r in got} == set(sizes)
        for r in got:
            assert r.target == pytest.approx(want[r.source], rel=1e-6, abs=1e-6) and r.source_size == sizes[r.source]
    many = mixing.targets(spark.range(30_000).select(F.concat(F.lit("h"), "id").alias("source"), (F.col("id") % 100 + 1).alias("size")))
    assert many.count() == 30_000 and many.agg(F.max("source_no")).first()[0] == 29_999


def test_landing_misses_no_less_than_any_rounding():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        pi, size = rng.random(n), rng.integers(1, 500, n)
        out = mixing.landing(pi, size, rng)
        least = min(abs(np.dot(x, size) - pi @ size) for x in itertools.product((0, 1), repeat=n))
        assert set(out) <= {0.0, 1.0} and abs(out @ size - pi @ size) == pytest.approx(least, abs=1e-5)


def test_a_hot_row_without_id_is_one_unit(spark):
    docs = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("a").alias("source"))
    other = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"), F.lit("b").alias("source"))
    both = docs.unionByName(other)
    got = mixing.taken(both)
    per = {r.source_size: (r.took, r.target, r.most, r.least) for r in got.groupBy("source_size").agg(F.sum("taken").alias("took"), F.first("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    assert all(abs(took - target) <= 3 and most - least <= 1 for took, target, most, least in per.values())
    assert mixing.mix(both).count() == got.agg(F.sum("copies")).first()[0]


def slow_mixture(text: str, model: np.ndarray) -> np.ndarray:
    """Proportions of languages by expectation-maximisation over words, one number at a time."""
    low = text.lower().encode()
    words, now = [], b""
    for b in low + b" ":
        if 0x61 <= b <= 0x7A or b >= 0x80:
            now += bytes([b])
        elif now:
            words.append(now)
            now = b""
    k = model.shape[1]
    if not words:
        return np.zeros(k)
    like = []
    for w in words:
        pad = b"\0" + w + b"\0"
        logs = [0.0] * k
        for i in range(1, len(pad) - 1):
            bucket = (((pad[i - 1] << 16) | (pad[i] << 8) | pad[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
            logs = [x + float(model[bucket, j]) for j, x in enumerate(logs)]
        like.append([math.exp(max(x - max(logs), -60)) for x in logs])

    def em(share, rounds):
        for _ in range(rounds):
            total = [0.0] * k
            for r in like:
                s = sum(a * b for a, b in zip(r, share, strict=True)) + 1e-300
                total = [t + a * b / s for t, a, b in zip(total, r, share, strict=True)]
            share = [t / len(like) for t in total]
        return share, sum(math.log(sum((a + 1e-300) * b for a, b in zip(r, share, strict=True))) for r in like)

    share, _ = em([1 / k] * k, langid.ROUNDS)
    order = sorted(range(k), key=lambda j: -share[j])
    tests = sum(x >= langid.MIN_SHARE for x in share)
    best, best_fit = [float(j == order[0]) for j in range(k)], -math.inf
    if tests > 1:
        for m in range(1, tests + 1):
            start = [max(share[j], 1e-6) if j in order[:m] else 0.0 for j in range(k)]
            got, fit = em([x / sum(start) for x in start], 1 if m == 1 else langid.ROUNDS)
            fit -= 0.5 * (m - 1) * math.log(len(like))
            if fit > best_fit:
                best, best_fit = got, fit
    return np.array(best)


def test_mixtures_match_slow_expectation_maximisation(monkeypatch):
    rng = np.random.default_rng(6)
    model = np.log(rng.dirichlet(np.full(langid.BUCKETS, 0.02), 4).T + 1e-9).astype(np.float32)
    texts = [vary(i, int(rng.integers(1, 40)), base=i % 5) for i in range(40)] + ["", "one", "1 2 3", "É a À"]
    rows = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0] + [len(r) for r in rows])
    want = np.stack([slow_mixture(t, model) for t in texts])
    assert np.allclose(langid.infer(data, offs, model), want, atol=2e-4)
    monkeypatch.setattr(langid, "CELLS", 16)
    assert np.allclose(langid.infer(data, offs, model), want, atol=2e-4)
    monkeypatch.setattr(langid, "LONG", 64)
    for r, w in zip(rows, want, strict=True):
        if r:
            assert np.allclose(langid.infer_long(np.frombuffer(r, np.uint8), model)[0], w, atol=2e-4)


def test_any_number_of_languages_and_long_texts(spark):
    rows = [(i, vary(i, 30, base=i % 3), f"l{i % 3}" if i < 600 else f"junk{i}") for i in range(900)]
    rows.append((5000, vary(1, 1_200_000, base=1), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == 901 and got[5000].lang_pred == "l1" and len(rows[-1][1]) > langid.LONG
    plain = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].lang_pred == f"l{i % 3}" for i in plain]) > 0.95


def test_token_counts_of_long_texts_and_of_tasks_that_run_twice(spark):
    encode = tokcount._encoder(open(tokcount.VOCABULARY, "rb").read()).encode_ordinary
    rows = [(1, vary(1, 200_000)), (2, "short"), (3, None), (4, "z" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(tokcount.count(docs), "doc_id", "n_tokens") == sorted((i, len(encode(t or ""))) for i, t in rows)
    path = files.folder(spark, "twice")
    order = tokcount.write(docs.repartition(2), path)
    order.collect()  # files of an attempt whose rows are not kept
    kept = files.saved(order, "order")
    got = kept.join(tokcount.scan(spark, path, only=kept), ["file", "ordinal"])
    assert rows_of(got, "doc_id", "n_tokens") == sorted((i, len(encode(t or ""))) for i, t in rows)
    assert kept.select("file").distinct().count() < spark.read.format("binaryFile").load(path).count()


def test_removal_with_many_blocks_and_clashing_columns(spark, monkeypatch):
    texts = [vary(k, 120, base=80 + k) for k in range(6)]
    bench = spark.createDataFrame([(f"i{k}", " ".join(t.split()[10 : 30 + k])) for k, t in enumerate(texts)], "item_id string, text string")
    rows = [(k, t, [1], "x", 3) for k, t in enumerate(texts)] + [(10, None, None, None, None), (11, "nothing of it", None, None, None), (12, vary(4, 900_000, base=3), None, None, None)]
    rows.append((13, rows[-1][1] + " " + " ".join(texts[0].split()[12:24]), None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans array<int>, _items string, _longest long")
    for size in (decontam.BLOCK_BYTES, 150):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        out = decontam.remove(docs, bench)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [10, 11, 12]
        found = {r.doc_id: (r.longest, r.longest_at) for r in decontam.score(docs, bench).collect()}
        assert found[3] == (23, 10) and found[13] == (12, 900_000) and found[11] == (0, None)


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 400).astype(np.uint64)
    shard = decontam.Shard(h, np.array([0, 7, 7, 150, 400]))
    depth = 16
    line = np.concatenate((shard.line, np.zeros(depth, np.int32)))
    keys = [tuple(line[i : i + depth]) for i in shard.array]
    assert keys == sorted(keys) and len(keys) == 400


def test_chunks_alone_can_reject(spark):
    rng = np.random.default_rng(3)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 8)) for _ in range(1400))
    lines = "\n".join("Item {} price {} stock {} sold {}".format(*rng.integers(0, 10**4, 4)) for _ in range(420))
    prose = vary(3, 1500)
    docs = spark.createDataFrame([(1, noise + "\n" + lines), (2, prose)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    lo, hi = [b[1:] for b in quality.Bands().whole if len((noise + lines).encode()) >= b[0]][-1]
    assert not got[1].base_failed and lo <= got[1].ratio <= hi and got[1].chunks_low and got[1].chunks_high
    assert not got[1].in_band and not got[1].kept and got[2].in_band and got[2].kept


def test_archives_of_any_size_and_members(spark):
    import gzip
    import io

    whole = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\nN: %d\r\n\r\n%s\r\n\r\n" % (n, n, b"y" * n) for n in (0, 5, 700_000, 3))
    for packed in (gzip.compress(whole), gzip.compress(whole[:100]) + gzip.compress(whole[100:])):
        for data in (packed, io.BytesIO(packed)):
            assert [len(block) for _, _, block in warc.Stream(warc.inflate(data, 4096))] == [0, 5, 700_000, 3]
    assert list(warc.inflate(b"")) == []


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="shares"):
        files.shared(Session())


def test_odd_rows_of_repeats_in_splits(spark, monkeypatch):
    monkeypatch.setattr(sufdedup, "BUCKET", 1)
    rows = [(r[0], r[1]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(sufdedup.removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
