"""The training-data operators against brute force, and on odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from memspark.llm import chat, decontam, files, langid, minhash, mixing, quality, sharding, sufdedup, tokcount, warc

ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, n int, t int, kept string, _id int, copies int"
LOREM = "the quick brown fox jumps over the lazy dog while seven wizards calmly juggle quartz boxes near a foggy harbour and nobody in town minds much about it "


def vary(seed: int, words: int = 160, edits: int = 0, base: int = 0) -> str:
    rng = np.random.default_rng(base)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(400)]
    text = [vocabulary[i] for i in rng.integers(0, 400, words)]
    own = np.random.default_rng(1000 + seed)
    for i in own.integers(0, words, edits):
        text[i] = f"w{own.integers(0, 10**6)}"
    return " ".join(text)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, tiny, very long and periodic texts, ties and repeated rows."""
    texts = [None, "", " \t\n", "a", "one two three", LOREM, LOREM, LOREM * 40, "na " * 3000, "x" * 5000, "é" * 300, vary(1), vary(1, edits=2), vary(2, edits=60), "\n\n#|<>\n#|<>\n" + LOREM]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None, i, i, i, "x", i, i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, LOREM, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_quality_counts_match_brute_force(odd):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for doc_id, text, *_ in odd_rows():
        w = word.findall(text or "")
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen, hit = Counter(win), set()
        for i, x in enumerate(win):
            if seen[x] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if word.search(x)]
        want.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = rows_of(quality.score(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(want, key=repr)


def test_quality_bands_reject_both_ends(spark):
    rng = np.random.default_rng(0)
    noise = " ".join(base64.b64encode(rng.bytes(9)).decode() for _ in range(1500))
    prose = vary(3, 900)
    loop = " ".join(f"{x} {LOREM}" for x in ("b", "c") * 200)
    docs = spark.createDataFrame([(1, noise), (2, prose), (3, loop)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.score(docs).collect()}
    assert kept == {1: False, 2: True, 3: False}
    assert [r.doc_id for r in quality.keep(docs).collect()] == [2]


def test_filters_keep_columns_and_rows_of_odd_tables(odd, spark):
    bench = spark.createDataFrame([("b", vary(1, 20))], "item_id string, text string")
    for out in (quality.keep(odd), minhash.deduplicate(odd), decontam.remove(odd, bench), mixing.mix(odd)):
        assert out.columns == odd.columns
        out.count()
    empty = odd.limit(0)
    for out in (quality.keep(empty), quality.score(empty), minhash.deduplicate(empty), decontam.remove(empty, bench), mixing.mix(empty), mixing.taken(empty), sufdedup.removed(empty), langid.identify(empty), tokcount.count(empty), sharding.shard(empty)[0]):
        assert out.count() == 0
    assert decontam.remove(odd, bench.limit(0)).count() == odd.count()


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent: int = 85) -> dict:
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[root(i)].append(doc_id)
    return sorted(((d, len(s), min(low[root(i)]) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_near_duplicates_match_brute_force(spark):
    rows = [(i, vary(i, 150, edits=i % 7, base=i % 4)) for i in range(160)]
    rows += [(200 + i, vary(200 + i, 150, edits=3 + i % 5, base=9)) for i in range(60)]
    rows += [(r[0] + 1000 if r[0] is not None else None, r[1]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())
    kept = [r.doc_id for r in minhash.deduplicate(docs).collect()]
    alone = [k for k in kept if k is not None]
    assert sorted(alone) == sorted({c for _, _, c in brute_components(rows) if c is not None}) and kept.count(None) == 2


def test_decontamination_matches_brute_force(spark, odd, monkeypatch):
    passage = vary(1, 160)
    bench_rows = [("a", " ".join(passage.split()[20:45])), ("b", "seven wizards"), (None, "quartz boxes near a"), ("d", None), ("e", "..."), ("a", "one two three")]
    bench = spark.createDataFrame(bench_rows, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    keys = defaultdict(set)
    for item, text in bench_rows:
        w = low(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            keys[tuple(w[i : i + n])].add(item or "")
    want = []
    for doc_id, text, *_ in odd_rows():
        w, hit, items = low(text), set(), set()
        for k, owners in keys.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    items |= owners
        want.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontam.score(odd, bench), *names) == sorted(want, key=repr)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)  # several blocks, one pass each
    assert rows_of(decontam.score(odd, bench), *names) == sorted(want, key=repr)
    assert decontam.remove(odd, bench).columns == odd.columns


def test_longest_matches_are_maximal(spark):
    text = vary(5, 80)
    bench = spark.createDataFrame([("i", " ".join(text.split()[10:40]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x y " + text), (2, LOREM)], "doc_id long, text string")
    assert rows_of(decontam.matches(docs, bench), "doc_id", "item_id", "doc_word", "item_word", "n_words") == [(1, "i", 12, 0, 30)]


def brute_repeats(rows):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for (doc_id, *_), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [20_000, 2])
def test_repeated_strings_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(sufdedup, "BUCKET", bucket)
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(100 + i, vary(i, 90, edits=i % 4, base=i % 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(sufdedup.removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_difference_cover_covers():
    d = sufdedup.COVER
    assert {(a - b) % sufdedup.PERIOD for a in d for b in d} == set(range(sufdedup.PERIOD))


def test_mix_is_balanced_and_repeatable(spark, odd):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60) if i % 50 else 900), ["a", "b", None, "hot"][i % 4] if i % 3 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    per = a.groupby("source", dropna=False).agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.said).all() and (per.target <= 3 * per["size"] + 1e-6).all()
    assert abs(per.target.sum() - per["size"].sum()) < 1e-6 * per["size"].sum()
    assert ((per.taken - per.target).abs() <= 0.01 * per.target + 60).all()
    assert (a.taken <= 3 * a["size"]).all()
    assert rows_of(mixing.taken(docs), "doc_id", "taken") == rows_of(mixing.taken(docs.repartition(5)), "doc_id", "taken")
    assert mixing.mix(docs).count() == int(a.copies.sum())
    assert mixing.taken(odd).count() == odd.count()


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(3)
    pi, size = rng.random(400), rng.integers(1, 500, 400)
    out = mixing.flight(pi, size, rng)
    assert abs(out @ size - pi @ size) < 1e-3 and abs(out.sum() - pi.sum()) < 1e-6
    assert ((out > 0) & (out < 1)).sum() <= 2


def test_shards_hold_every_row_once_and_versions_are_whole(spark, odd, tmp_path):
    root = f"file://{tmp_path}/shards"
    many = odd.repartition(9)
    sharding.append(many, root)
    sharding.append(many, root)
    before = sharding.manifest(spark, root).count()
    assert sharding.read(spark, root, 1).count() == odd.count()
    version = sharding.compact(spark, root)
    assert sharding.versions(spark, root) == [1, 2, 3] and version == 3
    out = sharding.read(spark, root)
    assert out.columns == odd.columns and sharding.manifest(spark, root).count() < before
    assert Counter(map(repr, map(tuple, out.collect()))) == Counter({k: 2 * n for k, n in Counter(map(repr, map(tuple, odd.collect()))).items()})
    with pytest.raises(Exception, match="exist"):
        sharding._commit(spark, root, sharding.manifest(spark, root), 3)


def test_compaction_merges_only_within_tiers_and_targets(spark):
    sizes = [100] * 10 + [1000] * 2 + [10**6] * 5
    shards = spark.createDataFrame([(f"p{i:03d}", s, int(np.floor(np.log(s) / np.log(4))), 0) for i, s in enumerate(sizes)], "path string, bytes long, tier int, level int")
    got = sharding.plan(shards, 500).groupBy("run").agg({"bytes": "sum", "path": "count"}).collect()
    assert sorted(r["count(path)"] for r in got) == [5, 5] and all(r["sum(bytes)"] <= 500 for r in got)


def test_languages_are_told_apart(spark, odd):
    rng = np.random.default_rng(5)
    syllables = {"xx": ["ka", "to", "mi", "ro", "né"], "yy": ["sch", "ung", "ber", "äch", "tz"], "zz": ["que", "os", "ción", "ll", "ar"]}

    def speak(lang, n):
        return " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))

    rows = [(i, speak(lang, int(rng.integers(5, 80))).upper() if i % 5 == 0 else speak(lang, 40), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 120)]
    mixed = [(900, speak("xx", 60) + " " + speak("yy", 30), None), (901, "123 !?", None), (902, None, None), (903, "", None), (904, "\U0001f600", None), (None, speak("zz", 20), None)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) >= 0.97
    assert got[900].languages == "xx,yy" and 0.55 < got[900].score < 0.8
    assert [got[i].lang_pred for i in (901, 902, 903, 904)] == ["und"] * 4 and got[901].score == 0.0
    assert got[None].lang_pred == "zz" and not got[None].held_out
    assert langid.identify(odd).count() == odd.count()
    nothing = langid.identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).filter("doc_id > 899"))
    assert {r.lang_pred for r in nothing.filter("doc_id = 900").collect()} == {"und"}


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\|turn|>x<|end|>\n", "\\<\\\\</s>", "<<SYS>>a<</SYS>>", "é\n\n", "", "[" * 5 + "INST]", "<|turn|>assistant\nhi<|end|>\n"]
    assert all(chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL) for t in hard)
    rows = [(c, k, ["user", "assistant", "a\nb\\", None][k % 4], None if k == 6 else hard[(c + k) % len(hard)], k) for c in range(5) for k in range(9)]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k} " + hard[k % 8], 0) for k in range(3000)] + [(None, 0, "user", "x", 0), (3, None, "assistant", "first", 0)] + [rows[3]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(5)
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(turns).collect()}
    assert got == want
    assert chat.digests(turns.limit(0)).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    html = [None, "", "<p>same</p>", "<p>same</p>", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000] + [f"page {i % 9}" for i in range(30)]
    rows = [(i, f"http://h/{i} a\n" if i % 3 else None, h, "z") for i, h in enumerate(html)] + [(None, None, "page 1", None), (3, "http://h/3", "<p>same</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size string").repartition(3)
    low = {}
    for i, _, h, _ in rows:
        if i is not None:
            low[h or ""] = max(i, low.get(h or "", -1))
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        top = low.get(h or "")
        kind = "response" if i == top or top is None else "revisit"
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, None if kind == "response" else top))
    got = warc.round_trip(pages)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_normalised_members_stand_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"text {i}") for i in range(5)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/raw")
    out = warc.normalise(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/out").collect()
    assert sum(r.records for r in out) == 5
    for r in out:
        path = r.archive.removeprefix("file://")
        whole = gzip.decompress(open(path, "rb").read())
        assert len(list(warc.Stream([whole]))) == r.records
    with pytest.raises(ValueError, match="cut off"):
        list(warc.Stream(warc.inflate(gzip.compress(whole)[:-20])))


@pytest.mark.parametrize(("file_tokens", "block"), [(1 << 20, 1 << 16), (50, 7)])
def test_token_counts_match_the_tokenizer(spark, monkeypatch, odd, file_tokens, block):
    monkeypatch.setattr(tokcount, "FILE_TOKENS", file_tokens)
    monkeypatch.setattr(tokcount, "BLOCK_TOKENS", block)
    encode = tokcount._encoder(open(tokcount.VOCABULARY, "rb").read()).encode_ordinary
    small = odd.filter("text is null or length(text) < 3000")
    want = sorted(((r.doc_id, len(encode(r.text or ""))) for r in small.collect()), key=repr)
    assert rows_of(tokcount.count(small), "doc_id", "n_tokens") == want


def test_scan_finds_separators_at_every_place(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = []
    for f, close in ((0, True), (1, False), (2, True)):
        lengths = rng.integers(0, 6, 40).tolist() if f < 2 else [0, 0, 0]
        tokens = [x for n in lengths for x in [1] * n + [tokcount.SEPARATOR]] + ([] if close else [1, 1])
        (tmp_path / f"{f}.bin").write_bytes(np.array(tokens, tokcount.KIND).tobytes())
        want += [(f"{f}.bin", k, n, True) for k, n in enumerate(lengths)] + ([] if close else [(f"{f}.bin", 40, 2, False)])
    (tmp_path / "none.bin").write_bytes(np.array([5] * 30, tokcount.KIND).tobytes())
    want.append(("none.bin", 0, 30, False))
    for block in (1, 4, 1000):
        assert rows_of(tokcount.scan(spark, f"file://{tmp_path}", block=block), "file", "ordinal", "n_tokens", "closed") == sorted(want, key=repr)


def test_shared_folder_is_the_sessions(spark):
    assert files.shared(spark) == files.shared(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
