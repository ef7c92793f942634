"""Divergence of sources, the prefix trie and packing, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import odd_rows, rows_of, vary
from tokenizers import Tokenizer

from memspark.llm import divergence, packing, trie

DOC = "doc_id long, text string, lang string, source string, part int"


def brute_divergence(rows, min_docs, top=10):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        key = (lang or "", source or "")
        groups.add(key)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(table))
        count[key].update(terms)
        docs[key[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        own = [g for g in groups if g[0] == lang]
        total = {t: sum(count[g][t] for g in own) for t in kept}

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {g: share(count[g]) for g in own}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(sum(f(p[g][t], p[x][t]) for t in kept), x[1]) for x in own if x != g]
            terms = [(f(p[g][t], q[t]), t) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(*g, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "chunk", "span", "held"), [(16, 4096, 64, 400_000), (2, 3, 2, 40), (1, 1, 1, 1)])
def test_divergence_matches_brute_force(spark, monkeypatch, block, chunk, span, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 4 * held)
    rows = [(r[0], r[1], r[2], r[3], 0) for r in odd_rows()]
    rows += [(100 + i, vary(i, 40, base=i % 3), "en", f"s{i % 7}", 0) for i in range(60)] + [(200 + i, f"É straße ab{i} A-b_c", "de", "only", 0) for i in range(4)]
    rows += [(300, "zz", "fr", "a", 0), (301, None, "fr", "b", 0), (302, "q" * 9000 + " " + "r s " * 3000, "en", "s1", 0), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    got = rows_of(divergence.audit(docs, 3, 5, block, chunk, span), "lang", "source", "part", "item", "value", "rank")
    assert got == brute_divergence(rows, 3, 5)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 10**15 + 7, 3 * 10**16 + 1, 10**9 + 3
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
    p, q = np.array([[10**9 + 1, 1]]), np.array([[1, 10**9 + 1], [7, 10**9]])
    want = [[sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(x, y, strict=True)) for y in q] for x in p]
    assert divergence.differences(p, q).tolist() == want


def brute_trie(rows, every=20, heads=4):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    for own in convs.values():
        own.sort()
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = tuple(t[3:] for t in convs.get(c - c % every, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in own if paths[c] == p)
        out.append((own[0], len(p), members[p[:-1]][0] if p else None, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations():
    """Unlike, equal, nested, turnless, long and odd conversations, many with the same first turns."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(300):
        n = int(rng.integers(0, 7))
        rows += [(c, k, ["user", "assistant"][k % 2], f"t {int(rng.integers(0, 1 + k))} " * (k + 1), 9) for k in range(n)]
    rows += [(1000 + c, k, "user", "same words here", 9) for c in range(250) for k in range(4)]
    rows += [(2000 + c, k, None, f"deep {k}" if k < 60 - c else None, 9) for c in range(30) for k in range(90 - c)]
    rows += [(3001, None, "user", "b", 9), (3001, None, "user", "a", 9), (3001, 1, "user", "", 9), (3001, 1, "user", "", 9), (None, 1, "user", "lost", 9), (-7, 0, "user", "x y", 9)]
    return rows


@pytest.mark.parametrize(("parts", "joined"), [(4, 8192), (60, 3)])
def test_trie_matches_brute_force(spark, monkeypatch, parts, joined):
    monkeypatch.setattr(trie, "JOINED", joined)
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_of(trie.prefixes(turns), *TRIE) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_tries_of_few_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    for rows in ([(5, 1, "user", "a b")], [(1, 0, "u", "x"), (2, 0, "u", "x")], [(1, k, "u", "x") for k in range(9)], [(c, 0, "u", str(c)) for c in range(1, 30)]):
        assert rows_of(trie.prefixes(spark.createDataFrame(rows, kind)), *TRIE) == brute_trie(rows)
    assert trie.prefixes(spark.createDataFrame([], kind)).count() == 0


def packed(docs, encode, width):
    """Brute force of the pieces of documents in the order of their sequences."""
    out, at = [], 0
    for doc_id, text in docs:
        ids, start = [*encode(text or ""), packing.END], 0
        while start < len(ids):
            take = min(width - at % width, len(ids) - start)
            crc = zlib.crc32(np.array(ids[start : start + take], "<u4").tobytes())
            out.append((doc_id, start, take, crc, len(ids), at // width, at % width))
            at, start = at + take, start + take
    return out


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@pytest.mark.parametrize(("width", "parts", "slice_bytes"), [(1024, 3, 1 << 20), (64, 5, 4000), (1, 2, 1 << 20)])
def test_packing_matches_brute_force(spark, monkeypatch, tmp_path, width, parts, slice_bytes):
    monkeypatch.setattr(packing, "SLICE_BYTES", slice_bytes)
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    rows = [(r[0], r[1], 0) for r in odd_rows() if width > 1 or len(r[1] or "") < 400]
    rows += [(50 + i, vary(i, 80) + " it's we'll <|endoftext|> x  y\n z é à 12 3a", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(parts)
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = sorted(packing.pieces(docs, width).collect(), key=lambda r: (r.sequence_id, r.offset))
    order, texts = [], defaultdict(list)
    for doc_id, text, _ in rows:
        texts[doc_id].append(text)
    for r in got:
        if r.start == 0:
            same = [t for t in texts[r.doc_id] if len(encode(t or "")) + 1 == r.doc_tokens]
            texts[r.doc_id].remove(same[0])
            order.append((r.doc_id, same[0]))
    assert not any(texts.values())
    assert [tuple(r[c] for c in PIECE) for r in got] == packed(order, encode, width)
    full = packing.sequences(docs, width).collect()
    assert sorted(r.sequence_id for r in full) == list(range(len(full)))
    assert sum(r.n_tokens < width for r in full) <= 1 and all(len(r.ids) == 4 * r.n_tokens for r in full)
    assert packing.pieces(docs.limit(0)).count() == 0


@pytest.mark.parametrize("slice_bytes", [1 << 20, 30])
def test_ids_are_the_tokenizers(monkeypatch, slice_bytes):
    monkeypatch.setattr(packing, "SLICE_BYTES", slice_bytes)
    with open(packing.vocabulary(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    assert encoder.fast is not None
    texts = ["a b", " a b ", "it's 'll we'd x", "a  b\t c \n d", "é b à", "x 1 y2 z", "", "don't\n\nstop now .,", "ß a" * 50, "naïve café au lait " * 40, "你 b 好 c d"]
    texts += ["".join(map(chr, range(lo, hi))) for lo, hi in ((0, 128), (128, 256), (160, 640), (0x2000, 0x2100))] + ["a <|endoftext|> b" * 5, "\u00a0 \u00a0x\u00bd 1\u00b2", "z" * 5000, " " * 500 + "x", "\r\n \r\n"]
    for t in texts:
        assert encoder.ids(np.frombuffer(t.encode(), np.uint8)).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t[:20]
