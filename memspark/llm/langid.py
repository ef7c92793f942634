"""Language identification as a mixture of languages, inferred by expectation-maximisation.

Each language has smoothed frequencies of byte trigrams within words. A word's likelihood under a
language is the product of its trigrams'; a document's proportions of languages maximise the likelihood
of its words under their mixture, found by expectation-maximisation. The set of languages is the one,
among the first by proportion, of the largest likelihood less a penalty of half the logarithm of the
number of words for each language after the first.

Training takes documents with text and a language whose crc32(doc_id as text) mod 4 is not 2: of each
language some ``PER_LANGUAGE``, chosen by a hash of the id, whole texts, and of languages the
``MAX_LANGUAGES`` with most documents, ties by name. Prediction sees only texts.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is all if nothing was
learned. Null ids are neither held out nor learned from; null languages aren't learned from. Equal rows
get equal results. Extra columns are not looked at. An empty table gives an empty result. Very long
texts are read whole, piece by piece: the mixture sees their different words with counts. A language
column with any number of values, junk included, is no error: rare ones aren't learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Documents of a language that are learned from, about; buckets of trigrams; added to each count.
PER_LANGUAGE, BUCKETS, SMOOTHING = 4000, 1 << 16, 0.5
#: Languages that are learned at most; the model, 256 KB for each, goes to every worker.
MAX_LANGUAGES = 100
#: Numbers of a table of likelihoods that are looked up together; bytes of text from which a row is taken in pieces.
CELLS, LONG = 4 << 20, 4 << 20
ROUNDS, MIN_SHARE = 8, 0.01
UNKNOWN = "und"
_LETTER = tx.lut(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def lowered(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z, and the capitals of Latin-1's upper half, in lower case."""
    out = tx.LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    b = out[at]
    out[at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 0x20
    return out


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter byte, each word's first, and each row's first word."""
    low = lowered(buf)
    starts, ends, first = tx.words(low, offs, _LETTER)
    before, after = np.zeros(len(low), np.uint32), np.zeros(len(low), np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[starts] = 0
    after[ends - 1] = 0
    size = ends - starts
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    at = np.flatnonzero(_LETTER[low])
    code = (before[at] << np.uint32(16)) | (low[at].astype(np.uint32) << np.uint32(8)) | after[at]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), bounds, first


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the logarithm of each bucket's frequency in each."""
    fold = F.crc32(F.col("doc_id").cast("long").cast("string")) % 4
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != 2))
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in top.collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, PER_LANGUAGE / sizes[n])))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    code = {n: k for k, n in enumerate(names)}

    def run(batches):
        for batch in batches:
            rows = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
            buf, offs = tx.flat(batch.column(1))
            total = np.zeros(BUCKETS * len(names), np.int64)
            for a, b in tx.slices(offs):
                gram, bounds, first = trigrams(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                per_row = np.diff(bounds[first])
                total += np.bincount(gram.astype(np.int64) * len(names) + np.repeat(rows[a:b], per_row), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(at), "n": pa.array(total[at])})

    counted = known.filter(F.col("lang").isin(names) & drawn).select("lang", "text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # one number per bucket and language at most
    counts = np.zeros(BUCKETS * len(names))
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(BUCKETS, len(names)) + SMOOTHING
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def _em(like: np.ndarray, share: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: np.ndarray, rounds: int):
    """Proportions after some rounds, and the words' log-likelihood (without their scale), per row."""
    for _ in range(rounds):
        r = like * share[row]
        r *= (weight / r.sum(1))[:, None]
        share = np.add.reduceat(r, at, axis=0) / n[:, None]
    return share, np.add.reduceat(weight * np.log((like * share[row]).sum(1)), at)


def likelihoods(gram: np.ndarray, bounds: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Words by languages: logarithms of likelihoods, looked up some words at a time."""
    out = np.zeros((len(bounds) - 1, model.shape[1]))
    step, k = max(1, CELLS // max(1, model.shape[1])), 0
    while k < len(out):
        to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + step, "right")) - 1)
        lo, hi = bounds[k], bounds[to]
        if hi - lo <= step:
            out[k:to] = np.add.reduceat(model[gram[lo:hi]], bounds[k:to] - lo, axis=0)
        else:  # one long word
            for a in range(lo, hi, step):
                out[k] += model[gram[a : min(hi, a + step)]].sum(0, dtype=np.float64)
        k = to
    return out


def mixture(log: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows by languages: proportions of the chosen set; zeros for rows without words.

    Row k has the words first[k] up to first[k + 1], each ``weight`` times.
    """
    out = np.zeros((len(first) - 1, log.shape[1]))
    rows = np.flatnonzero(np.diff(first))
    if not len(rows) or not log.shape[1]:
        return out
    like = np.exp(np.maximum(log - log.max(1, keepdims=True), -60))
    row = np.repeat(np.arange(len(rows)), np.diff(first)[rows])
    at = first[rows]
    n = np.add.reduceat(weight, at)
    share, _ = _em(like, np.full((len(rows), log.shape[1]), 1.0 / log.shape[1]), row, at, weight, n, ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    best[np.arange(len(rows)), order[:, 0]] = 1.0
    # One language is settled where no other has a share worth a test.
    tests = (share >= MIN_SHARE).sum(1)
    some = np.flatnonzero(tests > 1)
    if len(some):
        words = np.flatnonzero(np.isin(row, some))
        sub = np.searchsorted(some, row[words])
        sub_at = np.searchsorted(sub, np.arange(len(some)))
        size, tests = n[some], tests[some]
        rank = np.argsort(order[some], axis=1)
        score = np.full(len(some), -np.inf)
        pick = best[some]
        for k in range(1, int(tests.max()) + 1):
            start = np.where(rank < k, np.maximum(share[some], 1e-6), 0.0)
            start /= start.sum(1, keepdims=True)
            got, fit = _em(like[words] + 1e-300, start, sub, sub_at, weight[words], size, 1 if k == 1 else ROUNDS)
            fit -= 0.5 * (k - 1) * np.log(size)
            better = (fit > score) & (k <= tests)
            score[better], pick[better] = fit[better], got[better]
        best[some] = pick
    out[rows] = best
    return out


def infer(buf: np.ndarray, offs: np.ndarray, model: np.ndarray) -> np.ndarray:
    """mixture() of the words of each row."""
    gram, bounds, first = trigrams(buf, offs)
    return mixture(likelihoods(gram, bounds, model), np.ones(len(bounds) - 1), first)


def infer_long(buf: np.ndarray, model: np.ndarray) -> np.ndarray:
    """infer() of one row of any length: its different words, gathered piece by piece, with counts."""
    keys, counts, logs = np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, model.shape[1]))
    at = 0
    while at < len(buf):
        to = min(len(buf), at + LONG // 8)
        gap = np.flatnonzero(~_LETTER[lowered(buf[to : to + LONG])])  # pieces end outside words
        to = to + int(gap[0]) if len(gap) else len(buf)
        part = buf[at:to]
        gram, bounds, _ = trigrams(part, np.array([0, len(part)]))
        low = lowered(part)
        starts, ends, _ = tx.words(low, np.array([0, len(low)]), _LETTER)
        key, one, n = np.unique(tx.Hasher(low)(starts, ends), return_index=True, return_counts=True)
        fresh = np.flatnonzero(~np.isin(key, keys))
        where = np.searchsorted(keys, key)
        old = np.setdiff1d(np.arange(len(key)), fresh)
        counts[where[old]] += n[old]
        size = np.diff(bounds)[one[fresh]]
        span = np.concatenate(([0], np.cumsum(size)))
        picked = gram[np.repeat(bounds[one[fresh]] - span[:-1], size) + np.arange(span[-1])]
        keys, counts, logs = np.concatenate((keys, key[fresh])), np.concatenate((counts, n[fresh])), np.concatenate((logs, likelihoods(picked, span, model)))
        order = np.argsort(keys)
        keys, counts, logs = keys[order], counts[order], logs[order]
        at = to
    return mixture(logs, counts, np.array([0, len(keys)]))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """One row per document: fold, language of the largest proportion, the proportion, and the set."""
    known = docs.sparkSession.sparkContext.broadcast((names, model))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])

    def run(batches):
        names, model = known.value
        for batch in batches:
            buf, offs = tx.flat(batch.column(2))
            for a, b in tx.slices(offs, max(1 << 16, 8 * tx.SLICE_BYTES // max(8, len(names)))):
                part = buf[offs[a] : offs[b]]
                rows = offs[a : b + 1] - offs[a]
                share = infer_long(part, model) if len(part) >= LONG else infer(part, rows, model)
                ascii_letter = tx.per_row((part | 0x20 >= 0x61) & (part | 0x20 <= 0x7A), rows) > 0
                lang, score, langs = [], [], []
                for k in range(b - a):
                    if not names or not (ascii_letter[k] or has_letter(part[rows[k] : rows[k + 1]].tobytes().decode())):
                        lang.append(UNKNOWN), score.append(0.0), langs.append("")
                        continue
                    top = int(share[k].argmax())
                    lang.append(names[top]), score.append(float(min(1.0, share[k, top])))
                    langs.append(",".join(names[j] for j in np.argsort(-share[k], kind="stable") if share[k, j] > 0))
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score), pa.array(langs, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    fold = F.crc32(F.col("doc_id").cast("long").cast("string")) % 4
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents' known languages and predict all."""
    return predict(docs, *learn(docs))
