"""Text functions as columns; Python only where a replacement needs a callback or a digest Spark lacks."""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that name no subject.
STOPWORDS = """the a an we i it this that they our all use uses used using for to and or but is are was were be now no not
longer instead switched moved migrated replaced deprecated from of in on with prefer chose choose every always never""".split()
# Ordered cues of memory types; the first that matches names the type.
TYPE_CUES = [
    ("decision", r"\b(decided|chose|chosen|opted for|going with|will use|we use .+ because|decision|picked)\b"),
    ("convention", r"\b(convention|standard|rule|guideline|must|should always|always use|never use|style guide|policy)\b"),
    ("preference", r"\b(prefer|favou?r|i like|i dislike|avoid|rather than|over \w+|don'?t use)\b"),
    ("snippet", r"```|\b(snippet|helper|boilerplate|pattern for)\b"),
    ("project", r"\b(project|service|repo|repository|architecture|microservice|the stack|built with|runs on)\b"),
    ("identity", r"\b(i am|i'?m a|my name is|i work as|i'?m the|my role)\b"),
    ("entity", r"\b(owns|owner of|maintains|on the .+ team|reports to)\b"),
]
# Cues that a durable fact is stated, that one is contradicted, that a question spans subjects.
FACT_CUE = r"\b(remember|always|never|i prefer|we (?:use|decided|chose)|the convention|from now on|by default|note that|don'?t use)\b"
NEGATION_CUE = r"\b(no longer|not|instead|now use|switched to|deprecated|don'?t)\b"
MULTIHOP_CUE = r"\b(and|both|between|relate[ds]?|relationship|connection|across|versus|vs|compare|together)\b"
BOOSTS = {"decision": 0.2, "convention": 0.15, "identity": 0.15, "project": 0.1}
# Secrets by kind, most specific first.
SECRETS = [
    ("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]+?-----END[^\n]+-----"),
    ("openai-key", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}"),
    ("google-key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("github-pat-fine", r"github_pat_[A-Za-z0-9_]{60,}"),
    ("slack-token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("stripe-key", r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("aws-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws-temp-key", r"\bASIA[0-9A-Z]{16}\b"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("slack-app-token", r"\bxapp-[0-9]-[A-Za-z0-9-]{10,}\b"),
    ("gitlab-pat", r"\bglpat-[A-Za-z0-9_-]{20,}\b"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("do-token", r"\bdop_v1_[a-f0-9]{64}\b"),
    ("sendgrid-key", r"\bSG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b"),
    ("connection-uri", r"[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@[^\s]+"),
    ("assignment", r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|client[_-]?secret)\b\s*[:=]\s*\S+"),
]
# Personal data, in the order in which it is replaced.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3}[\s.-]?\d{4}(?!\d)"
SECRET_MARK, PII_MARK = "«redacted»", "«pii»"
ENTROPY_LENGTH, ENTROPY_BITS = 24, 4.0


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def sentences(text: Column) -> Column:
    """Sentences of three words or more."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: n_words(s) >= 3)


def slug(text: Column, words: int = 6) -> Column:
    found = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, words)
    return F.when(F.size(found) > 0, F.concat_ws("-", found)).otherwise(F.lit("mem"))


def key_entities(text: Column, trim: bool = True) -> Column:
    """Distinct lower-case subjects: capitalised, dotted or with digits; trailing punctuation is dropped."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9.+#_-]*"), F.lit(0))
    if trim:
        found = F.transform(found, lambda t: F.regexp_replace(t, r"[.+#_-]+$", ""))
    named = F.filter(found, lambda t: (F.length(t) >= 3) & t.rlike(r"^[A-Z]|[.+#_\-0-9]"))
    lowered = F.array_distinct(F.transform(named, lambda t: F.lower(t)))
    return F.array_except(lowered, F.array(*[F.lit(w) for w in STOPWORDS]))


def infer_type(text: Column) -> Column:
    out = F.lit("fact")
    for kind, cue in reversed(TYPE_CUES):
        out = F.when(text.rlike("(?i)" + cue), F.lit(kind)).otherwise(out)
    return out


def gate(text: Column, novelty: Column | None = None) -> Column:
    """How likely a text states a durable fact, 0 to 1; without a novelty it can't pass 0.7."""
    words = n_words(text)
    score = F.when(text.rlike("(?i)" + FACT_CUE), 0.5).otherwise(0.0) + F.when(words.between(4, 400), 0.2).otherwise(0.0)
    if novelty is not None:
        score = score + F.when(novelty.isNotNull(), F.lit(0.3) * F.least(F.greatest(novelty, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def importance(kind: Column, gate_score: Column) -> Column:
    boost = F.lit(0.0)
    for k, v in BOOSTS.items():
        boost = F.when(kind == k, F.lit(v)).otherwise(boost)
    return F.round(F.least(F.lit(0.4) + F.lit(0.4) * gate_score + boost, F.lit(1.0)), 3)


def contradicts(text: Column, kind: Column) -> Column:
    """Whether a near match of this text replaces what it matches."""
    return text.rlike("(?i)" + NEGATION_CUE) | kind.isin("identity")


def multi_hop(text: Column) -> Column:
    return text.rlike("(?i)" + MULTIHOP_CUE) | (F.size(key_entities(text)) >= 2)


def secret_kinds(text: Column) -> Column:
    """Kinds of secrets that a text holds, by pattern."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS]))


def entropy(token: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.length(token))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def high_entropy(text: Column) -> Column:
    """Tokens that look like secrets of no known kind: long, of mixed characters, of high entropy."""
    tokens_ = F.regexp_extract_all(text, F.lit(rf"[A-Za-z0-9+/_=-]{{{ENTROPY_LENGTH},}}"), F.lit(0))
    return F.filter(tokens_, lambda t: t.rlike("[a-z]") & t.rlike("[A-Z0-9]") & (entropy(t) >= ENTROPY_BITS))


def secret_findings(text: Column) -> Column:
    """kind and hint of all secrets in a text; a hint never tells the secret."""
    known = F.transform(secret_kinds(text), lambda k: F.struct(k.alias("kind"), F.lit("«detected»").alias("hint")))
    odd = F.transform(high_entropy(text), lambda t: F.struct(F.lit("high-entropy").alias("kind"), F.concat(F.substring(t, 1, 4), F.lit("…"), F.substring(t, -2, 2)).alias("hint")))
    return F.concat(known, odd)


def cache_key(model: Column, system: Column, prompt: Column) -> Column:
    """Where a model's reply is kept: a digest of what it was asked."""
    return F.sha2(F.concat_ws("\x00", model, F.coalesce(system, F.lit("")), prompt), 256)


def iso(at: Column) -> Column:
    """A timestamp in ISO 8601, in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_iso(text: Column) -> Column:
    """A timestamp from ISO 8601; one without zone is UTC, anything else null."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    return F.try_to_timestamp(F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def fingerprint(kind: Column, content: Column) -> Column:
    """Identity of a fact by type and normalised content."""
    return F.sha2(F.concat(kind, F.lit("|"), F.lower(F.trim(content))), 256)


def card_ok(digits: str) -> bool:
    """Luhn's check over 13 to 19 digits."""
    d = [int(c) for c in digits if c.isdigit()][::-1]
    if not 13 <= len(d) <= 19:
        return False
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def looks_secret(token: str) -> bool:
    """A long token of mixed characters with high entropy."""
    if len(token) < ENTROPY_LENGTH or not (re.search("[a-z]", token) and re.search("[A-Z0-9]", token)):
        return False
    share = np.unique(list(token), return_counts=True)[1] / len(token)
    return float(-(share * np.log2(share)).sum()) >= ENTROPY_BITS


_COMPILED = [re.compile(p) for _, p in SECRETS]
_LONG = re.compile(rf"[A-Za-z0-9+/_=-]{{{ENTROPY_LENGTH},}}")


def redact_text(text: str | None, pii: bool = True, entropy: bool = True) -> str | None:
    """Secrets, and personal data on request, replaced by marks."""
    if text is None:
        return None
    for p in _COMPILED:
        text = p.sub(SECRET_MARK, text)
    if entropy:
        text = _LONG.sub(lambda m: SECRET_MARK if looks_secret(m[0]) else m[0], text)
    if pii:
        for p in (EMAIL, SSN):
            text = re.sub(p, PII_MARK, text)
        text = re.sub(CARD, lambda m: PII_MARK if card_ok(m[0]) else m[0], text)
        for p in (IPV4, PHONE):
            text = re.sub(p, PII_MARK, text)
    return text


@F.pandas_udf(T.StringType())
def redact(text: pd.Series) -> pd.Series:
    """All of a text's secrets and personal data replaced; needs callbacks, hence Python."""
    return text.map(redact_text)


@F.pandas_udf(T.StringType())
def blake_fingerprint(text: pd.Series) -> pd.Series:
    """128-bit BLAKE2b in hex, for parity with stores that key by it."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest())


def mac_text(key: bytes, text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=32, key=key).hexdigest()


#: Characters whose n-grams are counted at once, and of one text; features whose hashes a worker remembers.
AT_ONCE, PIECE, REMEMBERED = 1 << 18, 1 << 15, 1 << 19
_hashes: dict[str, int] = {}
_WORD = re.compile("[a-z0-9]+")


def _hash(feature: str) -> int:
    h = _hashes.get(feature)
    if h is None:
        h = int.from_bytes(hashlib.blake2s(feature.encode(), digest_size=8).digest(), "big")
        if len(_hashes) >= REMEMBERED:
            _hashes.clear()
        if len(feature) <= 32:
            _hashes[feature] = h
    return h


def _add(out: np.ndarray, features: list[str], weight: np.ndarray, code: np.ndarray, row: np.ndarray) -> None:
    """Add features, given by their codes, to their rows with a sign."""
    h = np.array([_hash(x) for x in features], np.uint64)
    value = np.where((h >> np.uint64(33)) & np.uint64(1) > 0, weight, -weight)
    low, high, dim = int(row.min()), int(row.max()) + 1, out.shape[1]
    at = (h % np.uint64(dim)).astype(np.int64)[code] + (row - low) * dim
    out[low:high] += np.bincount(at, value[code], (high - low) * dim).reshape(-1, dim)


def _add_words(out: np.ndarray, texts: list[str], rows: list[int]) -> None:
    code, row, known = [], [], {}

    def flush():
        if code:
            _add(out, ["w:" + w for w in known], np.full(len(known), 2.0), np.array(code), np.array(row))
        code.clear(), row.clear(), known.clear()

    for low, i in zip(texts, rows, strict=True):
        found = iter(_WORD.findall(low)) if len(low) < AT_ONCE else (m[0] for m in _WORD.finditer(low))
        while part := list(islice(found, AT_ONCE)):
            code += [known.setdefault(w, len(known)) for w in part]
            row += [i] * len(part)
            if len(code) >= AT_ONCE:
                flush()
    flush()


def _add_grams(out: np.ndarray, pieces: list[str], rows: list[int]) -> None:
    """Add the character 3- and 4-grams that begin in the first ``PIECE`` characters of each piece."""
    size = np.array([len(p) for p in pieces])
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    letters, code = np.unique(points, return_inverse=True)
    if len(letters) > 1 << 16:  # four letters wouldn't fit a number; a piece has fewer
        half = len(pieces) // 2
        _add_grams(out, pieces[:half], rows[:half])
        _add_grams(out, pieces[half:], rows[half:])
        return
    end = np.cumsum(size)
    at = np.arange(len(points))
    left, begun = np.repeat(end, size) - at, at - np.repeat(end - size, size) < PIECE
    row, code, bits = np.repeat(np.array(rows), size), code.astype(np.uint64), np.uint64(max(1, int(len(letters) - 1).bit_length()))
    for n in (3, 4):
        starts = np.flatnonzero(begun & (left >= n))
        if not len(starts):
            continue
        packed = np.zeros(len(starts), np.uint64)
        for k in range(n):
            packed = packed << bits | code[starts + k]
        grams, where = np.unique(packed, return_inverse=True)
        shifts = bits * np.arange(n - 1, -1, -1, dtype=np.uint64)
        spelled = letters[(grams[:, None] >> shifts & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
        flat = spelled.tobytes().decode("utf-32-le")
        # A character n-gram that happens to begin like a word feature weighs as one.
        weight = np.where((spelled[:, 0] == ord("w")) & (spelled[:, 1] == ord(":")), 2.0, 1.0)
        _add(out, [flat[i : i + n] for i in range(0, len(flat), n)], weight, where, row[starts])


def embed_texts(texts, dim: int = 256) -> np.ndarray:
    """Signed hashes of words (weight 2) and character 3- and 4-grams, of unit length.

    Features are counted some hundred thousand characters at a time, of however many or long texts, so
    what is held beside texts and vectors is bounded.
    """
    out = np.zeros((len(texts), dim))
    pieces, rows, held, lows, first = [], [], 0, [], 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        lows.append(low)
        if held + len(low) >= AT_ONCE:
            _add_words(out, lows, list(range(first, i + 1)))
            lows, first = [], i + 1
        padded = f" {low} "
        for a in range(0, max(1, len(padded) - 2), PIECE):
            pieces.append(padded[a : a + PIECE + 3])
            rows.append(i)
            held += len(pieces[-1])
            if held >= AT_ONCE:
                _add_grams(out, pieces, rows)
                pieces, rows, held = [], [], 0
    _add_words(out, lows, list(range(first, len(texts))))
    if pieces:
        _add_grams(out, pieces, rows)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def embed_text(text: str, dim: int = 256) -> list[float]:
    return embed_texts([text], dim)[0].tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embed(text: pd.Series) -> pd.Series:
    """embed_texts() as a column."""
    return pd.Series(list(embed_texts(text.tolist())), index=text.index)
