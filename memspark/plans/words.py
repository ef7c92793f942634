"""Word lists and patterns as the SQL side states them, apart from the code that it checks."""

from __future__ import annotations

# Words that name no subject.
STOP = """['the','a','an','we','i','it','this','that','they','our','all','use','uses','used','using','for','to','and','or','but','is','are','was','were','be','now','no','not',
'longer','instead','switched','moved','migrated','replaced','deprecated','from','of','in','on','with','prefer','chose','choose','every','always','never']"""
# Cues of memory types, in order.
TYPES = [
    ("decision", r"\b(decided|chose|chosen|opted for|going with|will use|we use .+ because|decision|picked)\b"),
    ("convention", r"\b(convention|standard|rule|guideline|must|should always|always use|never use|style guide|policy)\b"),
    ("preference", r"\b(prefer|favou?r|i like|i dislike|avoid|rather than|over \w+|don''?t use)\b"),
    ("snippet", r"```|\b(snippet|helper|boilerplate|pattern for)\b"),
    ("project", r"\b(project|service|repo|repository|architecture|microservice|the stack|built with|runs on)\b"),
    ("identity", r"\b(i am|i''?m a|my name is|i work as|i''?m the|my role)\b"),
    ("entity", r"\b(owns|owner of|maintains|on the .+ team|reports to)\b"),
]
# Cues of a durable fact, of a contradiction, of a question that spans subjects.
FACT = r"'(?i)\b(remember|always|never|i prefer|we (?:use|decided|chose)|the convention|from now on|by default|note that|don''?t use)\b'"
NEGATION = r"'(?i)\b(no longer|not|instead|now use|switched to|deprecated|don''?t)\b'"
MULTIHOP = r"'(?i)\b(and|both|between|relate[ds]?|relationship|connection|across|versus|vs|compare|together)\b'"
# Secrets by kind.
SECRETS = [
    ("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]+?-----END[^\n]+-----"),
    ("openai-key", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}"), ("google-key", r"AIza[0-9A-Za-z\-_]{35}"), ("github-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("github-pat-fine", r"github_pat_[A-Za-z0-9_]{60,}"), ("slack-token", r"xox[baprs]-[A-Za-z0-9-]{10,}"), ("stripe-key", r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("aws-key", r"\bAKIA[0-9A-Z]{16}\b"), ("aws-temp-key", r"\bASIA[0-9A-Z]{16}\b"), ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("slack-app-token", r"\bxapp-[0-9]-[A-Za-z0-9-]{10,}\b"), ("gitlab-pat", r"\bglpat-[A-Za-z0-9_-]{20,}\b"), ("npm-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("do-token", r"\bdop_v1_[a-f0-9]{64}\b"), ("sendgrid-key", r"\bSG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b"), ("connection-uri", r"[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@[^\s]+"),
    ("assignment", r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|client[_-]?secret)\b\s*[:=]\s*\S+"),
]


def entities(c: str) -> str:
    """The subjects of a text, in order of first mention."""
    found = f"list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9.+#_-]*'), lambda t: regexp_replace(t, '[.+#_-]+$', ''))"
    return f"list_filter(list_distinct(list_transform(list_filter({found}, lambda t: length(t) >= 3 AND regexp_matches(t, '^[A-Z]|[.+#_0-9-]')), lambda t: lower(t))), lambda t: NOT list_contains({STOP}, t))"


def kind(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{k}'" for k, p in TYPES) + " ELSE 'fact' END"


def gate(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, {FACT}) THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN len(regexp_extract_all({c}, '\\S+')) BETWEEN 4 AND 400 THEN 0.2::DOUBLE ELSE 0 END)"


def against(c: str, type_: str) -> str:
    return f"(regexp_matches({c}, {NEGATION}) OR {type_} = 'identity')"


def multi_hop(c: str) -> str:
    return f"(regexp_matches({c}, {MULTIHOP}) OR len({entities(c)}) >= 2)"
