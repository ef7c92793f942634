"""Queries over the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.session import ship

from . import chat, decontam, divergence, langid, minhash, mixing, packing, quality, sharding, sufdedup, tokcount, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, compression ratios and verdict of every document."""
    return quality.score(_table(spark, sf_dir, "documents"))


def op2_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the committed shards hold it."""
    out, _, version = sharding.shard(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"), "lang", "source", F.lit(version).cast("long").alias("version"))


OP2_SQL = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS text_md5, lang, source, CAST(2 AS BIGINT) AS version
FROM documents
"""


def op3_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


_LOWER_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) END AS s FROM d),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id
FROM sets JOIN low USING (doc_id)
"""


def op5_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover, and the items they come from."""
    return decontam.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
place AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, p, n, k, item_id FROM place JOIN win USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id),
run AS (SELECT doc_id, min(p) AS spot, count(*) + min(n) - 1 AS long FROM (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - k ORDER BY p) AS island FROM occ) GROUP BY doc_id, item_id, p - k, island),
best AS (SELECT doc_id, long, spot FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY long DESC, spot) = 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(long, 0) AS BIGINT) AS longest, CAST(spot - 1 AS BIGINT) AS longest_at
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op6_columnar_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one full of control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    return chat.digests(turns.unionByName(spark.sql(tricky)))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(role) + length(text)
    + len(regexp_extract_all(text, '[<\[]\\*(?:\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op7_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated 200-byte strings cover."""
    return sufdedup.removed(_table(spark, sf_dir, "documents"))


def op8_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from normalised archives."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept_id,
    list_transform(range(0, 8), lambda k: CAST(('0x' || substr(hex, CAST(k * 5 + 1 AS INT), 5)) AS BIGINT)) AS quanta FROM p
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((quanta[CAST(j // 4 + 1 AS INT)] >> CAST(15 - 5 * (j % 4) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept_id THEN NULL ELSE kept_id END AS refers_to
FROM b
"""


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of every document's source and the words that the mix takes of the document."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op10_separator_scan(spark: SparkSession, sf_dir: str, vocabulary: str = tokcount.VOCABULARY) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return tokcount.count(_table(spark, sf_dir, "documents"), vocabulary)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that set each apart."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
one AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM one GROUP BY ALL HAVING count(*) >= 10),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, sum(one.n) AS n FROM one SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, coalesce(sum(own.n), 0) AS total FROM grp LEFT JOIN own USING (lang, source) GROUP BY ALL),
share AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n,
    1 + (1000000000 * (coalesce(own.n, 0) + 2)) // (g.total + 2 * size.v) AS p, 1 + (1000000000 * (k.n + 2)) // (size.total + 2 * size.v) AS q
  FROM total g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS xs, y.source AS ys, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f
    FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND xs = a.source AND ys = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM share WHERE n > 0 AND p > q),
every AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 10
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations."""
    return trie.prefixes(_table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'k': {'role': role, 'text': text}, 'words': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}
  ORDER BY turn NULLS FIRST, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS t FROM turns GROUP BY conv_id),
crc AS (SELECT conv_id, s, k, v FROM (
  WITH RECURSIVE step AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM c
    UNION ALL SELECT conv_id, s, k + 1, list_reduce([xor(v, ascii(substr(s, k + 1, 1)))] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM step WHERE k < length(s))
  SELECT * FROM step WHERE k = length(s))),
h AS (SELECT conv_id, CAST(xor(v, 4294967295) % 4 AS INT) AS h FROM crc),
r AS (SELECT c.conv_id, coalesce(b.t[1:h], []) || c.t[h + 1:] AS t FROM c JOIN h USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
each AS (SELECT conv_id, len(t) AS size, d, list_transform(t[1:d], lambda x: x.k) AS path, CASE WHEN d = 0 THEN 0 ELSE t[d].words END AS words
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM r)),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY d, path) AS node FROM each),
node AS (SELECT d, node, count(*) AS n, max(words) AS words, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM named GROUP BY d, node),
up AS (SELECT DISTINCT a.d, a.node, b.node AS parent FROM named a JOIN named b ON a.conv_id = b.conv_id AND b.d = a.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM up GROUP BY ALL),
below AS (SELECT DISTINCT a.d, a.node, b.d AS bd, b.node AS bn FROM named a JOIN named b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT below.d, below.node, count(*) FILTER (kids.n IS NULL) AS leaves, sum((x.n - 1) * x.words) AS saved
  FROM below JOIN node x ON x.d = bd AND x.node = bn LEFT JOIN kids ON kids.d = bd AND kids.node = bn GROUP BY ALL)
SELECT node.node AS conv_id, CAST(node.d AS BIGINT) AS depth, parent AS parent_conv_id, node.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM node JOIN sums USING (d, node) LEFT JOIN kids USING (d, node) LEFT JOIN up ON up.d = node.d AND up.node = node.node
"""


def op13_concatenate_and_cut(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    return packing.pieces(_table(spark, sf_dir, "documents"), path=vocabulary)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_compression_bands, op2_tiered_compaction, op3_mixture_language_id, op4_tensored_minhash, op5_suffix_decontamination,
        op6_columnar_chat, op7_difference_cover_dedup, op8_gzip_normaliser, op9_cube_mixing, op10_separator_scan,
        op11_source_divergence, op12_prefix_trie, op13_concatenate_and_cut,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_tiered_compaction": OP2_SQL, "op4_tensored_minhash": OP4_SQL, "op5_suffix_decontamination": OP5_SQL, "op6_columnar_chat": OP6_SQL, "op8_gzip_normaliser": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_prefix_trie": OP12_SQL}
