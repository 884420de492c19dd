"""Registered queries of the training-data operators, with DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, language_id, license_scan, quality, quality_rules, secret_scan
from .decontaminate import decontaminate
from .ngram_jaccard import ngram_jaccard
from .packing import pack
from .prefix_trie import ordered_turns, prefix_trie, with_shared_start
from .tables import read, vocabulary
from .token_counts import token_counts
from .url_filter import url_filter
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets reach Jaccard 0.75."""
    return ngram_jaccard(read(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in documents."""
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("found.n_hit") > 0).alias("contaminated"))


SQL["op9_decontaminate"] = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
occ AS (
  SELECT d.doc_id, d.i, d.k, iw.item_id
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k) d
  JOIN iw ON iw.k = d.k AND iw.win = list_slice(d.w, d.i, d.i + d.k - 1)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pieces of at most 4096 tokens, packed into sequences."""
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate of documents with its score."""
    docs = read(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the risk-controlled cutoffs."""
    found = quality_rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as formatted strings, and what they hold when read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{hard}'), (-7L, 1L, 'assistant', '{hard}') "
                     "AS t(conv_id, turn, role, text)")
    return chat_format.digests(chat_format.formatted(rows.unionByName(more)))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the allow and block rules on every page's url."""
    return url_filter(read(spark, sf_dir, "pages"), URL_RULES)


SQL["op2_url_filter"] = """
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
                                THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT page_id, host, path, rh || rp AS rule, v,
               row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
        FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, h.host, h.path, fit.rule, coalesce(fit.v, 'allow') AS verdict
FROM h LEFT JOIN fit ON fit.page_id = h.page_id AND fit.k = 1
"""

SQL["op7_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, row_number() OVER o AS k, lag(role) OVER o AS before FROM c
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + length(text) - length(replace(replace(replace(text, chr(92), ''), '<', ''), '[', ''))
           + CASE WHEN before IS NOT DISTINCT FROM role THEN 6
                  ELSE CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                       ELSE 18 + length(role) + length(role) - length(replace(replace(replace(role, chr(92), ''), '<', ''), '[', '')) END
             END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""

SQL["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^ 	-
]+') AS w FROM d),
tri AS (SELECT r, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT tri.r, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN twice USING (r, g)) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^ 	-
]') GROUP BY r),
m AS (SELECT w.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             coalesce(ln.n - ln.k, 0) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
grid(rule, c0, f, steps) AS (VALUES ('symbols', 4.0::DOUBLE, 0.75::DOUBLE, 20), ('duplicate_lines', 0.95, 0.85, 20),
     ('repeated_words', 0.95, 0.85, 20), ('word_length', 60.0, 0.85, 15), ('capitals', 0.95, 0.85, 20)),
pts AS (SELECT rule, k, round(c0 * power(f, k), 6) AS cut FROM (SELECT *, unnest(range(0, steps)) AS k FROM grid)),
v AS (SELECT r, doc_id, lang, 'symbols' AS rule, n_symbols / nullif(n_words, 0) AS v FROM m
      UNION ALL SELECT r, doc_id, lang, 'duplicate_lines', n_dup_lines / nullif(n_lines, 0) FROM m
      UNION ALL SELECT r, doc_id, lang, 'repeated_words', n_repeat_words / nullif(n_words, 0) FROM m
      UNION ALL SELECT r, doc_id, lang, 'word_length', word_chars / nullif(n_words, 0) FROM m
      UNION ALL SELECT r, doc_id, lang, 'capitals', n_capitals / nullif(word_chars, 0) FROM m),
hold AS (SELECT v.*, l.quality AS y FROM v JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1)),
tot AS (SELECT lang, rule, sum(y) AS n, sum(1 - y) AS nb FROM hold GROUP BY lang, rule),
tests AS (SELECT 0.05 / (5 * greatest(1, count(DISTINCT lang))) AS level FROM hold),
x AS (SELECT tot.lang, tot.rule, p.k, p.cut, n, nb,
             coalesce(sum(CASE WHEN h.v > p.cut THEN h.y END), 0) AS x, coalesce(sum(CASE WHEN h.v > p.cut THEN 1 - h.y END), 0) AS caught
      FROM tot JOIN pts p ON p.rule = tot.rule JOIN hold h ON h.rule = tot.rule AND h.lang = tot.lang
      GROUP BY tot.lang, tot.rule, p.k, p.cut, n, nb),
pv AS (SELECT *, CASE WHEN x < n * 0.01 THEN list_sum(list_transform(range(0, CAST(x AS BIGINT) + 1),
         lambda i: exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))))
         ELSE 1.0 END AS p FROM x),
ok AS (SELECT *, caught / greatest(nb, 1) - x / n AS gain, max(p) OVER (PARTITION BY lang, rule ORDER BY k) AS worst FROM pv),
best AS (SELECT lang, rule, cut FROM ok, tests WHERE worst <= level AND gain > 0
         QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, k) = 1),
bad AS (SELECT DISTINCT v.r FROM v JOIN best b ON b.lang = v.lang AND b.rule = v.rule WHERE v.v > b.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.r IS NULL AS kept
FROM m LEFT JOIN bad USING (r)
"""


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of documents, from whole-text encoding."""
    import public_tokenizers
    return token_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    docs = read(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit(docs))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable embedding."""
    found = whiten(read(spark, sf_dir, "embeddings"), components=4)
    at = F.col("component") - 1
    return (found.withColumn("component", F.explode(F.sequence(F.lit(1), F.size("z"))))
            .select("vec_id", "component", "n", "deviation", F.get("z", at).alias("whitened"),
                    F.get("explained", at).alias("explained"), "identity_error"))


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read(spark, sf_dir, "documents")
    return language_id.predicted(docs, language_id.fit(docs))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations with its members, leaves and saved words."""
    rows = read(spark, sf_dir, "conversations")
    return prefix_trie(with_shared_start(ordered_turns(rows)), rows.select("conv_id").filter("conv_id is not null").distinct())


SQL["op13_prefix_trie"] = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''),
                 lambda x: CAST(ascii(x) AS BIGINT))), lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT i.c, t.k, role, text FROM ids i JOIN t ON t.c = i.base AND t.k <= i.h
      UNION ALL SELECT i.c, t.k, role, text FROM ids i JOIN t ON t.c = i.c AND t.k > i.h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, sha256(role || chr(10) || text) AS s,
             len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM r),
p AS (SELECT c, d, words, sha256(string_agg(s, ',') OVER (PARTITION BY c ORDER BY d)) AS key FROM o
      UNION ALL SELECT c, 0, 0, '' FROM ids),
u AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, lead(key) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM p),
n AS (SELECT d, key, any_value(up) AS up, min(c) AS c, count(*) AS members, max(words) AS words,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends FROM u GROUP BY d, key),
kids AS (SELECT up AS key, count(*) AS k FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(kids.k, 0) AS n_children, (members - 1) * words AS saves FROM n LEFT JOIN kids USING (key)),
sub AS (SELECT a.key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved
        FROM (SELECT DISTINCT a.key AS key, b.key AS below FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d) a
        JOIN m ON m.key = a.below GROUP BY a.key)
SELECT m.c AS conv_id, m.d AS depth, up.c AS parent_conv_id, m.members AS n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m LEFT JOIN m up ON up.key = m.up AND m.d > 0 JOIN sub ON sub.key = m.key
"""
