"""Registered queries of the text operators and their DuckDB equivalents.

Each query applies one operator to its whole table and derives the columns
that are compared from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence.llm.decontam import contamination
from aircadence.llm.divergence import source_divergence
from aircadence.llm.html_extract import extract_main_text
from aircadence.llm.license_scan import license_scan, template_rows
from aircadence.llm.lm_score import cross_entropy_difference
from aircadence.llm.mixing import mixture_plan
from aircadence.llm.near_dedup import near_duplicates
from aircadence.llm.neighbours import nearest_neighbours
from aircadence.llm.prefix_trie import prefix_trie
from aircadence.llm.quality import quality_verdicts
from aircadence.llm.token_counts import corpus_token_counts
from aircadence.llm.token_files import token_digest
from aircadence.llm.url_filter import HOST_RULES, PATTERNS, judge_urls, pattern_regex


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, then the id's hundreds and, for every third, tens.

    Every tenth document is its directory's licence file, and some are those of
    a source or of the root.
    """
    docs = _table(spark, sf_dir, "documents")
    deep = F.when(F.col("doc_id") % 3 == 0, F.expr("CAST(doc_id div 10 AS STRING)"))
    low = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("CAST(doc_id div 100 AS STRING)"), deep)
    path = (
        F.when(F.col("doc_id") % 5000 == 11, F.lit("LICENSE"))
        .when(F.col("doc_id") % 500 == 7, F.concat_ws("/", F.coalesce("source", F.lit("none")), F.lit("COPYING.txt")))
        .when(F.col("doc_id") % 10 == 0, F.concat_ws("/", low, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", low, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    return license_scan(docs.withColumn("path", path), "doc_id", "path", "text")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_plan(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP1_SQL = f"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(CASE WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS w
  FROM iw WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents
), pos AS (
  SELECT doc_id, ws, k.k, unnest(range(1, len(ws) - k.k + 2)) AS p FROM dw CROSS JOIN (SELECT DISTINCT k FROM win) k WHERE len(ws) >= k.k
), hit AS (
  SELECT pos.doc_id, pos.p, pos.k, win.item_id FROM pos JOIN win ON win.k = pos.k AND win.w = array_to_string(pos.ws[pos.p:pos.p + pos.k - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.ws), 0) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w WHERE ws IS NOT NULL
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, g.b FROM reach r JOIN both_ways g ON r.b = g.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_OP5_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in HOST_RULES)
_OP5_HIT = " OR ".join(f"regexp_matches(u, '{pattern_regex(p)}')" for p in PATTERNS)

_OP5_SQL = f"""
WITH p AS (
  SELECT page_id, {_LOWER.replace("text", "coalesce(url, '')")} AS u,
    {_LOWER.replace("text", "regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, h, pre) AS (VALUES {_OP5_RULES}
), fit AS (
  SELECT p.page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM p JOIN rules ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN {_OP5_HIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""

_OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_SPACED})), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS n, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END) AS w FROM d GROUP BY source
), k AS (
  SELECT *, 2 * n AS cap, 2 * n / w AS full_at, (sum(n) OVER () * 1.5e0 - coalesce(sum(2 * n) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lvl
  FROM s WINDOW before AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, n, least(cap, (SELECT arg_min(lvl, (full_at, source)) FROM k WHERE lvl <= full_at) * w) AS target FROM k
), r AS (
  SELECT d.*, t.n, t.target, coalesce(t.target / nullif(t.n, 0), 0) AS rate,
    ('0x' || substr(md5('mix:0:' || coalesce('=' || d.source, '-')), 1, 12))::BIGINT / 281474976710656e0 AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 16 + (CASE WHEN length(bin(size)) >= 4 THEN size >> (length(bin(size)) - 4) ELSE size << (4 - length(bin(size))) END),
      ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT % 64, size, CAST(doc_id AS VARCHAR)) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST((floor(u + pos * rate) - floor(u + (pos - 1) * rate)) * size AS BIGINT) AS taken FROM r
"""

_OP3_WORDS = ", ".join(f"({k}, '{name}', {whole}, {shared}, '{w}', {tf})" for k, name, whole, shared, w, tf in template_rows())

_OP3_SQL = f"""
WITH tpl(template, license, whole, shared, word, tf) AS (VALUES {_OP3_WORDS}
), f AS (
  SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_matches(path, '(^|/)(LICENSE|COPYING.txt)$') AS is_license FROM (
    SELECT doc_id, text, CASE WHEN doc_id % 5000 = 11 THEN 'LICENSE' WHEN doc_id % 500 = 7 THEN coalesce(source, 'none') || '/COPYING.txt'
      ELSE concat_ws('/', coalesce(source, 'none'), CAST(doc_id // 100 AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id // 10 AS VARCHAR) END,
        CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END) END AS path FROM documents)
), df AS (
  SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM f) GROUP BY word
), idf AS (
  SELECT word, ln(((SELECT count(*) FROM documents) + 1e0) / (n + 1e0)) + 1 AS idf FROM df
), tw AS (
  SELECT template, license, whole, shared, tpl.word, tf * coalesce(idf, ln((SELECT count(*) FROM documents) + 1e0) + 1) AS w FROM tpl LEFT JOIN idf USING (word)
), ts AS (SELECT template, sum(w * w) AS square FROM tw GROUP BY template
), un AS (
  SELECT doc_id, false AS whole, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n([^A-Za-z0-9\\n]*\\n)+'))) AS unit FROM f
  UNION SELECT doc_id, true, text FROM f WHERE is_license AND text IS NOT NULL
), uw AS (
  SELECT whole, unit, word, count(*) * any_value(idf) AS v FROM (SELECT whole, unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS word FROM (SELECT DISTINCT whole, unit FROM un)) JOIN idf USING (word) GROUP BY ALL
), us AS (SELECT whole, unit, sum(v * v) AS square FROM uw GROUP BY ALL
), m AS (
  SELECT uw.whole, uw.unit, tw.license, tw.shared, any_value(ts.square) AS square, round(sum(v * w) / sqrt(any_value(us.square) * any_value(ts.square)), 6) AS cosine
  FROM uw JOIN tw ON tw.word = uw.word AND tw.whole = uw.whole JOIN ts USING (template) JOIN us ON us.unit = uw.unit AND us.whole = uw.whole
  GROUP BY uw.whole, uw.unit, tw.template, tw.license, tw.shared HAVING cosine >= 0.8
), own AS (
  SELECT doc_id, min((CAST(NOT m.whole AS INT), CAST(m.shared AS INT), -cosine, -square, license)) AS best FROM un JOIN m ON m.unit = un.unit AND m.whole = un.whole GROUP BY doc_id
), given AS (SELECT folder, min(best) AS best FROM f JOIN own USING (doc_id) WHERE is_license GROUP BY folder
), near AS (
  SELECT f.doc_id, arg_max(given.best, length(given.folder)) AS best
  FROM f JOIN given ON given.folder = '' OR f.folder = given.folder OR starts_with(f.folder, given.folder || '/') GROUP BY f.doc_id
)
SELECT f.doc_id, f.path, coalesce(own.best, near.best)[5] AS license, -coalesce(own.best, near.best)[3] AS cosine,
  CASE WHEN own.best IS NOT NULL THEN 'own' WHEN near.best IS NOT NULL THEN 'inherited' END AS origin
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
"""

_OP8_SQL = f"""
WITH t AS (
  SELECT doc_id, list_append(ws, '') AS ws FROM (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents) WHERE len(ws) > 0
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), s AS (
  SELECT t.doc_id, unnest(ws) AS w, unnest(list_prepend('', ws[1:len(ws) - 1])) AS v, len(ws) - 1 AS n_words, (good.doc_id IS NOT NULL)::INT AS g FROM t LEFT JOIN good ON good.doc_id = t.doc_id
), d1 AS (SELECT doc_id, w, any_value(g) AS g, count(*)::DOUBLE AS own FROM s GROUP BY doc_id, w
), d2 AS (SELECT doc_id, v, w, any_value(g) AS g, count(*)::DOUBLE AS own, any_value(n_words) AS n_words FROM s GROUP BY doc_id, v, w
), u AS (SELECT w, sum(own) AS n, sum(own * g) AS m FROM d1 GROUP BY w
), c AS (SELECT v, w, sum(own) AS n, sum(own * g) AS m FROM d2 GROUP BY v, w
), k AS (SELECT count(*) AS size, sum(m) / sum(n) AS scale, count(*) * 0.01e0 AS av FROM u
), e1 AS (
  SELECT doc_id, sum(own * (ln(((n - own) * scale + 1) / (m - own * g + 1)) - ln(((n - own) * scale + av) / (m - own * g + av)))) AS t FROM d1 JOIN u USING (w), k GROUP BY doc_id
), e2 AS (
  SELECT doc_id, any_value(n_words) AS n_words, sum(own * ln(((n - own) * scale + 0.01e0) / (m - own * g + 0.01e0))) AS t FROM d2 JOIN c USING (v, w), k GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(0.5e0 * (e1.t + e2.t) / (n_words + 1), 6) AS score FROM documents LEFT JOIN e1 USING (doc_id) LEFT JOIN e2 USING (doc_id)
"""

_OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), c AS (
  SELECT g.lang, g.source, kept.term, count(w.term)::HUGEINT AS n FROM g JOIN kept USING (lang)
  LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = kept.term GROUP BY ALL
), p AS (
  SELECT lang, source, term, c.n, 1 + 1000000000 * (c.n + 5) // (sum(c.n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v.v) AS p FROM c JOIN v USING (lang)
), q AS (SELECT lang, term, 1 + 1000000000 * (n + 5) // (total + 5 * v.v) AS q FROM kept JOIN v USING (lang)
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""

_OP12_SQL = rf"""
WITH tab AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda s, x: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), t AS (
  SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS k,
    coalesce(len(regexp_extract_all(text, {_SPACED})), 0) AS words FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT c, k, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM t
), h AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t), tab
), r AS (
  SELECT h.c, o.k, o.words, 0 AS own, o.pos FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.pos <= h.h
  UNION ALL SELECT h.c, o.k, o.words, 1, o.pos FROM h JOIN o ON o.c = h.c AND o.pos > h.h
), p AS (
  SELECT c, row_number() OVER w AS d, string_agg(k, '') OVER w AS path, words FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos)
  UNION ALL SELECT c, 0, '', 0 FROM h
), last AS (SELECT c, max(d) AS d FROM p GROUP BY c
), m AS (
  SELECT path, p.d, min(p.c) AS c, count(*) AS n, any_value(words) AS words,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE last.d = p.d), '')) AS ends FROM p JOIN last USING (c) GROUP BY path, p.d
), kids AS (SELECT path[1:32 * (d - 1)] AS above, count(*) AS kids FROM m WHERE d > 0 GROUP BY 1
), under AS (
  SELECT p.path, sum((kids.kids IS NULL)::INT) AS leaves, sum((m.n - 1) * m.words) AS saved
  FROM m LEFT JOIN kids ON kids.above = m.path JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY p.path
)
SELECT m.c AS conv_id, m.d AS depth, up.c AS parent_conv_id, m.n AS n_convs, coalesce(kids.kids, 0) AS n_children,
  CAST(under.leaves AS BIGINT) AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN under USING (path) LEFT JOIN kids ON kids.above = m.path LEFT JOIN m up ON m.d > 0 AND up.path = m.path[1:32 * (m.d - 1)]
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_license_scan": op3_license_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_token_output": op6_token_output,
    "op7_mixing": op7_mixing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

SQL = {
    "op1_decontamination": _OP1_SQL,
    "op3_license_scan": _OP3_SQL,
    "op4_near_dedup": _OP4_SQL,
    "op5_url_filter": _OP5_SQL,
    "op7_mixing": _OP7_SQL,
    "op8_lm_scoring": _OP8_SQL,
    "op11_source_divergence": _OP11_SQL,
    "op12_prefix_trie": _OP12_SQL,
}
