"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.op10_secrets import secrets
from narrata.llm.op11_divergence import divergence
from narrata.llm.op12_negatives import hard_negatives
from narrata.llm.op13_suffixes import suffix_dedup
from narrata.llm.op1_near import near_dedup
from narrata.llm.op2_substring import substring_dedup
from narrata.llm.op3_chunks import fingerprints
from narrata.llm.op4_pieces import pieces_of
from narrata.llm.op5_licenses import licenses
from narrata.llm.op6_language import languages
from narrata.llm.op7_toxicity import toxicity
from narrata.llm.op8_html import main_text
from narrata.llm.op9_decontaminate import contamination
from narrata.llm.store import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), texts=False)


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_fingerprints that SQL can state."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def license_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_licenses that SQL can state."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_secrets that SQL can state."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_licenses": op5_licenses,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
    "edited_texts": edited_texts,
    "license_bases": license_bases,
    "secret_counts": secret_counts,
}

SQL = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id""",
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13),
q AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS d FROM q GROUP BY s),
bad AS (SELECT DISTINCT q.doc_id, unnest(generate_series(q.i, q.i + 12)) AS j FROM q JOIN m USING (s) WHERE m.d < q.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM w),
k AS (SELECT words.doc_id, count(*) AS n, coalesce(string_agg(word, ' ' ORDER BY words.j), '') AS kept
      FROM words ANTI JOIN bad ON words.doc_id = bad.doc_id AND words.j = bad.j GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM c GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
o AS (SELECT c.lang, c.source, c.term, count(*) AS n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS n FROM o GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(o.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v.v) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (v.n + 5 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x QUALIFY part = 'pair' OR rank <= 50""",
    "op12_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT s.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY s.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
    "op13_suffix_dedup": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, unnest(generate_series(0, length(x) // 2 - 200)) AS i, x FROM t WHERE length(x) >= 400),
m AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS m FROM w),
b AS (SELECT r, i FROM m WHERE m IN (SELECT m FROM m GROUP BY m HAVING count(*) > 1)),
f AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM b),
n AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM f),
s AS (SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY r, k),
g AS (SELECT r, k, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY k), 0) AS before FROM s),
o AS (SELECT g.r, sum(z - a) AS gone, count(*) AS n, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) AS kept FROM g JOIN t ON g.r = t.r GROUP BY g.r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM t LEFT JOIN o ON t.r = o.r""",
    "edited_texts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) // 3 AS k, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM t WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - k) || substring(u, 1, k)) AS edited_sha256 FROM n""",
    "license_bases": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS (SELECT doc_id, len(ws) AS n, list_filter(generate_series(1, len(ws)), lambda i: ws[i] = 'mit' AND ws[i + 1] = 'license') AS m, list_filter(generate_series(1, len(ws)), lambda i: ws[i] = 'apache' AND ws[i + 1] = 'license') AS a,
             list_filter(generate_series(1, len(ws)), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS g FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(m) + len(a) + len(g) AS BIGINT) AS n_base, CAST(list_min(m || a || g) - 1 AS BIGINT) AS first_word, CAST(list_max(m || a || g) - 1 AS BIGINT) AS last_word,
       concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM h""",
    "secret_counts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex FROM t""",
}
