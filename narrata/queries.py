"""Registered queries over a folder of tables, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata import corpus, models
from narrata.corpus import PRELUDE
from narrata.functions import text as T
from narrata.operators import analysis as A
from narrata.operators import consolidate as C
from narrata.operators import filters as P
from narrata.operators import graph as G
from narrata.operators import search as S
from narrata.operators import segment as X
from narrata.operators import timeline as L
from narrata.plans import dag as D
from narrata.plans import jobs as J
from narrata.plans import library as B
from narrata.plans import retrieval as R
from narrata.streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (PRELUDE + ", " if prelude and sql.lstrip().startswith("t0 AS") else PRELUDE if prelude else "") + sql
        return f

    return add


def _first_vector(spark: SparkSession, folder: str) -> list[float]:
    """The query vector: that of vec_id 0."""
    return corpus.table(spark, folder, "embeddings").filter("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()[0]


PROGRESS = (P.SeriesProgress("src1", 2, None), P.SeriesProgress("src2", 1, 5), P.SeriesProgress(None, 2, 8))
READER, OPEN_READER = P.Visibility("en", PROGRESS), P.Visibility("en", PROGRESS, "SHOW")
_SIM = "round((1 + list_cosine_similarity(embedding, q.v)) / 2, 6)"
_READ = "(universe = 'en' AND ((series = 'src1' AND book_number <= 2) OR (series = 'src2' AND (book_number < 1 OR (book_number = 1 AND chapter_number <= 5))) OR (series IS NULL AND (book_number < 2 OR (book_number = 2 AND chapter_number <= 8)))))"
_LISTED = "(universe = 'en' AND (coalesce(series, '') IN ('src1', 'src2', '')))"
_SHOWN = f"coalesce({_READ}, false) OR (universe IS NOT NULL AND NOT {_LISTED})"
_HITS = "t0 AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), hits AS (SELECT c.*, " + _SIM + " AS score FROM chunks c, t0 q WHERE " + _SIM + " > 0)"
_COLUMNS = "chunk_id, score, universe, series, book_number, chapter_number"


def _result(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "score", "universe", "series", "book_number", "chapter_number")


# vector search


@query(f"""{_HITS}, cand AS (SELECT * FROM hits ORDER BY score DESC, chunk_id LIMIT 60),
keep AS (SELECT * FROM cand WHERE {_SHOWN} ORDER BY score DESC, chunk_id LIMIT 20),
names AS (SELECT chapter_id, array_to_string(list_sort(list_distinct(list(display_name))), ',') AS individuals FROM individuals GROUP BY 1)
SELECT {_COLUMNS}, coalesce(individuals, '') AS individuals FROM keep LEFT JOIN names USING (chapter_id)""")
def visible_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: best visible chunks of a reader with coordinates and the individuals of their chapter."""
    hits = S.semantic_search(corpus.chunks(spark, folder), _first_vector(spark, folder), 20, visibility=OPEN_READER)
    people = corpus.individuals(spark, folder).join(hits.select("chapter_id"), "chapter_id", "left_semi").groupBy("chapter_id").agg(F.array_join(F.array_sort(F.collect_set("display_name")), ",").alias("individuals"))
    return hits.join(people, "chapter_id", "left").select("chunk_id", "score", "universe", "series", "book_number", "chapter_number", F.coalesce("individuals", F.lit("")).alias("individuals"))


@query(f"""{_HITS} SELECT {_COLUMNS} FROM (SELECT * FROM hits ORDER BY score DESC, chunk_id LIMIT 60) WHERE {_READ} ORDER BY score DESC, chunk_id LIMIT 20""")
def visible_chunks_hide(spark: SparkSession, folder: str) -> DataFrame:
    return _result(S.semantic_search(corpus.chunks(spark, folder), _first_vector(spark, folder), 20, visibility=READER))


@query(f"""{_HITS} SELECT {_COLUMNS} FROM hits WHERE {_READ} ORDER BY score DESC, chunk_id LIMIT 20""")
def visible_chunks_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    return _result(S.semantic_search(corpus.chunks(spark, folder), _first_vector(spark, folder), 20, visibility=READER, mode="prefilter"))


@query(f"""{_HITS} SELECT {_COLUMNS} FROM (SELECT * FROM hits ORDER BY score DESC, chunk_id LIMIT 150) WHERE universe = 'en' AND score >= 0.55 ORDER BY score DESC, chunk_id LIMIT 50""")
def filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata filters (a series without its number stays out) and a threshold."""
    hits = S.semantic_search(corpus.chunks(spark, folder), _first_vector(spark, folder), 50, P.Filters("en", " ", 2, 7))
    return _result(hits.filter(F.col("score") >= 0.55))


_EVENTS = "t0 AS (SELECT chunk_id AS event_id, book_id, chapter_id, embedding FROM chunks WHERE chapter_id IS NOT NULL)"
_PAIRS = _EVENTS + """, p AS (SELECT a.book_id, a.event_id AS source, b.event_id AS target, round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2, 6) AS score
  FROM t0 a JOIN t0 b ON a.book_id = b.book_id AND a.event_id <> b.event_id AND a.chapter_id <> b.chapter_id),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM p WHERE score >= 0.55),
c AS (SELECT book_id, least(source, target) AS event_id_1, greatest(source, target) AS event_id_2, max(score) AS score FROM n WHERE r <= 8 GROUP BY 1, 2, 3)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chunks(spark, folder).filter("chapter_id is not null").select(F.col("chunk_id").alias("event_id"), "book_id", "chapter_id", "embedding")


@query(_PAIRS + " SELECT * FROM c")
def event_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest events of other chapters of the same book, unordered pairs with their best score."""
    return S.canonical_pairs(S.neighbours(_events(spark, folder), 8, 0.55), "book_id")


@query(_PAIRS + """, k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, event_id_1, event_id_2) AS n FROM c),
g AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS event_id_1, CAST(NULL AS BIGINT) AS event_id_2, CAST(NULL AS DOUBLE) AS score, false AS ok FROM c
UNION ALL SELECT book_id, n, CASE WHEN ok THEN used || [event_id_1, event_id_2] ELSE used END, event_id_1, event_id_2, score, ok FROM (
  SELECT k.*, g.used, len(list_filter(g.used, lambda x: x = k.event_id_1)) < 3 AND len(list_filter(g.used, lambda x: x = k.event_id_2)) < 3 AS ok FROM g JOIN k ON k.book_id = g.book_id AND k.n = g.n + 1))
SELECT book_id, event_id_1, event_id_2, score FROM g WHERE ok""")
def capped_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy by score: a pair stays while both its ends have fewer than three."""
    return S.cap_pairs(event_candidates(spark, folder), 3)


@query("""t0 AS (SELECT vec_id AS query_id, label AS kind, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT vec_id AS definition_id, label AS kind, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT query_id, definition_id, round(1 - list_cosine_similarity(t0.e, d.e), 6) AS distance FROM t0 JOIN d USING (kind)),
r AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(distance) OVER w <= distance * 1.10, false) AS near_miss FROM p WHERE distance < 0.9 WINDOW w AS (PARTITION BY query_id ORDER BY distance, definition_id))
SELECT query_id, definition_id, distance, CAST(rank AS INT) AS rank, near_miss FROM r WHERE rank <= 3""")
def catalog_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest catalog definitions of every hundredth vector by cosine distance, and whether the second is nearly as good."""
    e = corpus.table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("kind"), "embedding")
    catalog = e.select(F.col("vec_id").alias("definition_id"), F.col("label").alias("definition_kind"), F.col("embedding").alias("definition_embedding"))
    return S.catalog_matches(queries, catalog, 0.9)


_ASKED = "CASE WHEN vec_id % 300 <> 100 THEN label END"


@query(f"""t0 AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 300 = 0 THEN 'R:' || (vec_id + 1) ELSE 'Q:' || vec_id % 7 END AS definition_key, {_ASKED} AS kind, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT vec_id AS definition_id, 'R:' || vec_id AS definition_key, label AS kind, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT query_id, definition_id, round(1 - list_cosine_similarity(t0.e, d.e), 6) AS distance FROM t0 JOIN d USING (kind)),
n AS (SELECT query_id, arg_min(definition_id, (distance, definition_id)) AS near_id FROM p WHERE distance < 0.9 GROUP BY 1)
SELECT t0.query_id, t0.definition_key, coalesce(CAST(d.definition_id AS VARCHAR), CAST(near_id AS VARCHAR), 'new:' || min(t0.query_id) OVER (PARTITION BY t0.definition_key)) AS definition_id,
       CASE WHEN d.definition_id IS NOT NULL THEN 'EXACT' WHEN near_id IS NOT NULL THEN 'VECTOR' ELSE 'CREATED' END AS how
FROM t0 LEFT JOIN d USING (definition_key) LEFT JOIN n ON n.query_id = t0.query_id""")
def catalog_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Find or create definitions: exact key, vector match, new (some questions are of a kind that the catalog lacks)."""
    i = F.col("vec_id")
    e = corpus.table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    queries = e.filter(i % 100 == 0).select(
        i.alias("query_id"), F.when(i % 300 == 0, F.concat(F.lit("R:"), i + 1)).otherwise(F.concat(F.lit("Q:"), i % 7)).alias("definition_key"), F.expr(_ASKED).alias("kind"), "embedding"
    )
    catalog = e.select(i.alias("definition_id"), F.concat(F.lit("R:"), i).alias("definition_key"), F.col("label").alias("definition_kind"), F.col("embedding").alias("definition_embedding"))
    return C.find_or_create(queries.select("query_id", "definition_key"), catalog.select("definition_id", "definition_key"), S.catalog_matches(queries, catalog, 0.9))


_FUSED = _HITS + """, v AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, 1 AS b FROM (SELECT * FROM (SELECT * FROM hits ORDER BY score DESC, chunk_id LIMIT 60) WHERE """ + _SHOWN + """ ORDER BY score DESC, chunk_id LIMIT 20)),
g AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rank, 0 AS b FROM chunks WHERE (""" + _SHOWN + """) AND chapter_id IN (SELECT chapter_id FROM individuals WHERE normalized_name = 'eder') ORDER BY chunk_id LIMIT 20),
f AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS fused, count(*) AS branches, min(rank) AS best_rank, min(CASE WHEN b = 1 THEN rank END) AS first_rank FROM (SELECT * FROM v UNION ALL SELECT * FROM g) GROUP BY 1)
SELECT chunk_id, CAST(fused AS DOUBLE) AS fused, branches, CAST(best_rank AS INT) AS best_rank, CAST(first_rank AS INT) AS first_rank FROM f ORDER BY fused DESC, branches DESC, best_rank, first_rank NULLS LAST, chunk_id LIMIT 10"""


@query(_FUSED)
def hybrid_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Vector and graph branches fused by reciprocal rank."""
    return R.hybrid(corpus.chunks(spark, folder), corpus.individuals(spark, folder), _first_vector(spark, folder), "The Eder", 10, OPEN_READER)


@query(_HITS + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM hits ORDER BY score DESC, chunk_id LIMIT 20)),
names AS (SELECT chapter_id, count(DISTINCT lower(display_name)) AS n FROM individuals WHERE lower(display_name) IN ('the', 'eder', 'is') GROUP BY 1)
SELECT chunk_id, score, round(score + 0.05 * coalesce(n, 0), 6) AS boosted, CAST(rank AS INT) AS rank FROM r LEFT JOIN names USING (chapter_id)""")
def reranked(spark: SparkSession, folder: str) -> DataFrame:
    """Entity overlap moves results up; their scores stay."""
    hits = S.ranked(S.semantic_search(corpus.chunks(spark, folder), _first_vector(spark, folder), 20), 20)
    people = corpus.individuals(spark, folder).join(hits.select("chapter_id"), "chapter_id", "left_semi").groupBy("chapter_id").agg(F.collect_set("display_name").alias("names"))
    rows = hits.join(people, "chapter_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return S.rerank(rows, F.array(F.lit("The"), F.lit("eder"), F.lit("IS")), F.col("names")).select("chunk_id", "score", "boosted", "rank")


@query(_HITS + """ SELECT chunk_id, score, '[' || concat_ws(' / ', universe, series, 'Book ' || book_number, 'Chapter ' || chapter_number) || ']' AS location,
CASE WHEN length(snippet) <= 120 THEN snippet ELSE substring(snippet, 1, CASE WHEN strpos(reverse(substring(snippet, 1, 118)), ' ') > 0 AND 118 - strpos(reverse(substring(snippet, 1, 118)), ' ') >= 60
  THEN 118 - strpos(reverse(substring(snippet, 1, 118)), ' ') ELSE 117 END) || '...' END AS quote FROM hits ORDER BY score DESC, chunk_id LIMIT 20""")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    chunks = corpus.chunks(spark, folder)
    hits = S.semantic_search(chunks, _first_vector(spark, folder), 20).select("chunk_id", "score")
    return R.citations(hits, chunks).select("chunk_id", "score", "location", "quote")


# text functions

_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_WS = r"[ \t\n\x0B\f\r]+"


def _sql_name(c: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(regexp_replace({_TRIM.format(c)}, '{_WS}', ' ', 'g')), '[^a-z0-9 ]', '', 'g'), '^(the|a|an) ', '')"
    return f"CASE WHEN trim({s}) <> '' THEN {s} END"


@query(f"""SELECT conv_id, turn, {_sql_name('text')} AS name, {_TRIM.format(f"regexp_replace(lower(text), '[^a-z0-9 {chr(92)}t{chr(92)}n{chr(92)}x0B{chr(92)}f{chr(92)}r]', '', 'g')").join(["regexp_replace(", f", '{_WS}', '_', 'g')"])} AS slug,
coalesce(CASE WHEN length(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g')) > 200 THEN substring(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 200) || '...' ELSE regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g') END, 'null') AS error,
CASE WHEN length(text) <= 50 THEN text ELSE substring(text, 1, 49) || '…' END AS short, sha256(text) AS hash,
CASE WHEN {_TRIM.format('text')} = '' THEN 0 ELSE CAST(greatest(ceil(length(text) / 3.0), ceil(len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '')) * CAST(1.35 AS DOUBLE)), 1) AS INT) END AS tokens,
replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM conversations""", prelude=False)
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return corpus.table(spark, folder, "conversations").select(
        "conv_id", "turn", T.normalize_name(t).alias("name"), T.slug(t).alias("slug"), T.sanitize_error(t).alias("error"), T.truncate(t, 50).alias("short"),
        T.content_hash(t).alias("hash"), T.tokens(t).alias("tokens"), T.escape_xml(t).alias("xml"),
    )


_QUESTION = "(CASE CAST(item_id AS INT) % 6 WHEN 0 THEN 'Who is ' WHEN 1 THEN 'tell me about ' WHEN 2 THEN 'Why did ' WHEN 3 THEN 'where was ' WHEN 4 THEN 'Describe ' ELSE '' END || substring(text, 1, 30) || '?!')"


@query(f"""t0 AS (SELECT item_id, {_QUESTION} AS q FROM benchmark)
SELECT item_id, CASE WHEN {_TRIM.format('q')} = '' THEN 'AMBIGUOUS' WHEN regexp_matches(lower({_TRIM.format('q')}), '^(who|what|where)\\s+(is|was)\\b|^describe\\b|^tell\\s+me\\s+about\\b') THEN 'ENTITY_LOOKUP' ELSE 'NARRATIVE_QA' END AS intent,
nullif({_TRIM.format(f"regexp_replace({_TRIM.format(f"regexp_replace({_TRIM.format('q')}, '(?i)^(tell me about |describe |(who|what|where) (is|was) )', '')")}, '[?!.,;:]+$', '')")}, '') AS subject FROM t0""")
def question_intents(spark: SparkSession, folder: str) -> DataFrame:
    opening = F.element_at(F.array(*[F.lit(x) for x in ("Who is ", "tell me about ", "Why did ", "where was ", "Describe ", "")]), (F.col("item_id") % 6 + 1).cast("int"))
    q = F.concat(opening, F.substring("text", 1, 30), F.lit("?!"))
    return corpus.table(spark, folder, "benchmark").select("item_id", T.intent(q).alias("intent"), T.subject(q).alias("subject"))


@query("""SELECT o_orderkey AS id, 'R:' || coalesce(nullif(regexp_replace(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9 ]', ' ', 'g')), ' +', '_', 'g'), ''), 'unparseable') AS definition_key,
CASE WHEN o_orderpriority LIKE '%URGENT%' THEN CAST(0.95 AS DOUBLE) WHEN o_orderpriority LIKE '%HIGH%' THEN 0.8 ELSE 0.6 END AS weight,
lower(replace(o_orderpriority, '_', '-')) AS segment,
greatest(0.0, least(1.0, o_totalprice / 200000 - 0.5)) AS confidence FROM orders""", prelude=False)
def label_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Definition keys, certainty and weights, confidences, URL segments."""
    p = F.col("o_orderpriority")
    said = F.when(p.contains("URGENT"), "this is EXPLICIT").when(p.contains("HIGH"), "strongly implied").otherwise("implied")
    return corpus.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), T.definition_key(p).alias("definition_key"), T.certainty_weight(T.certainty(said)).alias("weight"), T.url_segment(p).alias("segment"),
        T.confidence(F.col("o_totalprice") / 200000 - 0.5).alias("confidence"),
    )


# library


@query("""SELECT universe, series, book_number, book_id, count(*) AS chapter_count, min(chapter_number) AS first_chapter, max(chapter_number) AS last_chapter,
trim(coalesce(series || ' ', '') || '#' || book_number || ' ' || book_id) AS label FROM chapters GROUP BY universe, series, book_number, book_id""")
def library_books(spark: SparkSession, folder: str) -> DataFrame:
    return B.books(corpus.chapters(spark, folder))


@query("""t0 AS (SELECT universe, series, string_agg(printf('%03d', book_number), ' ' ORDER BY book_number) AS numbers, count(*) AS n FROM (SELECT DISTINCT universe, series, book_number FROM chapters) GROUP BY 1, 2)
SELECT universe, CAST(sum(n) AS BIGINT) AS books, count(series) AS series, coalesce(max(CASE WHEN series IS NULL THEN numbers END), '') AS standalone,
coalesce(string_agg(series || ':' || numbers, '; ' ORDER BY series || ':' || numbers), '') AS shelves FROM t0 GROUP BY universe""")
def library_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return B.hierarchy(corpus.chapters(spark, folder))


@query("""SELECT book_id, chapter_number, chapter_id, count(scene_id) AS scene_count FROM chapters LEFT JOIN scenes USING (chapter_id) GROUP BY 1, 2, 3""")
def chapter_scene_counts(spark: SparkSession, folder: str) -> DataFrame:
    return B.chapters_with_scenes(corpus.chapters(spark, folder), corpus.scenes(spark, folder))


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS chapter_id FROM documents GROUP BY 1 HAVING max(CAST(doc_id % 7 = 0 AS INT)) = 0""", prelude=False)
def submitted_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters to create: content not known yet, of equal texts one."""
    d = corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("chapter_id"), "text")
    known = d.filter("chapter_id % 7 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return B.submit(d, known)


@query("""SELECT min(source) AS name FROM documents WHERE lower(source) NOT IN ('src3', 'src4') GROUP BY lower(trim(source))""", prelude=False)
def created_series(spark: SparkSession, folder: str) -> DataFrame:
    names = corpus.table(spark, folder, "documents").select(F.col("source").alias("name"))
    return B.create(names, spark.createDataFrame([("SRC3",), ("src4",)], "name string"))


@query("""SELECT chapter_id, universe || '/' || coalesce(series, '') || '/' || printf('%03d', book_number) || '/' || printf('%05d', chapter_number) AS publication_id FROM chapters""")
def publication_ids(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chapters(spark, folder).select("chapter_id", T.publication_id(F.col("universe"), F.col("series"), F.col("book_number"), F.col("chapter_number")).alias("publication_id"))


@query("""SELECT book_id, count(DISTINCT chapter_id) AS chapters, count(*) AS mentions, count(DISTINCT normalized_name) AS names, bool_or(normalized_name = 'the') AS has_the
FROM individuals JOIN chapters USING (chapter_id) GROUP BY book_id""")
def book_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.individuals(spark, folder).join(corpus.chapters(spark, folder).select("chapter_id", "book_id"), "chapter_id")
    return rows.groupBy("book_id").agg(F.count_distinct("chapter_id").alias("chapters"), F.count("*").alias("mentions"), F.count_distinct("normalized_name").alias("names"), F.bool_or(F.col("normalized_name") == "the").alias("has_the"))


# templates


@query("""SELECT book_id, min(display_name) AS display_name, count(*) AS mention_count, count(DISTINCT chapter_id) AS chapter_count, count(DISTINCT scene_id) AS scene_count
FROM individuals JOIN chapters USING (chapter_id) WHERE normalized_name = 'eder' AND (""" + _SHOWN + ") GROUP BY book_id")
def individual_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return R.entity_lookup(corpus.individuals(spark, folder), corpus.chapters(spark, folder), "the Eder", OPEN_READER)


@query("""SELECT book_id, min(display_name) AS display_name, count(*) AS mention_count, count(DISTINCT chapter_id) AS chapter_count, count(DISTINCT scene_id) AS scene_count
FROM locations JOIN chapters USING (chapter_id) WHERE normalized_name = 'is' GROUP BY book_id""")
def location_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return R.entity_lookup(corpus.locations(spark, folder), corpus.chapters(spark, folder), "Is")


@query("""SELECT DISTINCT chapter_id, scene_id, scene_index, book_id, chapter_number FROM individuals JOIN chapters USING (chapter_id) WHERE normalized_name = 'eder'
ORDER BY book_id, chapter_number, scene_index LIMIT 20""")
def individual_scenes(spark: SparkSession, folder: str) -> DataFrame:
    return R.entity_scenes(corpus.individuals(spark, folder), corpus.chapters(spark, folder), "Eder")


@query("""SELECT DISTINCT a.chapter_id, a.scene_id, a.scene_index FROM individuals a JOIN individuals b USING (scene_id) WHERE a.normalized_name = 'to' AND b.normalized_name = 'of'""")
def co_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return R.co_occurrence(corpus.individuals(spark, folder), "To", "OF").select("chapter_id", "scene_id", "scene_index")


@query("""SELECT book_id, normalized_name, f.c AS chapter_number, f.i AS scene_index, f.s AS scene_id FROM (
SELECT book_id, normalized_name, min({'c': chapter_number, 'i': scene_index, 's': scene_id}) AS f FROM individuals JOIN chapters USING (chapter_id) GROUP BY 1, 2)""")
def first_appearance(spark: SparkSession, folder: str) -> DataFrame:
    return R.first_appearance(corpus.individuals(spark, folder), corpus.chapters(spark, folder))


# timeline


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.chapters(spark, folder).select("chapter_id", "book_id", "chapter_number")
    return corpus.scenes(spark, folder).select("chapter_id", "scene_index", "scene_id").join(c, "chapter_id")


@query("""t0 AS (SELECT book_id, chapter_number, chapter_id, scene_index, scene_id FROM scenes JOIN chapters USING (chapter_id)),
i AS (SELECT book_id, scene_id AS from_id, lead(scene_id) OVER (PARTITION BY chapter_id ORDER BY scene_index) AS to_id, 'in_chapter' AS source FROM t0),
e AS (SELECT book_id, chapter_number, arg_min(scene_id, scene_index) AS head, arg_max(scene_id, scene_index) AS tail FROM t0 GROUP BY 1, 2)
SELECT * FROM i WHERE to_id IS NOT NULL UNION ALL SELECT a.book_id, a.tail, b.head, 'cross_chapter' FROM e a JOIN e b ON a.book_id = b.book_id AND b.chapter_number = a.chapter_number + 1""")
def reading_edges(spark: SparkSession, folder: str) -> DataFrame:
    return L.reading_edges(_placed(spark, folder))


@query("""SELECT book_id, lag(scene_id) OVER w AS previous_id, scene_id AS current_id, lead(scene_id) OVER w AS next_id FROM scenes JOIN chapters USING (chapter_id)
WINDOW w AS (PARTITION BY book_id ORDER BY chapter_number, scene_index)""")
def scene_triads(spark: SparkSession, folder: str) -> DataFrame:
    return L.triads(_placed(spark, folder))


@query("""t0 AS (SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY scene_index) - 1 AS n, count(*) OVER (PARTITION BY chapter_id) AS m,
list(scene_id) OVER (PARTITION BY chapter_id ORDER BY scene_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ids FROM scenes)
SELECT chapter_id, CAST(n AS INT) AS "window", array_to_string(ids, ',') AS scene_ids FROM t0 WHERE len(ids) = 3 OR (m < 3 AND n = 0)""")
def coreference_windows(spark: SparkSession, folder: str) -> DataFrame:
    return L.windows(corpus.scenes(spark, folder)).withColumn("scene_ids", F.array_join("scene_ids", ","))


@query("""t0 AS (SELECT chapter_id, (scene_index * 37) % 1009 AS start_offset, 5000 AS text_length FROM scenes)
SELECT chapter_id, start_offset, text_length, CAST(row_number() OVER w - 1 AS INT) AS scene_number, coalesce(lead(start_offset) OVER w, text_length) AS end_offset,
lag(start_offset) OVER w IS NULL AS is_first, lead(start_offset) OVER w IS NULL AS is_last FROM t0 WINDOW w AS (PARTITION BY chapter_id ORDER BY start_offset)""")
def scene_bounds(spark: SparkSession, folder: str) -> DataFrame:
    s = corpus.scenes(spark, folder).select("chapter_id", (F.col("scene_index") * 37 % 1009).alias("start_offset"), F.lit(5000).alias("text_length"))
    return L.bounds(s)


_KINDS = ("before", "after", "meets", "met_by", "overlaps", "overlapped_by", "starts", "started_by", "during", "contains", "finishes", "finished_by", "equals")
_RELATIONS = "t0 AS (SELECT event_id AS seq, user_id AS from_id, user_id + 1 + event_id % 5 AS to_id, list_extract([" + ", ".join(f"'{k}'" for k in _KINDS) + "], CAST(event_id % 13 + 1 AS INT)) AS kind FROM events)"


def _relations(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit("R:temporal." + k) for k in _KINDS]), (F.col("event_id") % 13 + 1).cast("int"))
    return corpus.table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("from_id"), (F.col("user_id") + 1 + F.col("event_id") % 5).alias("to_id"), kind.alias("temporal_type"), F.lit("Explicit").alias("certainty"))


@query(_RELATIONS + """ SELECT seq, CASE WHEN kind IN ('after', 'met_by', 'overlapped_by', 'started_by', 'contains', 'finished_by') THEN to_id ELSE from_id END AS from_id,
CASE WHEN kind IN ('after', 'met_by', 'overlapped_by', 'started_by', 'contains', 'finished_by') THEN from_id ELSE to_id END AS to_id,
'R:temporal.' || CASE WHEN kind IN ('before', 'after', 'meets', 'met_by') THEN 'before' WHEN kind LIKE 'overlap%' OR kind = 'equals' THEN 'overlaps' WHEN kind LIKE 'start%' THEN 'starts' WHEN kind IN ('during', 'contains') THEN 'during' ELSE 'finishes' END AS temporal_type FROM t0""")
def canonical_relations(spark: SparkSession, folder: str) -> DataFrame:
    return L.canonical(_relations(spark, folder)).drop("certainty")


_FOLDED = _RELATIONS + """, q AS (SELECT *, least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, kind IN ('after', 'met_by', 'overlapped_by', 'started_by', 'contains', 'finished_by') AS swap,
  CASE WHEN kind IN ('before', 'after', 'meets', 'met_by') THEN 'before' WHEN kind LIKE 'overlap%' OR kind = 'equals' THEN 'overlaps' WHEN kind LIKE 'start%' THEN 'starts' WHEN kind IN ('during', 'contains') THEN 'during' ELSE 'finishes' END AS t FROM t0),
w AS (SELECT *, from_id = a AS raw_up, (from_id = a) <> swap AS up, row_number() OVER (PARTITION BY a, b ORDER BY seq) AS n FROM q),
f AS (SELECT DISTINCT a, b, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS have, CAST(NULL AS BOOLEAN) AS way, 0 AS clashes, CAST(NULL AS BIGINT) AS seq, false AS up, CAST(NULL AS VARCHAR) AS t, CAST(NULL AS VARCHAR) AS old, false AS refused FROM w
UNION ALL SELECT a, b, n, coalesce(kept, have), CASE WHEN kept IS NULL THEN way ELSE up END, clashes + CAST(kept IS NULL AS INT), seq, CASE WHEN inside THEN raw_up ELSE up END, CASE WHEN inside THEN 'contains' ELSE t END, have, kept IS NULL FROM (
  SELECT *, CASE WHEN inside THEN NULL WHEN have IS NULL OR have = t OR (have = 'overlaps' AND t = 'during') THEN t WHEN have = 'during' AND t = 'overlaps' THEN have END AS kept FROM (
    SELECT w.*, f.have, f.way, f.clashes, coalesce(w.kind = 'contains' AND f.have = 'during' AND f.way = w.raw_up, false) AS inside FROM f JOIN w ON w.a = f.a AND w.b = f.b AND w.n = f.n + 1)))"""


@query(_FOLDED + """, l AS (SELECT a, b, arg_max({'t': have, 'w': way, 'c': clashes}, n) AS s FROM f GROUP BY 1, 2)
SELECT CASE WHEN s.w THEN a ELSE b END AS from_id, CASE WHEN s.w THEN b ELSE a END AS to_id, 'R:temporal.' || s.t AS temporal_type, 'Explicit' AS certainty, CAST(s.c AS BIGINT) AS ambiguous FROM l""")
def reconciled_relations(spark: SparkSession, folder: str) -> DataFrame:
    """One edge for each pair, from requests in order of arrival."""
    return L.reconcile(_relations(spark, folder))


@query(_FOLDED + """ SELECT seq, CASE WHEN up THEN a ELSE b END AS from_id, CASE WHEN up THEN b ELSE a END AS to_id, 'R:temporal.' || t AS incoming_type, 'R:temporal.' || old AS existing_type, 'Explicit' AS certainty FROM f
WHERE refused QUALIFY row_number() OVER (PARTITION BY a, b, up ORDER BY seq DESC) = 1""")
def ambiguous_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The last request of each direction that contradicted what stood there."""
    return L.ambiguous_relations(_relations(spark, folder))


@query()
def story_order(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes of each book in story order: all edges of the reading order, some of them turned round.

    No SQL: an order in which each step depends on all before is too slow there; `tests/test_engine.py` compares with a plain version.
    """
    placed = _placed(spark, folder).select("book_id", "scene_id", F.col("chapter_number").alias("chapter_rank"), "scene_index")
    at = F.split("from_id", ":")
    edges = L.reading_edges(_placed(spark, folder)).withColumn("back", (F.get(at, F.lit(0)).cast("long") * 7 + F.get(at, F.lit(1)).cast("long")) % 11 == 0)
    edges = edges.select("book_id", F.when(F.col("back"), F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(F.col("back"), F.col("from_id")).otherwise(F.col("to_id")).alias("to_id"))
    return G.topological(placed, edges, "book_id")


@query("""t0 AS (SELECT DISTINCT user_id AS from_id, user_id + 1 AS to_id FROM events WHERE event_type = 'view'), s AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 OR event_type = 'click' AND user_id % 3 = 0)
SELECT from_id, to_id FROM t0 WHERE from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM s)""")
def induced_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.table(spark, folder, "events")
    edges = e.filter("event_type = 'view'").select(F.col("user_id").alias("from_id"), (F.col("user_id") + 1).alias("to_id"))
    scope = e.filter("event_type = 'purchase' and user_id % 2 = 0 or event_type = 'click' and user_id % 3 = 0").select(F.col("user_id").alias("id"))
    return G.induced(edges, scope)


# consolidation

_KEYED = """t0 AS (SELECT chapter_id, scene_id || '#' || extraction_index AS id, scene_index * 100000 + extraction_index AS rank, display_name, normalized_name FROM individuals),
k AS (SELECT chapter_id, id, normalized_name AS key FROM t0 UNION ALL SELECT chapter_id, id, substring(normalized_name, 1, 4) || '*' FROM t0),
names AS (SELECT DISTINCT chapter_id, normalized_name, substring(normalized_name, 1, 4) AS stem FROM t0)"""


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    m = corpus.individuals(spark, folder)
    return m.select(
        "chapter_id", F.concat_ws("#", "scene_id", "extraction_index").alias("id"), (F.col("scene_index") * 100000 + F.col("extraction_index")).alias("rank"), "display_name", "normalized_name",
        F.array("display_name").alias("aliases"), F.array(F.col("normalized_name"), F.concat(F.substring("normalized_name", 1, 4), F.lit("*"))).alias("keys"),
    )


@query(_KEYED + """, f AS (SELECT chapter_id, substring(normalized_name, 1, 4) AS stem, arg_min(display_name, (rank, id)) AS display_name, arg_min(normalized_name, (rank, id)) AS normalized_name, count(*) AS mention_count, min(id) AS cluster FROM t0 GROUP BY 1, 2),
a AS (SELECT chapter_id, stem, string_agg(display_name, ',' ORDER BY r) AS aliases FROM (SELECT chapter_id, substring(normalized_name, 1, 4) AS stem, display_name, min((rank, id)) AS r FROM t0 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT chapter_id AS scope, cluster, display_name, normalized_name, aliases, mention_count FROM f JOIN a USING (chapter_id, stem)""")
def chapter_individuals(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions that share a name or a stem become one entity of their chapter (here each cluster is a stem)."""
    return C.consolidate(_mentions(spark, folder), "chapter_id").select("scope", "cluster", "display_name", "normalized_name", F.array_join("aliases", ",").alias("aliases"), "mention_count")


@query(_KEYED + """, c AS (SELECT chapter_id, substring(normalized_name, 1, 4) AS stem, count(*) AS mention_count, min(id) AS cluster FROM t0 GROUP BY 1, 2)
SELECT book_id AS scope, stem, count(*) AS chapters, CAST(sum(mention_count) AS BIGINT) AS mentions FROM c JOIN chapters USING (chapter_id) GROUP BY 1, 2""")
def book_individuals(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter entities to book entities by the same keys."""
    ch = C.consolidate(_mentions(spark, folder), "chapter_id")
    books = corpus.chapters(spark, folder).select(F.col("chapter_id").alias("scope"), "book_id", "chapter_number")
    stem = F.substring("normalized_name", 1, 4)
    rows = ch.join(books, "scope").select(
        "book_id", F.concat_ws("/", "scope", "cluster").alias("id"), F.col("chapter_number").alias("rank"), "display_name", "normalized_name", "aliases",
        F.array_distinct(F.concat(F.transform("aliases", F.lower), F.array(F.concat(stem, F.lit("*"))))).alias("keys"), "mention_count",
    )
    parts = G.cut(rows.groupBy(F.col("book_id").alias("scope"), C.key_set(F.col("keys")).alias("keys")).agg(F.min("id").alias("rep"), F.min(stem).alias("stem"), F.count("*").alias("chapters"), F.sum("mention_count").alias("mentions")))
    joined = parts.join(G.set_clusters(parts.select("scope", "keys", "rep")), ["scope", "keys"])
    return joined.groupBy("scope", "cluster").agg(F.min("stem").alias("stem"), F.sum("chapters").alias("chapters"), F.sum("mentions").alias("mentions")).drop("cluster")


_SAME = """t0 AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND round((1 + list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2, 6) >= 0.68),
e AS (SELECT a, b FROM t0 UNION ALL SELECT b, a FROM t0),
r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)"""


@query(_SAME + " SELECT node, min(other) AS component FROM r GROUP BY node")
def same_event_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of links between similar events of one label; the smallest id names a component."""
    e = corpus.table(spark, folder, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("kind"), "embedding")
    links = S.similar_pairs(e, 0.68).select(F.col("source").alias("a"), F.col("target").alias("b"))
    return G.min_labels(links, e.select(F.col("id").alias("node")))


@query("""t0 AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type, string_agg(event_type || '=' || n, ', ' ORDER BY event_type || '=' || n) AS relations FROM t0 GROUP BY user_id""")
def event_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent value with the smallest of equals, and a histogram."""
    e = corpus.table(spark, folder, "events")
    counts = e.groupBy("user_id", "event_type").count()
    mode = e.groupBy("user_id").agg(C.most_frequent("event_type").alias("event_type"))
    bars = counts.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", "count"))), ", ").alias("relations"))
    return mode.join(bars, "user_id")


@query(f"""t0 AS (SELECT chunk_id % 7 AS chapter_id, chunk_id AS id, 'Event ' || label AS display_name, 'event ' || label AS normalized_name, universe AS event_type, series,
  nullif({_TRIM.format("substring(snippet, 1, 20)")}, '') AS evidence, nullif({_TRIM.format("substring(snippet, 1, 12)")}, '') AS description, CASE chunk_id % 2 WHEN 0 THEN 'during' ELSE 'before' END AS relation FROM chunks WHERE chapter_id IS NOT NULL),
g AS (SELECT chapter_id, display_name, normalized_name, min(id) AS component, count(*) AS mention_count,
  list_sort(list_distinct(list(series) FILTER (series IS NOT NULL) || [display_name, normalized_name])) AS aliases, coalesce(list_sort(list_distinct(list(event_type) FILTER (event_type IS NOT NULL))), []) AS event_types,
  coalesce(list_sort(list_distinct(list(evidence) FILTER (evidence IS NOT NULL)))[1:4], []) AS evidence FROM t0 GROUP BY 1, 2, 3),
y AS (SELECT chapter_id, display_name, arg_min(event_type, (-n, event_type)) AS event_type FROM (SELECT chapter_id, display_name, event_type, count(*) AS n FROM t0 WHERE event_type IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
h AS (SELECT chapter_id, display_name, string_agg(relation || '=' || n, ', ' ORDER BY relation || '=' || n) AS relations FROM (SELECT chapter_id, display_name, relation, count(*) AS n FROM t0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT chapter_id, display_name, list(description ORDER BY i)[1:4] AS descriptions FROM (SELECT chapter_id, display_name, description, min(id) AS i FROM t0 WHERE description IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT chapter_id, component, g.display_name, normalized_name, event_type, mention_count, array_to_string(aliases, '|') AS aliases, array_to_string(event_types, '|') AS event_types, array_to_string(evidence, '|') AS evidence,
  array_to_string(coalesce(descriptions, []), '|') AS descriptions, relations, concat_ws(chr(10), '# ' || g.display_name, 'type: ' || event_type, 'aliases: ' || array_to_string(aliases, ', '), 'relations: ' || relations, CASE WHEN len(descriptions) > 0 THEN '- ' || array_to_string(descriptions, chr(10) || '- ') END) AS card
FROM g LEFT JOIN y USING (chapter_id, display_name) LEFT JOIN h USING (chapter_id, display_name) LEFT JOIN s USING (chapter_id, display_name)""")
def chapter_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event entities with aliases, evidence and cards from co-reference links."""
    c = corpus.chunks(spark, folder).filter("chapter_id is not null")
    m = c.select(
        (F.col("chunk_id") % 7).alias("chapter_id"), F.col("chunk_id").alias("id"), F.col("chunk_id").alias("rank"), F.concat(F.lit("Event "), F.col("label")).alias("display_name"), F.concat(F.lit("event "), F.col("label")).alias("normalized_name"),
        F.col("universe").alias("event_type"), F.array(F.col("series")).alias("aliases"), F.substring("snippet", 1, 20).alias("evidence"), F.substring("snippet", 1, 12).alias("description"), F.element_at(F.array(F.lit("during"), F.lit("before")), (F.col("chunk_id") % 2 + 1).cast("int")).alias("relation"),
    )
    links = m.groupBy("chapter_id", "display_name").agg(F.min("id").alias("a")).join(m, ["chapter_id", "display_name"]).select("a", F.col("id").alias("b"))
    return C.event_entities(m, links).withColumns({c: F.array_join(c, "|") for c in ("aliases", "event_types", "evidence", "descriptions")})


@query("""SELECT vec_id % 2 = 0 AS even, count(*) FILTER (embedding IS NOT NULL) AS embedded FROM embeddings GROUP BY 1""", prelude=False)
def embedded_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.table(spark, folder, "embeddings").groupBy((F.col("vec_id") % 2 == 0).alias("even")).agg(F.count("embedding").alias("embedded"))


@query(_PAIRS + " SELECT count(*) FILTER (score >= 0.6) AS merged, count(*) FILTER (score < 0.6) AS kept_separate, CAST(0 AS BIGINT) AS unresolved FROM c")
def merge_tallies(spark: SparkSession, folder: str) -> DataFrame:
    pairs = event_candidates(spark, folder)
    events = _events(spark, folder).select("event_id", F.concat(F.lit("card "), F.col("event_id")).alias("card"))
    return C.tallies(C.verdicts(pairs, events, models.merge_above(0.6)))


# jobs


@query("""t0 AS (SELECT job_id, bool_or(step = 7 AND status = 'COMPLETED') AS done, bool_or(status = 'FAILED') AS failed, min(CASE WHEN status NOT IN ('COMPLETED', 'SKIPPED', 'FAILED') THEN step END) AS open,
count(*) FILTER (status IN ('COMPLETED', 'SKIPPED', 'FAILED')) AS ended, count(*) AS total, max(CASE WHEN step = 7 THEN triggered_at END) AS last_at, max(triggered_at) AS any_at FROM stages GROUP BY 1),
s AS (SELECT *, CASE WHEN done THEN 'COMPLETE' WHEN failed THEN 'FAILED' WHEN open IS NOT NULL THEN CAST(open AS VARCHAR) ELSE 'COMPLETE' END AS status FROM t0)
SELECT job_id, status, CASE WHEN status = 'FAILED' THEN -1 ELSE CAST(floor(ended * 100 / total) AS INT) END AS progress_percent, coalesce(last_at, any_at) AS completed_at FROM s""")
def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return J.summaries(corpus.stages(spark, folder), 7)


@query("""SELECT job_id, created_at, chapter_id FROM jobs WHERE chapter_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY created_at DESC NULLS LAST, job_id LIMIT 20 OFFSET 40""")
def job_page(spark: SparkSession, folder: str) -> DataFrame:
    return J.page(J.in_universe(corpus.jobs(spark, folder), corpus.chapters(spark, folder), "en"), 20, 40).select("job_id", "created_at", "chapter_id")


@query("""SELECT chapter_id, r.c AS created_at, r.j AS job_id FROM (SELECT chapter_id, max({'c': created_at, 'j': job_id}) AS r FROM jobs GROUP BY 1)""")
def latest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return J.latest(corpus.jobs(spark, folder), ["chapter_id"], "created_at", "job_id")


@query("""SELECT job_id, step, status, attempts, CASE WHEN status = 'TRIGGERED' OR attempts < 3 THEN 'TRIGGERED' ELSE 'FAILED' END AS new_status FROM stages
WHERE status = 'TRIGGERED' AND triggered_at < TIMESTAMP '2000-01-01' - INTERVAL 60 SECOND OR status = 'RUNNING' AND triggered_at < TIMESTAMP '2000-01-01' - INTERVAL 300 SECOND""")
def stale_stages(spark: SparkSession, folder: str) -> DataFrame:
    return D.recover(corpus.stages(spark, folder), "2000-01-01 00:00:00").select("job_id", "step", "status", "attempts", "new_status")


@query("""t0 AS (SELECT job_id, step, CASE WHEN status = 'RUNNING' THEN 'PENDING' ELSE status END AS status, attempts FROM stages),
r AS (SELECT s.job_id, s.step FROM t0 s LEFT JOIN t0 p ON p.job_id = s.job_id AND p.step = s.step - 1 WHERE s.status = 'PENDING' AND (s.step = 1 OR p.status IN ('COMPLETED', 'SKIPPED')))
SELECT t0.job_id, t0.step, CASE WHEN r.job_id IS NOT NULL THEN 'TRIGGERED' ELSE t0.status END AS status, t0.attempts + CAST(r.job_id IS NOT NULL AS INT) AS attempts FROM t0 LEFT JOIN r ON r.job_id = t0.job_id AND r.step = t0.step""")
def triggered_stages(spark: SparkSession, folder: str) -> DataFrame:
    """The barrier: a pending stage starts when all its parents are over well (here the step before it)."""
    s = corpus.stages(spark, folder).select("job_id", "step", F.when(F.col("status") == "RUNNING", "PENDING").otherwise(F.col("status")).alias("status"), "attempts")
    return D.trigger(s, spark.createDataFrame([(i, i + 1) for i in range(1, 7)], "parent int, child int"))


@query("""SELECT event_type, count(*) AS calls, count(*) FILTER (value > 5) AS successes, round(count(*) FILTER (value > 5) / count(*), 6) AS success_rate, round(avg(CASE WHEN value > 5 THEN value END), 6) AS avg_seconds,
round(avg(user_id % 4), 6) AS avg_attempts FROM events GROUP BY 1""", prelude=False)
def model_health(spark: SparkSession, folder: str) -> DataFrame:
    return J.health(corpus.table(spark, folder, "events"), "event_type", F.col("value") > 5, F.col("value"), F.col("user_id") % 4)


@query("e(parent, child) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in D.StageDag().edges) + "), r AS (SELECT parent AS ancestor, child AS descendant FROM e UNION SELECT r.ancestor, e.child FROM r JOIN e ON r.descendant = e.parent) SELECT ancestor, descendant FROM r", prelude=False)
def stage_closure(spark: SparkSession, folder: str) -> DataFrame:
    return D.closure(spark)


SQL["stage_closure"] = "WITH RECURSIVE " + SQL["stage_closure"]


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CASE event_type WHEN 'signup' THEN 'TRIGGERED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'SKIPPED' END AS status, count(*) AS n
FROM events GROUP BY 1, 2""", prelude=False)
def stage_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return streams.windowed_counts(streams.stage_events(corpus.table(spark, folder, "events")))


# segmentation


@query()
def chapter_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping chunks of every chapter that end on strong boundaries."""
    return X.chunk(corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def placed_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Scene anchors found again in their chapter: the first words of every line, some of them changed."""
    s = corpus.scenes(spark, folder)
    words = F.array_join(F.slice(F.split("text", " +"), 1, 8), " ")
    anchor = F.when(F.col("scene_index") % 2 == 0, words).otherwise(F.concat(words, F.lit(" elsewhere")))
    anchors = s.groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("scene_index", anchor.alias("a")))), lambda x: x.a).alias("anchors"))
    texts = corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("chapter_id"), "text")
    return X.place(texts.join(anchors, "chapter_id"))


@query("""SELECT doc_id AS chapter_id, substring(text, 1, 100) AS preview, substring(text, 11, 40) AS slice FROM documents WHERE length(text) >= 10""", prelude=False)
def chapter_previews(spark: SparkSession, folder: str) -> DataFrame:
    d = corpus.table(spark, folder, "documents").filter(F.length("text") >= 10)
    return d.select(F.col("doc_id").alias("chapter_id"), F.substring("text", 1, 100).alias("preview"), X.scene_slice(F.col("text"), F.lit(10), F.lit(50)).alias("slice"))


@query("""t0 AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem), f AS (SELECT k, n, min({'p': p, 's': s}) AS a, max({'p': p, 's': s}) AS b FROM t0 GROUP BY 1, 2)
SELECT k, n, a.p AS first_p, a.s AS first_s, b.p AS last_p, b.s AS last_s FROM f""")
def upserts(spark: SparkSession, folder: str) -> DataFrame:
    """First writer and last writer on a natural key."""
    rows = corpus.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    a, b = C.upsert_first(rows, ["k", "n"], "p").toDF("k", "n", "first_p", "first_s"), C.upsert_last(rows, ["k", "n"], "p").toDF("k", "n", "last_p", "last_s")
    return a.join(b, ["k", "n"])


@query("""SELECT chapter_id, count(*) AS n FROM individuals WHERE chapter_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) GROUP BY 1 UNION ALL SELECT doc_id, CAST(0 AS BIGINT) FROM documents WHERE doc_id % 4 = 0""")
def replaced_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of rewritten chapters are replaced, others stay."""
    current = corpus.individuals(spark, folder).groupBy("chapter_id").agg(F.count("*").alias("n"))
    fresh = corpus.table(spark, folder, "documents").filter("doc_id % 4 = 0").select(F.col("doc_id").alias("chapter_id"), F.lit(0).cast("long").alias("n"))
    return C.replace_scope(current, fresh, "chapter_id")


@query("""t0 AS (SELECT DISTINCT normalized_name AS name FROM individuals)
SELECT item_id, name FROM benchmark JOIN t0 ON contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || name || ' ')""")
def known_names(spark: SparkSession, folder: str) -> DataFrame:
    """Known names in questions, whole words in any case: an equi-join on words, as names grow with the library."""
    names = corpus.individuals(spark, folder).select(F.col("normalized_name").alias("name")).distinct()
    words = corpus.table(spark, folder, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "))).alias("name"))
    return words.join(names, "name").select("item_id", "name")


# analyses, claims, telemetry


@query("""t0 AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN vec_id || ':0' END AS scene_id, CASE WHEN vec_id % 3 = 1 THEN vec_id END AS direct FROM embeddings)
SELECT chunk_id, c.chapter_id, universe, series, book_number, chapter_number FROM t0 LEFT JOIN scenes s ON s.scene_id = t0.scene_id LEFT JOIN chapters c ON c.chapter_id = coalesce(s.chapter_id, direct)""")
def chunk_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks find their chapter through a scene, directly, or not at all."""
    i = F.col("vec_id")
    chunks = corpus.table(spark, folder, "embeddings").select(i.alias("chunk_id"), F.when(i % 3 == 0, F.concat(i, F.lit(":0"))).alias("scene_id"), F.when(i % 3 == 1, i).alias("chapter_id"))
    chapters = corpus.chapters(spark, folder).select("chapter_id", "universe", "series", "book_number", "chapter_number", F.lit(1).alias("there"))
    out = A.chunk_coordinates(chunks, corpus.scenes(spark, folder), chapters)
    return out.select("chunk_id", F.when(F.col("there") == 1, F.col("chapter_id")).alias("chapter_id"), "universe", "series", "book_number", "chapter_number")


@query("""t0 AS (SELECT doc_id AS chunk_id, sha256(text) AS content_hash, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN sha256('old:' || sha256(text)) ELSE sha256('m1:' || sha256(text)) END AS h FROM documents)
SELECT chunk_id, sha256('m1:' || content_hash) AS expected_hash FROM t0 WHERE h IS NULL OR h <> sha256('m1:' || content_hash)""")
def chunks_to_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Incremental selection: no embedding, or one of another model or content."""
    h = F.sha2("text", 256)
    d = corpus.table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), h.alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"),
        F.when(F.col("doc_id") % 4 == 1, T.embedding_hash("old", h)).when(F.col("doc_id") % 4 != 0, T.embedding_hash("m1", h)).alias("embedding_hash"),
    )
    return A.to_embed(d, "m1").select("chunk_id", "expected_hash")


@query("""t0 AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS previous_id, CASE WHEN event_id % 7 > 0 THEN user_id + 2 END AS next_id,
CASE event_id % 4 WHEN 0 THEN 'R:temporal.before' WHEN 1 THEN ' During' WHEN 2 THEN 'later' END AS previous_type, CASE WHEN event_id % 3 > 0 THEN 'overlaps' ELSE '' END AS next_type FROM events)
SELECT event_id, CASE WHEN previous_id IS NOT NULL AND previous_type IS NULL THEN 'MISSING_PREVIOUS' WHEN previous_id IS NOT NULL AND previous_type = 'later' THEN 'INVALID_PREVIOUS' WHEN next_id IS NOT NULL AND next_type = '' THEN 'MISSING_NEXT' END AS problem FROM t0""")
def triad_problems(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("event_id")
    t = corpus.table(spark, folder, "events").select(
        i, F.when(i % 5 > 0, F.col("user_id")).alias("previous_id"), F.when(i % 7 > 0, F.col("user_id") + 2).alias("next_id"),
        F.when(i % 4 == 0, "R:temporal.before").when(i % 4 == 1, " During").when(i % 4 == 2, "later").alias("previous_type"), F.when(i % 3 > 0, "overlaps").otherwise("").alias("next_type"),
    )
    return A.validated(t).select("event_id", "problem")


@query("""t0 AS (SELECT user_id AS w, event_id AS id, value FROM events), g AS (SELECT w, id // 2000 AS grp, list(id) AS ids, max(value) / 20 AS confidence FROM t0 GROUP BY 1, 2),
m AS (SELECT w, grp, confidence, unnest(ids) AS id FROM g WHERE confidence >= 0.75)
SELECT a.id AS a, b.id AS b, max(a.confidence) AS confidence FROM m a JOIN m b ON a.w = b.w AND a.grp = b.grp AND a.id < b.id WHERE a.id % 5 > 0 AND b.id % 5 > 0 GROUP BY 1, 2""")
def coreference_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of co-referent mentions from answers by window: confident, allowed, the best confidence."""
    e = corpus.table(spark, folder, "events")
    answers = e.groupBy("user_id", F.floor(F.col("event_id") / 2000)).agg(F.collect_list("event_id").alias("mention_ids"), (F.max("value") / 20).alias("confidence")).withColumnRenamed("user_id", "window")
    allowed = e.filter("event_id % 5 > 0").select(F.col("user_id").alias("window"), F.col("event_id").alias("id"))
    return C.coreference(answers.select("window", "mention_ids", "confidence"), allowed)


@query("""t0 AS (SELECT l_orderkey AS job_id, count(*) AS attempted, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1)
SELECT job_id, failed = attempted OR (failed >= 2 AND failed * 2 >= attempted) AS fails FROM t0""")
def window_failures(spark: SparkSession, folder: str) -> DataFrame:
    g = corpus.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("attempted"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return g.select("job_id", C.should_fail(F.col("failed"), F.col("attempted")).alias("fails"))


@query("""t0 AS (SELECT l_orderkey AS call_id, l_partkey % 10 AS body, l_linestatus AS side FROM lineitem),
q AS (SELECT call_id, string_agg(body, ',' ORDER BY body) AS b FROM (SELECT DISTINCT call_id, body FROM t0 WHERE side = 'F') GROUP BY 1), a AS (SELECT call_id, string_agg(body, ',' ORDER BY body) AS b FROM (SELECT DISTINCT call_id, body FROM t0 WHERE side = 'O') GROUP BY 1)
SELECT o_orderkey AS call_id, coalesce(q.b, '') AS requests, coalesce(a.b, '') AS responses FROM orders LEFT JOIN q ON q.call_id = o_orderkey LEFT JOIN a ON a.call_id = o_orderkey""")
def call_records(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry records with requests and responses gathered."""
    rows = corpus.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("call_id"), (F.col("l_partkey") % 10).alias("body"), "l_linestatus")
    calls = corpus.table(spark, folder, "orders").select(F.col("o_orderkey").alias("call_id"))
    out = J.with_calls(calls, rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"))
    return out.select("call_id", F.coalesce(F.array_join("requests", ","), F.lit("")).alias("requests"), F.coalesce(F.array_join("responses", ","), F.lit("")).alias("responses"))


_RING = "m AS (SELECT max(user_id) + 1 AS n FROM events), t0 AS (SELECT DISTINCT user_id AS a, (user_id * 7 + 3) % n AS b FROM events, m)"


def _ring(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.table(spark, folder, "events")
    n = e.agg(F.max("user_id") + 1).first()[0]
    return e.select(F.col("user_id").alias("from_id"), ((F.col("user_id") * 7 + 3) % n).alias("to_id")).distinct()


@query(PRELUDE + ", " + _RING + """, r AS (SELECT a, b, 1 AS n FROM t0 UNION SELECT r.a, t0.b, n + 1 FROM r JOIN t0 ON r.b = t0.a WHERE n < 6)
SELECT DISTINCT t0.a AS from_id, t0.b AS to_id FROM t0 JOIN r ON r.a = t0.b AND r.b = t0.a""", prelude=False)
def edges_with_back_path(spark: SparkSession, folder: str) -> DataFrame:
    """Edges on a cycle: a path of at most six edges leads back. Every user of every event is a node."""
    return G.back_paths(_ring(spark, folder), 6)


@query(PRELUDE + ", " + _RING + """, e AS (SELECT a, b, a * 1000000 + b AS id FROM (SELECT a, b FROM t0 UNION SELECT a, (b + 1) % n FROM t0, m)),
r AS (SELECT a AS f, b AS t, b AS pos, CAST([] AS BIGINT[]) AS used FROM t0 UNION ALL SELECT f, t, e.b, list_append(used, e.id) FROM r JOIN e ON e.a = pos WHERE len(used) < 6 AND NOT list_contains(used, e.id))
SELECT f AS from_id, t AS to_id, count(*) AS paths FROM r WHERE len(used) > 0 AND pos = f GROUP BY 1, 2""", prelude=False)
def back_path_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many paths of at most six edges, none twice, lead back, for each edge of a graph."""
    e = _ring(spark, folder)
    n = corpus.table(spark, folder, "events").agg(F.max("user_id") + 1).first()[0]
    return G.path_counts(e, e.unionByName(e.select("from_id", ((F.col("to_id") + 1) % n).alias("to_id"))), 6)


@query("""WITH RECURSIVE m AS (SELECT max(user_id) + 1 AS n FROM events),
e AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN user_id + 2 * n ELSE user_id + CASE WHEN event_type = 'purchase' THEN 3 + event_id % 3 ELSE 0 END * n END AS a,
  CASE event_type WHEN 'view' THEN (user_id * 7 + event_id % 4) % n WHEN 'signup' THEN user_id + n WHEN 'error' THEN user_id WHEN 'purchase' THEN user_id + (3 + (event_id + 1) % 3) * n ELSE user_id END AS b FROM events, m WHERE event_type <> 'click' OR event_id % 7 = 0),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.b = y.a AND x.a = y.b GROUP BY x.a""", prelude=False)
def cycle_components(spark: SparkSession, folder: str) -> DataFrame:
    """Strong components of a graph of all events: one web, rings of three, nodes that lead in or out of the web, loops."""
    e = corpus.table(spark, folder, "events")
    n = e.agg(F.max("user_id") + 1).first()[0]
    u, i, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    is_ = lambda x: kind == x
    edges = e.filter(~is_("click") | (i % 7 == 0)).select(
        F.when(is_("error"), u + 2 * n).when(is_("purchase"), u + (3 + i % 3) * n).otherwise(u).alias("from_id"),
        F.when(is_("view"), (u * 7 + i % 4) % n).when(is_("signup"), u + n).when(is_("purchase"), u + (3 + (i + 1) % 3) * n).otherwise(u).alias("to_id"),
    )
    return G.strong_components(edges)


@query("""t0 AS (SELECT event_id_1, event_id_2, score FROM c WHERE score >= 0.6), e AS (SELECT event_id_1 AS a, event_id_2 AS b FROM t0 UNION ALL SELECT event_id_2, event_id_1 FROM t0),
r AS (SELECT event_id AS node, event_id AS other FROM ev UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), m AS (SELECT node, min(other) AS book_event_id FROM r GROUP BY 1)
SELECT book_id, book_event_id, count(*) AS chapter_events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS members FROM ev JOIN m ON node = event_id GROUP BY 1, 2""")
def book_events(spark: SparkSession, folder: str) -> DataFrame:
    """Book events: components of merge decisions."""
    events = _events(spark, folder).select("book_id", "event_id", F.concat(F.lit("e"), F.col("event_id")).alias("display_name"), F.concat(F.lit("e"), F.col("event_id")).alias("normalized_name"), F.lit("t").alias("event_type"), F.lit(1).alias("mention_count"), F.lit("card").alias("card"))
    decisions = C.verdicts(event_candidates(spark, folder), events, models.merge_above(0.6))
    return C.book_events(events, decisions).select("book_id", "book_event_id", "chapter_events", F.array_join("members", ",").alias("members"))


SQL["book_events"] = PRELUDE + ", " + _PAIRS.replace("t0", "ev") + ", " + SQL["book_events"].removeprefix(PRELUDE + ", ")
