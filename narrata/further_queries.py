"""Queries over indexes, tables of questions, names of several words, streams and graphs, in the same registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata import corpus
from narrata.functions import text as T
from narrata.more_queries import _CHAIN, _chain, _lane, _lane_of, _lane_sql
from narrata.operators import analysis as A
from narrata.operators import answers as M
from narrata.operators import consolidate as C
from narrata.operators import graph as G
from narrata.operators import index as V
from narrata.operators import names as N
from narrata.operators import phrases as H
from narrata.operators import search as S
from narrata.operators import timeline as L
from narrata.plans import questions as Q
from narrata.queries import _SHOWN, OPEN_READER, _events, _placed, query
from narrata.streaming import jobs as streams
from narrata.streaming import timers

_NEAR = "t0 AS (SELECT a.chunk_id AS query, b.*, round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2, 6) AS score FROM chunks a JOIN chunks b ON a.chunk_id % 100 = 0)"


def _chunk_index(spark: SparkSession, folder: str) -> V.Index:
    return V.build(corpus.chunks(spark, folder).select(F.col("chunk_id").alias("id"), "embedding"))


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query"), "embedding")


@query(_NEAR + f""", c AS (SELECT * FROM t0 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) <= 60)
SELECT query, chunk_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS INT) AS rank FROM c WHERE {_SHOWN} QUALIFY rank <= 20""")
def visible_chunks_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader may see of the chunks nearest to every hundredth one, by the index with the cells' radii: exact."""
    chunks = corpus.chunks(spark, folder)
    return S.visible_indexed(_chunk_index(spark, folder), chunks, _asked(chunks), 20, OPEN_READER)


@query()
def visible_chunks_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the probed cells alone; the probes are fitted for 0.95 of the nearest on 64 rows."""
    chunks, index = corpus.chunks(spark, folder), _chunk_index(spark, folder)
    return S.visible_indexed(index, chunks, _asked(chunks), 20, OPEN_READER, V.probes_for(index, 60))


@query()
def event_neighbours_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest events of other chapters of the book for every hundredth event, from the probed cells of an index over all."""
    events = _events(spark, folder)
    index = V.build(events.select(F.col("event_id").alias("id"), "embedding"))
    return S.neighbours_indexed(index, events, events.filter("event_id % 100 = 0"), 8, 0.55, V.probes_for(index, 24))


# questions: an opening and the first name of a benchmark item; its vector is that of the chunk of that number, and every 17th has none

_OPENINGS = ("Who is ", "tell me about ", "Why did ", "where was ", "Describe ", "")
_PLACES = _CHAIN.replace("t0", "l0").replace("ce AS", "lce AS").replace("FROM ce ", "FROM lce ").replace("be AS", "lbe AS").replace("be.", "lbe.").replace("JOIN be ", "JOIN lbe ").replace("ch AS", "lch AS").replace(
    "FROM individuals", "FROM (SELECT *, 0 AS extraction_index FROM locations)")
_QUESTIONS = _CHAIN + ", " + _PLACES + f""", q AS (SELECT b.item_id AS question_id, list_extract({list(_OPENINGS)}, CAST(b.item_id % 6 + 1 AS INT)) || w || '?!' AS question, b.item_id % 6 IN (0, 1, 3, 4) AS looks,
  CASE WHEN b.item_id % 6 = 2 THEN 'why did ' ELSE '' END || lower(w) AS name, lower(w) AS w, CASE WHEN b.item_id % 17 <> 3 THEN e.embedding END AS v FROM (SELECT item_id, coalesce(nullif(regexp_extract(text, '[A-Z][a-z]+'), ''), 'Nobody') AS w FROM benchmark) b LEFT JOIN chunks e ON e.chunk_id = b.item_id),
seen AS (SELECT chapter_id FROM chapters WHERE {_SHOWN}),
pe AS (SELECT normalized_name AS name, book_id, book_entity, display_name, count(*) AS n FROM ch WHERE chapter_id IN (FROM seen) GROUP BY ALL), le AS (SELECT normalized_name AS name, book_id, book_entity, display_name, count(*) AS n FROM lch WHERE chapter_id IN (FROM seen) GROUP BY ALL),
lp AS (SELECT question_id, display_name, n, row_number() OVER (PARTITION BY question_id ORDER BY book_id, book_entity) AS r FROM q JOIN pe USING (name) WHERE looks QUALIFY r <= 20),
ll AS (SELECT question_id, display_name, n, row_number() OVER (PARTITION BY question_id ORDER BY book_id, book_entity) AS r FROM q JOIN le USING (name) WHERE looks AND question_id NOT IN (SELECT question_id FROM lp) QUALIFY r <= 20),
lk AS (SELECT * FROM lp UNION ALL SELECT * FROM ll), rest AS (SELECT * FROM q WHERE question_id NOT IN (SELECT question_id FROM lk)),
s3 AS (SELECT question_id, c.*, round((1 + list_cosine_similarity(v, c.embedding)) / 2, 6) AS score FROM rest JOIN chunks c ON v IS NOT NULL), """
_OVER = "o AS (SELECT * FROM s3 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= {n}), v0 AS (SELECT question_id, chunk_id, chapter_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS r FROM o WHERE {shown} QUALIFY r <= {k})"
_ANSWERED = """ SELECT question_id, 'ENTITY_LOOKUP' AS route, 'OK' AS status, CAST(r AS INT) AS rank, display_name AS item, CAST(n AS DOUBLE) AS score FROM lk UNION ALL
SELECT rest.question_id, 'NARRATIVE_QA', CASE WHEN r IS NOT NULL THEN CASE WHEN v IS NULL THEN 'DEGRADED' ELSE 'OK' END WHEN v IS NULL THEN 'SEARCH_FAILED' ELSE 'NO_EVIDENCE' END, CAST(r AS INT), CAST(chunk_id AS VARCHAR), score FROM rest LEFT JOIN best USING (question_id)"""


def _answers(spark: SparkSession, folder: str, **options) -> DataFrame:
    chunks = corpus.chunks(spark, folder)
    b = corpus.table(spark, folder, "benchmark")
    opening = F.element_at(F.array(*[F.lit(x) for x in _OPENINGS]), (F.col("item_id") % 6 + 1).cast("int"))
    name = F.coalesce(F.nullif(F.regexp_extract("text", "[A-Z][a-z]+", 0), F.lit("")), F.lit("Nobody"))
    vectors = chunks.select(F.col("chunk_id").alias("item_id"), "embedding")
    asked = b.select("item_id", F.concat(opening, name, F.lit("?!")).alias("question")).join(vectors, "item_id", "left")
    asked = asked.select(F.col("item_id").alias("question_id"), "question", F.when(F.col("item_id") % 17 != 3, F.col("embedding")).alias("embedding"))
    names = G.cut(Q.routed(asked).select(F.col("name").alias("normalized_name")).filter("normalized_name is not null").distinct())
    people, places = _chain(spark, folder, names=names), _chain(spark, folder, "location", names)
    out = Q.answers(asked, _chunk_index(spark, folder), chunks, corpus.chapters(spark, folder), people, places, corpus.individuals(spark, folder), visibility=OPEN_READER, **options)
    return out.select("question_id", "route", "status", "rank", "item", "score")


@query(_QUESTIONS + _OVER.format(n=15, k=5, shown=_SHOWN) + """, h AS (SELECT question_id, chapter_id, count(DISTINCT lower(display_name)) AS hits FROM (SELECT DISTINCT question_id, chapter_id, question FROM v0 JOIN rest USING (question_id)) JOIN individuals USING (chapter_id)
  WHERE list_contains(regexp_extract_all(lower(question), '[a-z0-9]+'), lower(display_name)) GROUP BY 1, 2),
b0 AS (SELECT question_id, chunk_id, r AS was, round(score + 0.05 * coalesce(hits, 0), 6) AS score FROM v0 LEFT JOIN h USING (question_id, chapter_id) WHERE score >= 0.52),
best AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, was) AS r FROM b0)""" + _ANSWERED)
def asked_questions(spark: SparkSession, folder: str) -> DataFrame:
    """All questions of the benchmark table in one plan: lookups through the entity chain, the rest by vector and names."""
    return _answers(spark, folder, threshold=0.52)


@query(_QUESTIONS + _OVER.format(n=60, k=20, shown=_SHOWN) + f""", pl AS (SELECT DISTINCT normalized_name AS name, chapter_id FROM ch),
g AS (SELECT name, chunk_id, row_number() OVER (PARTITION BY name ORDER BY chunk_id) AS r FROM chunks JOIN pl USING (chapter_id) WHERE {_SHOWN} QUALIFY r <= 20),
u AS (SELECT question_id, chunk_id, r, r AS own FROM v0 UNION ALL SELECT question_id, chunk_id, r, NULL FROM rest JOIN g USING (name)),
f AS (SELECT question_id, chunk_id, CAST(round(sum(1.0 / (60 + r)), 9) AS DOUBLE) AS score, count(*) AS n, min(r) AS first, min(own) AS own FROM u GROUP BY 1, 2),
best AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n DESC, first, own NULLS LAST, chunk_id) AS r FROM f QUALIFY r <= 5)""" + _ANSWERED)
def asked_questions_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the graph branch; a question whose vector failed is answered by it alone."""
    return _answers(spark, folder, hybrid=True)


# names of several words: the first one to four words of every scene


_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""t0 AS (SELECT scene_id AS item, {_WORDS.format('text')} AS ws, 1 + (chapter_id + scene_index) % 4 AS n FROM scenes), k AS (SELECT DISTINCT array_to_string(ws[1:n], ' ') AS name FROM t0 WHERE len(ws) >= n),
p AS (SELECT item, ws, unnest(generate_series(1, len(ws))) AS i FROM t0), g AS (SELECT item, i, m, array_to_string(ws[i:i + m - 1], ' ') AS name FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(ws))
SELECT item, name, CAST(i - 1 AS INT) AS first_word, CAST(i + m - 2 AS INT) AS last_word FROM g JOIN k USING (name)""")
def known_name_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of every known name of one to four words (what scenes open with) in all scenes."""
    scenes = corpus.scenes(spark, folder)
    ws, n = N.words(F.col("text")), (1 + (F.col("chapter_id") + F.col("scene_index")) % 4).cast("int")
    names = scenes.select(ws.alias("ws"), n.alias("n")).filter("size(ws) >= n").select(F.array_join(F.slice("ws", F.lit(1), F.col("n")), " ").alias("name"))
    return N.name_hits(scenes.select(F.col("scene_id").alias("item"), "text"), names)


# streams


@query("""WITH RECURSIVE t0 AS (SELECT user_id AS job_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'signup' THEN 'TRIGGERED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'SKIPPED' END AS t FROM events),
f AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, 'PENDING' AS status, CAST(NULL AS TIMESTAMP) AS seen, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS lapses FROM t0
UNION ALL SELECT job_id, n, CASE WHEN ok THEN t ELSE now END, ts, refused + CAST(NOT ok AS BIGINT), lapses + CAST(lapsed AS BIGINT) FROM (
  SELECT *, coalesce((now = 'PENDING' AND t IN ('TRIGGERED', 'SKIPPED')) OR (now = 'TRIGGERED' AND t IN ('RUNNING', 'FAILED', 'TRIGGERED')) OR (now = 'RUNNING' AND t IN ('COMPLETED', 'SKIPPED', 'FAILED', 'TRIGGERED')), false) AS ok FROM (
    SELECT *, CASE WHEN lapsed THEN 'PENDING' ELSE status END AS now FROM (
      SELECT f.job_id, t0.n, t0.ts, t0.t, f.status, f.refused, f.lapses, coalesce(f.status IN ('TRIGGERED', 'RUNNING') AND t0.ts > f.seen + INTERVAL 2 DAY, false) AS lapsed FROM f JOIN t0 ON t0.job_id = f.job_id AND t0.n = f.n + 1)))),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1), w AS (SELECT *, status IN ('TRIGGERED', 'RUNNING') AND epoch_ms(seen) + 172800001 <= (SELECT epoch_ms(max(ts)) FROM events) AS gone FROM l)
SELECT job_id, CASE WHEN gone THEN 'STALE' ELSE status END AS status, seen, n AS events, refused, lapses + CAST(gone AS BIGINT) AS lapses FROM w""", prelude=False)
def replayed_stages(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of all events, run to its end: state of every stage, what was refused, how often it lapsed; timers make silent ones stale after two days."""
    path = f"{folder}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a pattern: the table is a file or a folder
    events = streams.stage_events(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    out = timers.replay(events, f"{G.shared_folder(spark)}/{uuid.uuid4().hex}", 2 * 24 * 3_600_000)
    return out.withColumn("seen", F.col("seen").cast("timestamp_ntz"))


# lanes after some chapters changed: every tenth loses half of its mentions, and a third of the rest has another name

_CHANGED = """FROM (SELECT * REPLACE (CASE WHEN chapter_id % 10 = 3 AND extraction_index % 3 = 0 THEN substring(display_name, 1, 2) || 'ix' ELSE display_name END AS display_name,
  CASE WHEN chapter_id % 10 = 3 AND extraction_index % 3 = 0 THEN lower(substring(display_name, 1, 2) || 'ix') ELSE normalized_name END AS normalized_name) FROM individuals WHERE chapter_id % 10 <> 3 OR extraction_index % 2 = 0)"""


@query(_lane_sql("individual").replace("FROM individuals", _CHANGED) + " SELECT book_id, chapter_count, first_seen_chapter_id, cluster, display_name, normalized_name FROM be")
def lane_after_change(spark: SparkSession, folder: str) -> DataFrame:
    """Book individuals kept up after chapters changed: what was touched anew, the rest as it stood; equal to building all anew."""
    chapters = corpus.chapters(spark, folder).select("chapter_id", "book_id")
    entities, books, links, _ = C.lane_tables(_lane(spark, folder, "individual"), chapters)
    members = entities.join(links, "id")
    new = F.concat(F.substring("display_name", 1, 2), F.lit("ix"))
    mentions = corpus.individuals(spark, folder).filter("chapter_id % 10 = 3 and extraction_index % 2 = 0")
    mentions = mentions.withColumn("display_name", F.when(F.col("extraction_index") % 3 == 0, new).otherwise(F.col("display_name"))).withColumn("normalized_name", F.lower("display_name"))
    fresh = G.cut(C.chapter_entities(_lane_of(mentions, "individual")))
    changed = chapters.filter("chapter_id % 10 = 3").select("chapter_id")
    kept, rewritten = C.book_entities_after(changed, members, fresh, chapters, books)
    return kept.unionByName(rewritten).select("book_id", "chapter_count", "first_seen_chapter_id", "cluster", "display_name", "normalized_name")


# phrases: the grammar over tags that a rule both engines can state gives; the fitted tagger is tested on held-out sentences

_TAG = "CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'P' WHEN w IN ('the', 'that', 'this', 'an', 'a') THEN 'D' WHEN w IN ('of', 'in', 'on', 'for', 'to') THEN 'I' WHEN w LIKE '%ing' OR w LIKE '%er' THEN 'A' WHEN w LIKE '%es' OR w LIKE '%ed' THEN 'V' WHEN regexp_matches(w, '^[a-z]') THEN 'N' ELSE 'X' END"


@query(f"""WITH t0 AS (SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '{H.WORD.replace("'", "''")}'), lambda w: {_TAG} || '/' || w), ' ') || ' ' AS line FROM benchmark),
p AS (SELECT item_id, regexp_extract_all(line, '{H.PHRASE}', 1) AS ps FROM t0)
SELECT item_id, CAST(i - 1 AS INT) AS n, trim(regexp_replace(ps[i], '(^| )[A-Z]/', '\\1', 'g')) AS phrase FROM (SELECT item_id, ps, unnest(generate_series(1, len(ps))) AS i FROM p)""", prelude=False)
def question_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Noun phrases of benchmark texts by the grammar."""
    low = lambda w, *ends: F.expr("false") if not ends else w.endswith(ends[0]) | low(w, *ends[1:])

    def tag(w):
        kind = F.when(w.rlike("^[A-Z]"), "P").when(w.isin("the", "that", "this", "an", "a"), "D").when(w.isin("of", "in", "on", "for", "to"), "I")
        return F.concat(kind.when(low(w, "ing", "er"), "A").when(low(w, "es", "ed"), "V").when(w.rlike("^[a-z]"), "N").otherwise("X"), F.lit("/"), w)

    words = F.regexp_extract_all("text", F.lit(H.WORD), F.lit(0))
    return corpus.table(spark, folder, "benchmark").select("item_id", F.posexplode(H.phrases(F.transform(words, tag))).alias("n", "phrase"))


# lists, orders, scopes


@query("""WITH e AS (SELECT DISTINCT user_id AS f, user_id + 1 + event_id % 5 AS t FROM events), v AS (SELECT f AS id, -(f % 7) AS place FROM e UNION SELECT t, -(t % 7) FROM e),
r AS (SELECT f AS id, 'later' AS direction, t AS other FROM e UNION ALL SELECT t, 'earlier', f FROM e)
SELECT r.id, direction, CAST(row_number() OVER (PARTITION BY r.id, direction ORDER BY place, other) AS INT) AS n, other FROM r JOIN v ON v.id = other""", prelude=False)
def event_neighbour_lists(spark: SparkSession, folder: str) -> DataFrame:
    """What follows each event and what it follows, in the order of a place that events have."""
    e = corpus.table(spark, folder, "events").select(F.col("user_id").alias("from_id"), (F.col("user_id") + 1 + F.col("event_id") % 5).alias("to_id"))
    ids = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return L.neighbour_lists(e, ids.withColumn("place", -(F.col("id") % 7)), ["place"])


@query("""t0 AS (SELECT vec_id AS chunk_id, vec_id % 5 || ':' || vec_id % 3 AS scene_id, vec_id * 31 % 17 AS chunk_number FROM embeddings)
SELECT chunk_id, scene_index, chunk_number, CAST(row_number() OVER (ORDER BY scene_index, chunk_number, chunk_id) AS INT) AS n FROM t0 JOIN scenes USING (scene_id) WHERE chapter_id = 3""")
def chapter_chunk_order(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a chapter through its scenes, numbered in order."""
    i = F.col("vec_id")
    chunks = corpus.table(spark, folder, "embeddings").select(i.alias("chunk_id"), F.concat_ws(":", i % 5, i % 3).alias("scene_id"), (i * 31 % 17).alias("chunk_number"))
    rows = A.ordered_chunks(chunks, corpus.scenes(spark, folder), 3)
    return rows.select("chunk_id", "scene_index", "chunk_number", F.row_number().over(Window.orderBy("scene_index", "chunk_number", "chunk_id")).alias("n"))


@query("""WITH t0 AS (SELECT conv_id, turn, list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS a FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: x <> '' AND list_position(a, x) = i), '|') AS aliases FROM t0""", prelude=False)
def clean_alias_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases trimmed, without blanks and repeats, in order."""
    return corpus.table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(T.clean_aliases(F.split("text", ",")), "|").alias("aliases"))


@query("""SELECT DISTINCT chapter_id, book_id, 'universe' AS scope FROM chapters WHERE universe = 'en' UNION ALL SELECT DISTINCT chapter_id, book_id, 'book' FROM chapters WHERE book_id = 'en/src1/2' UNION ALL SELECT DISTINCT chapter_id, book_id, 'chapter' FROM chapters WHERE chapter_id = 12""")
def rerun_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters that a rerun of candidate generation covers, by each kind of scope."""
    c = corpus.chapters(spark, folder)
    parts = [A.rerun_scope(c, **{k: v}).withColumn("scope", F.lit(name)) for name, k, v in (("universe", "universe", "en"), ("book", "book_id", "en/src1/2"), ("chapter", "chapter_id", 12))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT conv_id, turn, [CAST(length(text) AS DOUBLE), CAST(strpos(text, 'e') AS DOUBLE)] AS embedding FROM conversations""", prelude=False)
def embedded_once(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct text embedded once (here: by a stand-in that SQL can state), the vector given to all of its rows."""
    rows = corpus.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return A.embed_distinct(rows, "text", lambda c: F.array(F.length(c).cast("double"), F.instr(c, "e").cast("double"))).select("conv_id", "turn", "embedding")


# model answers, by the stand-ins


@query("""t0 AS (SELECT scene_id, text, lag(scene_id) OVER w AS p, lead(scene_id) OVER w AS n FROM scenes JOIN (SELECT chapter_id, book_id, chapter_number FROM chapters) USING (chapter_id) WINDOW w AS (PARTITION BY book_id ORDER BY chapter_number, scene_index))
SELECT scene_id AS current_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS INT) AS individuals, CASE WHEN p IS NOT NULL THEN 'R:temporal.before' END AS previous_type, CASE WHEN n IS NOT NULL THEN 'R:temporal.before' END AS next_type, CAST(NULL AS VARCHAR) AS problem FROM t0""")
def analysed_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Every scene analysed with its neighbours by the model's stand-in, parsed, cleaned and validated."""
    out = M.scene_analyses(L.triads(_placed(spark, folder)), corpus.scenes(spark, folder).select("scene_id", "text"))
    return out.select("current_id", F.size("individuals").alias("individuals"), "previous_type", "next_type", "problem")


@query("""t0 AS (SELECT chapter_id, scene_id, row_number() OVER (PARTITION BY chapter_id ORDER BY scene_index) AS r, count(*) OVER (PARTITION BY chapter_id) AS m FROM scenes),
w AS (SELECT a.chapter_id, a.r AS win, b.scene_id FROM t0 a JOIN t0 b ON a.chapter_id = b.chapter_id AND b.r BETWEEN a.r AND a.r + 2 WHERE a.r + 2 <= a.m OR (a.m < 3 AND a.r = 1)),
x AS (SELECT chapter_id, win, w.scene_id || '#' || extraction_index AS id, normalized_name FROM w JOIN (SELECT scene_id, extraction_index, normalized_name FROM individuals) USING (scene_id))
SELECT DISTINCT a.id AS a, b.id AS b, CAST(0.9 AS DOUBLE) AS confidence FROM x a JOIN x b ON a.chapter_id = b.chapter_id AND a.win = b.win AND a.normalized_name = b.normalized_name AND a.id < b.id""")
def coreferent_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions that the model's stand-in takes for one, window by window, as links."""
    windows = L.windows(corpus.scenes(spark, folder)).select(F.concat_ws("/", "chapter_id", "window").alias("window"), "scene_ids")
    mentions = corpus.individuals(spark, folder).select("scene_id", F.concat_ws("#", "scene_id", "extraction_index").alias("id"), F.col("display_name").alias("name"))
    return C.coreference(*M.coreference_answers(windows, mentions))
