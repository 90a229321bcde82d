"""More registered queries: entity lanes and chains, events rewritten, jobs, claims, contexts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata import corpus, models, schemas
from narrata.functions import text as T
from narrata.operators import analysis as A
from narrata.operators import consolidate as C
from narrata.operators import graph as G
from narrata.operators import search as S
from narrata.operators import segment as X
from narrata.operators import timeline as L
from narrata.plans import dag as D
from narrata.plans import jobs as J
from narrata.plans import library as B
from narrata.plans import retrieval as R
from narrata.queries import _EVENTS, _HITS, _PAIRS, _TRIM, _events, _first_vector, _placed, event_candidates, query

# entities: a mention is also known by its first four letters, so entities are names that share them

#: Attributes of each lane as SQL that both engines read, and the mentions that they come from.
_ATTRIBUTES = {
    "individual": {}, "location": {},
    "object": {"type": "CASE WHEN extraction_index % 3 = 1 THEN 'type ' || scene_index % 4 END", "material": "CASE WHEN scene_index % 2 = 1 THEN ' ' ELSE display_name END", "purpose": "CAST(NULL AS VARCHAR(9))", "description": "substring(display_name, 1, 3)"},
    "collective": {"collective_type": "CASE WHEN extraction_index > 2 THEN 'clan' END", "certainty": "'Explicit'", "evidence": "CASE WHEN scene_index % 3 = 2 THEN scene_id END"},
    "concept": {"concept_type": "CASE WHEN scene_index > 0 THEN 'idea ' || scene_index % 3 END", "description": "scene_id", "certainty": "CASE WHEN extraction_index % 2 = 1 THEN 'Explicit' ELSE '' END", "evidence": "CAST(NULL AS VARCHAR(9))"},
}


def _lane_sql(lane: str) -> str:
    source = "(SELECT *, 0 AS extraction_index FROM locations)" if lane == "location" else "individuals"
    cols = _ATTRIBUTES[lane]
    made = "".join(f", nullif(trim({e}), '') AS {a}" for a, e in cols.items())
    first = lambda key: "".join(f", arg_min({a}, {key}) FILTER ({a} IS NOT NULL) AS {a}" for a in cols)
    mine, theirs = "(rank, id)", "(normalized_name, display_name, chapter_id)"
    return f"""t0 AS (SELECT chapter_id, scene_id, scene_index, scene_id || '#' || extraction_index AS id, scene_index * 100000 + extraction_index AS rank, display_name, normalized_name, substring(normalized_name, 1, 4) AS stem{made} FROM {source}),
ce AS (SELECT chapter_id, stem, min(id) AS cluster, arg_min(display_name, {mine}) AS display_name, arg_min(normalized_name, {mine}) AS normalized_name, count(*) AS mention_count{first(mine)} FROM t0 GROUP BY 1, 2),
be AS (SELECT book_id, stem, min(chapter_id || '/' || cluster) AS cluster, arg_min(display_name, {theirs}) AS display_name, arg_min(normalized_name, {theirs}) AS normalized_name, count(*) AS chapter_count, arg_min(chapter_id, {theirs}) AS first_seen_chapter_id{first(theirs)} FROM ce JOIN chapters USING (chapter_id) GROUP BY 1, 2)"""


def _lane(spark: SparkSession, folder: str, lane: str) -> DataFrame:
    m = corpus.locations(spark, folder).withColumn("extraction_index", F.lit(0)) if lane == "location" else corpus.individuals(spark, folder)
    return _lane_of(m, lane)


def _lane_of(m: DataFrame, lane: str) -> DataFrame:
    return m.select(
        "chapter_id", "scene_id", "scene_index", F.concat_ws("#", "scene_id", "extraction_index").alias("id"), (F.col("scene_index") * 100000 + F.col("extraction_index")).alias("rank"), "display_name", "normalized_name",
        F.array(F.substring("display_name", 1, 4)).alias("aliases"), *[F.expr(e).alias(a) for a, e in _ATTRIBUTES[lane].items()],
    )


def _books(spark: SparkSession, folder: str, lane: str) -> DataFrame:
    entities = C.chapter_entities(_lane(spark, folder, lane), lane)
    return C.book_entities(G.cut(entities), corpus.chapters(spark, folder).select("chapter_id", "book_id"), lane)


def _register_lanes() -> None:
    for lane, cols in _ATTRIBUTES.items():
        named = ", ".join(["cluster", "display_name", "normalized_name", *cols])

        def chapter(spark: SparkSession, folder: str, lane=lane) -> DataFrame:
            return C.chapter_entities(_lane(spark, folder, lane), lane).select("chapter_id", "mention_count", "cluster", "display_name", "normalized_name", *_ATTRIBUTES[lane])

        def book(spark: SparkSession, folder: str, lane=lane) -> DataFrame:
            return _books(spark, folder, lane).select("book_id", "chapter_count", "first_seen_chapter_id", "cluster", "display_name", "normalized_name", *_ATTRIBUTES[lane])

        chapter.__name__, book.__name__ = f"chapter_lane_{lane}", f"book_lane_{lane}"
        query(_lane_sql(lane) + f" SELECT chapter_id, mention_count, {named} FROM ce")(chapter)
        query(_lane_sql(lane) + f" SELECT book_id, chapter_count, first_seen_chapter_id, {named} FROM be")(book)


_register_lanes()

_CHAIN = _lane_sql("individual") + """, ch AS (SELECT be.book_id, be.cluster AS book_entity, be.display_name, be.normalized_name, be.first_seen_chapter_id, t0.chapter_id, t0.scene_id, t0.scene_index, chapter_number
  FROM t0 JOIN chapters c ON c.chapter_id = t0.chapter_id JOIN be ON be.book_id = c.book_id AND be.stem = t0.stem)"""


def _chain(spark: SparkSession, folder: str, lane: str = "individual", names: DataFrame | None = None, firsts: bool = False) -> DataFrame:
    """The chain of all mentions, of those that reach book entities of some names (normalized_name), or with `firsts` of the first mention that a chapter has of each set of keys."""
    mentions = _lane(spark, folder, lane)
    of = corpus.chapters(spark, folder).select("chapter_id", "book_id")
    keyed = C.resolvable(mentions).withColumn("keys", C.key_set(F.col("keys")))
    if names is not None:
        return R.chain_of(keyed, C.named_members(mentions, of, names, lane))
    _, books, links, named = C.lane_tables(mentions, of, lane)
    if firsts:
        keyed = keyed.groupBy("chapter_id", "keys").agg(F.min(F.struct("scene_index", "scene_id", "id")).alias("m")).select("chapter_id", "keys", "m.*")
    return R.entity_chain(keyed, named, links, books)


def _chain_named(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return _chain(spark, folder, names=spark.range(1).select(F.explode(F.array(*[T.normalize_name(F.lit(n)) for n in names])).alias("normalized_name")))


@query(_CHAIN + " SELECT book_id, book_entity, display_name, first_seen_chapter_id, count(*) AS mention_count, count(DISTINCT chapter_id) AS chapter_count, count(DISTINCT scene_id) AS scene_count FROM ch WHERE normalized_name = 'the' GROUP BY 1, 2, 3, 4")
def entity_chain_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A name's book entities, with all mentions that reach them through chapter entities."""
    return R.chain_lookup(_chain_named(spark, folder, "The"), corpus.chapters(spark, folder), "The")


@query(_CHAIN + " SELECT DISTINCT book_id, book_entity, chapter_id, scene_id, scene_index, chapter_number FROM ch WHERE normalized_name = 'the' ORDER BY book_id, chapter_number, scene_index, book_entity LIMIT 20")
def entity_chain_scenes(spark: SparkSession, folder: str) -> DataFrame:
    return R.chain_scenes(_chain_named(spark, folder, "the"), corpus.chapters(spark, folder), "the").select("book_id", "book_entity", "chapter_id", "scene_id", "scene_index", "chapter_number")


@query(_CHAIN + " SELECT DISTINCT a.chapter_id, a.scene_id, a.scene_index FROM ch a JOIN ch b USING (scene_id) WHERE a.normalized_name = 'the' AND b.normalized_name = 'of'")
def entity_chain_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return R.chain_co_occurrence(_chain_named(spark, folder, "The", "OF"), "The", "OF")


@query(_CHAIN + " SELECT book_id, book_entity, f.c AS chapter_number, f.i AS scene_index, f.s AS scene_id FROM (SELECT book_id, book_entity, min({'c': chapter_number, 'i': scene_index, 's': scene_id}) AS f FROM ch GROUP BY 1, 2)")
def entity_chain_first(spark: SparkSession, folder: str) -> DataFrame:
    return R.chain_first(_chain(spark, folder, firsts=True), corpus.chapters(spark, folder))


@query("""t0 AS (SELECT chapter_id, normalized_name, extraction_index % 5 > 0 AS named FROM individuals)
SELECT chapter_id, CASE WHEN named THEN 'resolved' ELSE 'unresolved' END AS resolution_status, count(*) AS mentions, count(DISTINCT CASE WHEN named THEN substring(normalized_name, 1, 4) END) AS entities FROM t0 GROUP BY 1, 2""")
def mention_links(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions linked to their chapter entity; those without a usable name stay unresolved."""
    i = F.split("id", "#")[1].cast("int")
    m = _lane(spark, folder, "individual")
    m = m.withColumns({c: F.when(i % 5 > 0, F.col(c)) for c in ("display_name", "normalized_name")}).withColumn("aliases", F.when(i % 5 > 0, F.col("aliases")))
    out = C.linked_mentions(m, C.refers_to(m, "chapter_id"), "chapter_id")
    return out.groupBy("chapter_id", "resolution_status").agg(F.count("*").alias("mentions"), F.count_distinct("entity").alias("entities"))


@query("""t0 AS (SELECT DISTINCT user_id * 2 AS chapter_id FROM events), n AS (SELECT chapter_id, count(*) AS members FROM locations GROUP BY 1)
SELECT chapter_id, CASE WHEN doc_id IS NULL THEN 'MISSING' WHEN members IS NULL THEN 'EMPTY' ELSE 'READY' END AS state, coalesce(members, 0) AS members FROM t0 LEFT JOIN documents ON doc_id = chapter_id LEFT JOIN n USING (chapter_id)""")
def consolidation_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Requested chapters: missing, empty or ready."""
    asked = corpus.table(spark, folder, "events").select((F.col("user_id") * 2).alias("chapter_id"))
    return C.guarded(asked, corpus.chapters(spark, folder), corpus.locations(spark, folder), "chapter_id")


# events of books

_REWRITTEN = _PAIRS + """, me AS (SELECT event_id_1 AS a, event_id_2 AS b, score FROM c WHERE score >= 0.6), both_ways AS (SELECT a, b, score FROM me UNION ALL SELECT b, a, score FROM me),
old AS (SELECT event_id AS node, event_id AS other FROM ev UNION SELECT old.node, m.b FROM old JOIN both_ways m ON old.other = m.a AND m.score >= 0.64), ol AS (SELECT node AS event_id, min(other) AS book_event_id FROM old GROUP BY 1),
dec AS (SELECT a, b FROM me WHERE a % 3 = 0), seeds AS (SELECT event_id FROM ev WHERE chapter_id = 3 UNION SELECT a FROM dec UNION SELECT b FROM dec),
sc AS (SELECT event_id FROM ol WHERE book_event_id IN (SELECT book_event_id FROM ol JOIN seeds USING (event_id)) UNION SELECT event_id FROM seeds),
fe AS (SELECT a, b FROM dec UNION ALL SELECT b, a FROM dec), fr AS (SELECT event_id AS node, event_id AS other FROM sc UNION SELECT fr.node, fe.b FROM fr JOIN fe ON fr.other = fe.a), fl AS (SELECT node AS event_id, min(other) AS book_event_id FROM fr GROUP BY 1),
stay AS (SELECT * FROM ol WHERE event_id NOT IN (SELECT event_id FROM sc))"""
_REWRITTEN = _REWRITTEN.replace("t0", "ev")


def _rewritten(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = _events(spark, folder).select("book_id", "chapter_id", "event_id", F.concat(F.lit("e"), F.col("event_id")).alias("display_name"), F.concat(F.lit("e"), F.col("event_id")).alias("normalized_name"), F.lit("t").alias("event_type"), F.lit(1).alias("mention_count"), F.lit("card").alias("card"))
    pairs = C.verdicts(event_candidates(spark, folder), events, models.merge_above(0.6)).filter("decision = 'MERGE'")
    before = C.book_events(events, pairs.filter("confidence >= 0.64"))
    links = before.select(F.explode("members").alias("event_id"), "book_event_id")
    return C.rewrite_book_events(3, events, pairs.filter("event_id_1 % 3 = 0"), links, before)


@query(corpus.PRELUDE + ", " + _REWRITTEN + """, l AS (SELECT * FROM stay UNION ALL SELECT * FROM fl) SELECT event_id, book_event_id FROM l""", prelude=False)
def rewritten_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of chapter events to book events after one chapter was consolidated."""
    return _rewritten(spark, folder)[1]


@query(corpus.PRELUDE + ", " + _REWRITTEN + """ SELECT book_id, book_event_id, count(*) AS chapter_events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS members FROM ev JOIN fl USING (event_id) GROUP BY 1, 2
UNION ALL SELECT book_id, book_event_id, count(*), string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM ev JOIN ol USING (event_id) WHERE book_event_id IN (SELECT book_event_id FROM stay) AND book_event_id NOT IN (SELECT book_event_id FROM fl) GROUP BY 1, 2""", prelude=False)
def rewritten_book_events(spark: SparkSession, folder: str) -> DataFrame:
    """Book events after one chapter was consolidated: the touched ones anew, others kept, orphans gone."""
    return _rewritten(spark, folder)[0].select("book_id", "book_event_id", "chapter_events", F.array_join("members", ",").alias("members"))


@query(_EVENTS + """, s AS (SELECT a.event_id AS source, a.book_id, a.chapter_id, b.event_id AS target, b.book_id AS tb, b.chapter_id AS tc, round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2, 6) AS score FROM t0 a JOIN t0 b ON a.event_id <> b.event_id),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM s WHERE score >= 0), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS q FROM n WHERE r <= 23 AND book_id = tb AND chapter_id <> tc AND score >= 0.55)
SELECT book_id, source, target, score FROM k WHERE q <= 8""")
def event_candidates_oversampled(spark: SparkSession, folder: str) -> DataFrame:
    """As an index without filters finds them: three times as many of all books, of which those of the book stay."""
    return S.neighbours(_events(spark, folder), 8, 0.55, 64, "oversample")


@query("""t0 AS (SELECT vec_id AS event_id, 'card ' || label AS card, label, vec_id % 5 = 0 AS short FROM embeddings)
SELECT event_id, sha256('m1:' || card) AS expected_hash FROM t0 WHERE label <> 3 AND (event_id % 4 = 1 OR short)""")
def events_to_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose card has changed or whose vector has another size; events without a card are left out."""
    card = F.concat(F.lit("card "), "label")
    e = corpus.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("event_id"), F.when(F.col("label") != 3, card).otherwise(" ").alias("card"), F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"),
        T.embedding_hash("m1", F.when(F.col("vec_id") % 4 == 1, F.lit("old")).otherwise(card)).alias("embedding_hash"),
    )
    return A.to_embed(e, "m1", "card", 64).select("event_id", "expected_hash")


# timeline


@query("SELECT chapter_id, scene_index, scene_id FROM scenes WHERE scene_index % 3 = 0")
def scene_events(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes that carry the label of events."""
    s = corpus.scenes(spark, folder).withColumn("labels", F.when(F.col("scene_index") % 3 == 0, F.array(F.lit("Scene"), F.lit("Event"))).otherwise(F.array(F.lit("Scene"))))
    return L.scene_events(s).select("chapter_id", "scene_index", "scene_id")


@query("""t0 AS (SELECT DISTINCT user_id AS f, user_id + 1 + event_id % 5 AS t FROM events), i AS (SELECT f AS id FROM t0 UNION SELECT t FROM t0)
SELECT id, (SELECT count(*) FROM t0 WHERE f = id) AS later, (SELECT count(*) FROM t0 WHERE t = id) AS earlier FROM i""")
def event_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.table(spark, folder, "events").select(F.col("user_id").alias("from_id"), (F.col("user_id") + 1 + F.col("event_id") % 5).alias("to_id"))
    return L.neighbours_of(e, e.select(F.explode(F.array("from_id", "to_id")).alias("id")))


@query("""t0 AS (SELECT chapter_id, lead(scene_id) OVER (PARTITION BY chapter_id ORDER BY scene_index) IS NOT NULL AS inner_edge FROM scenes) SELECT chapter_id, CAST(count(*) FILTER (inner_edge) AS BIGINT) AS edges FROM t0 GROUP BY 1""")
def chapter_edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that leave each chapter's scenes, within the chapter."""
    return L.edge_counts(corpus.scenes(spark, folder), L.reading_edges(_placed(spark, folder)).filter("source = 'in_chapter'"))


@query("""t0 AS (SELECT * FROM scenes WHERE scene_index > 0) SELECT 'chapters' AS what, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM chapters UNION ALL SELECT 'scenes', NULL, count(*) FROM t0
UNION ALL SELECT 'empty chapters', NULL, count(*) FROM chapters WHERE chapter_id NOT IN (SELECT chapter_id FROM t0) UNION ALL SELECT 'orphan scenes', NULL, count(*) FROM t0 WHERE chapter_id NOT IN (SELECT chapter_id FROM chapters WHERE chapter_id % 6 > 0)
UNION ALL SELECT 'edges', event_type, count(*) FROM events GROUP BY event_type""".replace("'chapters' AS what, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM chapters", "'chapters' AS what, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM chapters WHERE chapter_id % 6 > 0").replace("FROM chapters WHERE chapter_id NOT IN (SELECT chapter_id FROM t0)", "FROM chapters WHERE chapter_id % 6 > 0 AND chapter_id NOT IN (SELECT chapter_id FROM t0)"))
def structure_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts that tell whether a library is whole; here every sixth chapter and every first scene are missing on purpose."""
    chapters, scenes = corpus.chapters(spark, folder).filter("chapter_id % 6 > 0"), corpus.scenes(spark, folder).filter("scene_index > 0")
    return L.structure(chapters, scenes, corpus.table(spark, folder, "events").select(F.col("event_type").alias("temporal_type")))


@query("""t0 AS (SELECT book_id, chapter_number, arg_max(scene_id, scene_index) AS tail, arg_min(scene_id, scene_index) AS head FROM scenes JOIN chapters USING (chapter_id) GROUP BY 1, 2)
SELECT a.book_id, a.chapter_number, a.tail AS last_scene, b.chapter_number AS next_chapter, b.head AS first_scene FROM t0 a JOIN t0 b ON a.book_id = b.book_id AND b.chapter_number = a.chapter_number + 1""")
def chapter_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return L.boundary_pairs(_placed(spark, folder))


@query("""t0 AS (SELECT event_id, user_id AS c, CASE WHEN event_id % 5 > 0 THEN user_id - 1 END AS p, CASE WHEN event_id % 7 > 0 THEN user_id + 1 END AS n, CASE WHEN event_id % 4 > 0 THEN 'before' END AS pt, 'during' AS nt FROM events)
SELECT event_id, 0 AS direction, p AS from_id, c AS to_id, pt AS temporal_type, CAST(0.95 AS DOUBLE) AS weight FROM t0 WHERE p IS NOT NULL AND pt IS NOT NULL UNION ALL SELECT event_id, 1, c, n, nt, 0.5 FROM t0 WHERE n IS NOT NULL""")
def requested_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Temporal edges that scene analyses ask for."""
    i = F.col("event_id")
    t = corpus.table(spark, folder, "events").select(
        F.when(i % 5 > 0, F.col("user_id") - 1).alias("previous_id"), F.col("user_id").alias("current_id"), F.when(i % 7 > 0, F.col("user_id") + 1).alias("next_id"),
        F.when(i % 4 > 0, "before").alias("previous_type"), F.lit("during").alias("next_type"), F.lit("Explicit").alias("previous_certainty"), F.lit(None).cast("string").alias("next_certainty"), i.cast("string").alias("previous_evidence"), i.cast("string").alias("next_evidence"),
    )
    return L.edge_requests(t).select(F.col("evidence").cast("long").alias("event_id"), "direction", "from_id", "to_id", "temporal_type", "weight")


@query("""t0 AS (SELECT list_extract(['before', 'meets', 'after', 'met_by', 'overlaps', 'contains', 'during', 'equals', 'starts'], CAST(event_id % 9 + 1 AS INT)) AS k, event_id FROM events)
SELECT event_id, 'R:temporal.' || CASE WHEN k IN ('before', 'meets') THEN 'after' WHEN k IN ('after', 'met_by') THEN 'before' WHEN k = 'overlaps' THEN 'overlapped_by' WHEN k = 'contains' THEN 'during' WHEN k = 'during' THEN 'contains' END AS inverse FROM t0""")
def inverse_relations(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ("before", "meets", "after", "met_by", "overlaps", "contains", "during", "equals", "starts")
    k = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 9 + 1).cast("int"))
    return corpus.table(spark, folder, "events").select("event_id", L.inverted(k).alias("inverse"))


@query("""t0 AS (SELECT DISTINCT user_id AS f, user_id + 1 + event_id % 20 AS t FROM events WHERE event_type = 'view'), k AS (SELECT DISTINCT user_id AS f, user_id + 1 + event_id % 20 AS t FROM events WHERE event_type = 'purchase')
SELECT f AS from_id, t AS to_id FROM t0 EXCEPT SELECT f, t FROM k""")
def edges_to_add(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.table(spark, folder, "events").select("event_type", F.col("user_id").alias("from_id"), (F.col("user_id") + 1 + F.col("event_id") % 20).alias("to_id"))
    return L.new_edges(e.filter("event_type = 'view'").select("from_id", "to_id").distinct(), e.filter("event_type = 'purchase'"))


# jobs

_NAMED = "list_extract([" + ", ".join(f"'{s}'" for s in D.STEPS) + "], step)"


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    """Stage rows with the declared names of the first stages."""
    return corpus.stages(spark, folder).withColumn("step", F.element_at(F.array(*map(F.lit, D.STEPS)), F.col("step")))


@query("""t0 AS (SELECT job_id, min(CASE WHEN status NOT IN ('COMPLETED', 'SKIPPED', 'FAILED') THEN step END) AS open, bool_or(step = 7 AND status = 'COMPLETED') AS done, bool_or(status = 'FAILED') AS failed,
count(*) FILTER (status IN ('COMPLETED', 'SKIPPED', 'FAILED')) AS ended, count(*) AS total, max(CASE WHEN step = 7 THEN triggered_at END) AS last_at, max(triggered_at) AS any_at FROM stages GROUP BY 1),
s AS (SELECT *, CASE WHEN done THEN 'COMPLETE' WHEN failed THEN 'FAILED' WHEN open IS NOT NULL THEN """ + _NAMED.replace("step)", "open)") + """ ELSE 'COMPLETE' END AS status FROM t0)
SELECT job_id, status, CASE WHEN status = 'FAILED' THEN -1 ELSE CAST(floor(ended * 100 / total) AS INT) END AS progress_percent, coalesce(last_at, any_at) AS completed_at FROM s""")
def job_status_named(spark: SparkSession, folder: str) -> DataFrame:
    """Status by the names of stages, in their declared order."""
    return J.summaries(_stages(spark, folder), D.STEPS[6], D.STEPS)


@query("SELECT job_id, step AS place, " + _NAMED + " AS step, status, attempts FROM stages")
def job_details(spark: SparkSession, folder: str) -> DataFrame:
    return J.details(_stages(spark, folder), D.STEPS)


@query("""SELECT job_id, created_at, chapter_id, (SELECT count(*) FROM jobs) AS total, 60 < (SELECT count(*) FROM jobs) AS has_more FROM jobs ORDER BY created_at DESC NULLS LAST, job_id LIMIT 20 OFFSET 40""")
def job_page_of(spark: SparkSession, folder: str) -> DataFrame:
    """A page of jobs with the total and whether more follow."""
    return J.page_of(corpus.jobs(spark, folder), 20, 40)


@query("""t0 AS (SELECT job_id, bool_or(status = 'FAILED') AS failed, bool_or(step = 7 AND status = 'COMPLETED') AS done, min(CASE WHEN status NOT IN ('COMPLETED', 'SKIPPED', 'FAILED') THEN step END) AS open FROM stages GROUP BY 1)
SELECT job_id, CAST(open AS VARCHAR) AS status FROM t0 WHERE NOT failed AND NOT done AND open IS NOT NULL""")
def active_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return J.by_status(J.summaries(corpus.stages(spark, folder), 7), "ACTIVE").select("job_id", "status")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{k}', '{d}', '{s}', '{p}')" for i, (k, d, s, p) in enumerate(D._SUBJECTS)) + ") v(place, key, description, scope, prerequisites)", prelude=False)
def stage_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return D.catalogue(spark)


@query("SELECT job_id, " + _NAMED + " AS step, CASE WHEN job_id = 1 AND step = 2 THEN 'TRIGGERED' WHEN job_id = 1 AND step IN (3, 17) THEN 'PENDING' ELSE status END AS status FROM stages")
def rerun_stages(spark: SparkSession, folder: str) -> DataFrame:
    """A rerun of one stage of one job sets what follows it back."""
    return D.rerun(_stages(spark, folder), 1, "CHUNKING").select("job_id", "step", "status")


@query("""t0 AS (SELECT o_custkey AS book_id, o_orderpriority AS lane, 'h' || o_orderkey AS token, o_orderdate AS at_ FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0),
h AS (SELECT book_id, lane, token, at_ FROM t0 QUALIFY row_number() OVER (PARTITION BY book_id, lane ORDER BY at_, token) = 1), g AS (SELECT * FROM h WHERE at_ >= TIMESTAMP '1995-06-01' - INTERVAL 30 MINUTE),
a AS (SELECT o_custkey AS book_id, o_orderpriority AS lane, 'a' || o_orderkey AS token, o_orderdate AS at_ FROM orders WHERE o_orderkey % 4 = 0), w AS (SELECT book_id, lane, min({'t': at_, 'k': token}) AS r FROM a ANTI JOIN g USING (book_id, lane) GROUP BY 1, 2)
SELECT book_id, lane, token, at_ AS claimed_at FROM g UNION ALL SELECT book_id, lane, r.k, r.t FROM w""")
def claims_granted(spark: SparkSession, folder: str) -> DataFrame:
    """Who holds each book and lane: claims that aren't stale stay, free ones go to the earliest request."""
    o = corpus.table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("lane"), F.col("o_orderdate").alias("claimed_at"))
    token = lambda k: F.concat(F.lit(k), F.col("o_orderkey")).alias("token")
    held = C.upsert_first(o.filter("o_orderkey % 3 = 0 and o_orderkey % 4 <> 0").select("book_id", "lane", token("h"), "claimed_at"), ["book_id", "lane"], "claimed_at")
    return C.granted_claims(held, o.filter("o_orderkey % 4 = 0").select("book_id", "lane", token("a"), "claimed_at"), "1995-06-01 00:00:00")


# library


@query("""t0 AS (SELECT doc_id AS submission, sha256(text) AS h FROM documents WHERE doc_id % 5 < 4), k AS (SELECT sha256(text) AS h, min(doc_id) AS known_id FROM documents WHERE doc_id % 5 = 4 GROUP BY 1),
a AS (SELECT chapter_id, min(job_id) AS job_id FROM (SELECT o_custkey AS chapter_id, o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O') GROUP BY 1), f AS (SELECT h, min(submission) AS first FROM t0 GROUP BY 1)
SELECT submission, coalesce(known_id, first) AS chapter_id, CASE WHEN job_id IS NOT NULL THEN 'ACTIVE' WHEN known_id IS NOT NULL THEN 'EXISTING' WHEN submission = first THEN 'CREATED' ELSE 'REPEATED' END AS state, job_id
FROM t0 JOIN f USING (h) LEFT JOIN k USING (h) LEFT JOIN a ON a.chapter_id = known_id""")
def submission_states(spark: SparkSession, folder: str) -> DataFrame:
    """Submitted texts: new, there already, or there with a job that is still running."""
    d = corpus.table(spark, folder, "documents").select("doc_id", "text")
    known = d.filter("doc_id % 5 = 4").select(F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("chapter_id"))
    jobs = corpus.table(spark, folder, "orders").select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("COMPLETE").alias("status"))
    return B.submitted(d.filter("doc_id % 5 < 4").select(F.col("doc_id").alias("submission"), "text"), known, jobs)


@query("""t0 AS (SELECT lang AS universe, source AS series, 'Book ' || doc_id % 9 AS title, min(CAST(doc_id % 3 AS INT)) AS book_number FROM documents WHERE doc_id % 2 = 1 GROUP BY 1, 2, 3),
k AS (SELECT lower(lang) AS u, source AS s, lower('BOOK ' || doc_id % 9) AS t, min({'t': 'BOOK ' || doc_id % 9, 'n': CAST(7 AS INT)}) AS r FROM documents WHERE doc_id % 4 = 0 GROUP BY 1, 2, 3)
SELECT universe, series, coalesce(r.t, title) AS title, coalesce(r.n, book_number) AS book_number, r IS NULL AS is_new, CAST(NULL AS VARCHAR) AS problem FROM t0 LEFT JOIN k ON k.u = lower(universe) AND k.s = series AND k.t = lower(title)""")
def created_books(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted books, new or as they are there already."""
    d = corpus.table(spark, folder, "documents")
    title = lambda word: F.concat(F.lit(word + " "), F.col("doc_id") % 9).alias("title")
    wanted = d.filter("doc_id % 2 = 1").select(F.col("lang").alias("universe"), F.col("source").alias("series"), title(" Book"), (F.col("doc_id") % 3).cast("int").alias("book_number"))
    return B.create_books(wanted, d.filter("doc_id % 4 = 0").select(F.col("lang").alias("universe"), F.col("source").alias("series"), title("BOOK"), F.lit(7).alias("book_number")))


@query("SELECT chapter_id, book_id, chapter_number FROM chapters WHERE book_id = 'en/src1/2' AND chapter_number <= 5")
def chapters_up_to(spark: SparkSession, folder: str) -> DataFrame:
    return B.up_to(corpus.chapters(spark, folder), "en/src1/2", 5).select("chapter_id", "book_id", "chapter_number")


@query("SELECT chapter_id, universe, book_number FROM chapters WHERE series IS NULL AND universe = 'en'")
def standalone_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup by keys, among them a missing one."""
    return B.lookup(corpus.chapters(spark, folder), universe="en", series=None).select("chapter_id", "universe", "book_number")


@query("SELECT event_id, book_id, chapter_id FROM (SELECT chunk_id AS event_id, book_id, chapter_id FROM chunks WHERE chapter_id IS NOT NULL) WHERE book_id IN ('en/src1/1', 'en/src1/2', 'en/-/3')")
def events_of_books(spark: SparkSession, folder: str) -> DataFrame:
    return B.in_scope(_events(spark, folder), book_id=["en/src1/1", "en/src1/2", "en/-/3"]).select("event_id", "book_id", "chapter_id")


@query("SELECT count(*) AS entities, count(embedding) AS embedded, count(embedding) > 0 AS available FROM embeddings", prelude=False)
def availability(spark: SparkSession, folder: str) -> DataFrame:
    return S.available(corpus.table(spark, folder, "embeddings"))


# small joins


@query("""t0 AS (SELECT user_id AS a, user_id + 1 + event_id % 3 AS b, event_type FROM events), p AS (SELECT DISTINCT a, b FROM t0 WHERE event_type = 'view'), e AS (SELECT a, b, count(*) AS n FROM t0 WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT a, b, coalesce(n, 0) AS n FROM p LEFT JOIN e USING (a, b)""")
def linked_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.table(spark, folder, "events").select("event_type", F.col("user_id").alias("from_id"), (F.col("user_id") + 1 + F.col("event_id") % 3).alias("to_id"))
    return A.linked_counts(e.filter("event_type = 'view'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), e.filter("event_type = 'purchase'"))


@query("""t0 AS (SELECT DISTINCT l_partkey AS record_id, l_orderkey AS job_id FROM lineitem WHERE l_linenumber < 4), q AS (SELECT DISTINCT l_partkey AS record_id, l_orderkey + l_linenumber % 2 AS job_id FROM lineitem WHERE l_linenumber >= 2)
SELECT record_id, job_id, t0.record_id IS NOT NULL AS there FROM q LEFT JOIN t0 USING (record_id, job_id)""".replace("t0.record_id IS NOT NULL", "(record_id, job_id) IN (SELECT (record_id, job_id) FROM t0)"))
def record_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Which records belong to the jobs that ask for them."""
    li = corpus.table(spark, folder, "lineitem")
    have = li.filter("l_linenumber < 4").select(F.col("l_partkey").alias("record_id"), F.col("l_orderkey").alias("job_id"))
    return A.records_of(have, li.filter("l_linenumber >= 2").select(F.col("l_partkey").alias("record_id"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("job_id")), "job_id")


@query("""t0 AS (SELECT user_id AS a, user_id + 1 + event_id % 3 AS b, event_type FROM events), e AS (SELECT a, b FROM t0 WHERE event_type = 'purchase' UNION SELECT b, a FROM t0 WHERE event_type = 'purchase')
SELECT DISTINCT a, b FROM t0 SEMI JOIN e USING (a, b) WHERE event_type = 'view'""")
def pairs_linked_either_way(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.table(spark, folder, "events").select("event_type", F.col("user_id").alias("from_id"), (F.col("user_id") + 1 + F.col("event_id") % 3).alias("to_id"))
    return A.linked_either_way(e.filter("event_type = 'view'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct(), e.filter("event_type = 'purchase'"))


@query("""t0 AS (SELECT user_id AS scene_id, 'k' || event_id % 4 AS subject, 'R:r' || event_id % 3 AS definition_key, 'o' || event_id % 2 AS object, event_id FROM events)
SELECT event_id FROM t0 SEMI JOIN (SELECT * FROM t0 WHERE event_id % 10 = 0) USING (scene_id, subject, definition_key, object)""")
def claims_known_already(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("event_id")
    c = corpus.table(spark, folder, "events").select(i, F.col("user_id").alias("scene_id"), F.concat(F.lit("k"), i % 4).alias("subject"), F.concat(F.lit("R:r"), i % 3).alias("definition_key"), F.concat(F.lit("o"), i % 2).alias("object"))
    return A.repeated_claims(c, c.filter(i % 10 == 0)).select("event_id")


@query("""t0 AS (SELECT DISTINCT user_id AS scene_id, 'k' || event_id % 4 AS sk, 'R:r' || event_id % 3 AS d, 'k' || event_id % 5 AS ok FROM events),
m AS (SELECT user_id AS scene_id, 'k' || event_id % 6 AS key, arg_max(event_id, event_id) AS id FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT scene_id, sk AS subject_key, d AS definition_key, ok AS object_key, s.id AS subject_id, o.id AS object_id FROM t0 LEFT JOIN m s USING (scene_id) LEFT JOIN m o USING (scene_id)""".replace("LEFT JOIN m s USING (scene_id) LEFT JOIN m o USING (scene_id)", "LEFT JOIN m s ON s.scene_id = t0.scene_id AND s.key = sk LEFT JOIN m o ON o.scene_id = t0.scene_id AND o.key = ok").replace("SELECT scene_id, sk AS", "SELECT t0.scene_id, sk AS"))
def resolved_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Relation claims with the mentions at both ends; mentions of events are not linked."""
    i, k = F.col("event_id"), lambda n: F.concat(F.lit("k"), F.col("event_id") % n)
    e = corpus.table(spark, folder, "events")
    claims = e.select(F.col("user_id").alias("scene_id"), F.lit("p").alias("subject_kind"), k(4).alias("subject_key"), F.concat(F.lit("R:r"), i % 3).alias("definition_key"), F.lit("p").alias("object_kind"), k(5).alias("object_key"))
    mentions = e.select(F.col("user_id").alias("scene_id"), F.when(F.col("event_type") == "view", "event").otherwise("p").alias("kind"), k(6).alias("key"), i.alias("id"), i.alias("extraction_index"))
    return C.resolve_claims(claims, mentions).select("scene_id", "subject_key", "definition_key", "object_key", "subject_id", "object_id")


@query("""t0 AS (SELECT p_partkey AS d, p_type AS t FROM part) SELECT d AS definition_id, (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT DISTINCT l_returnflag || '->' || l_linestatus AS x FROM lineitem WHERE l_partkey = d)) AS signatures,
(SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS x FROM lineitem WHERE l_partkey = d AND l_linenumber = 1)) AS variants FROM t0""")
def definition_details(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions with their signatures and variants gathered."""
    li = corpus.table(spark, folder, "lineitem").withColumn("definition_id", F.col("l_partkey"))
    c = corpus.table(spark, folder, "part").select(F.col("p_partkey").alias("definition_id"))
    out = A.definitions(c, li.select("definition_id", F.col("l_returnflag").alias("subject_kind"), F.col("l_linestatus").alias("object_kind")), li.filter("l_linenumber = 1").select("definition_id", F.col("l_suppkey").cast("string").alias("variant")))
    return out.select("definition_id", *[F.coalesce(F.array_join(x, ","), F.lit("")).alias(x) for x in ("signatures", "variants")])


@query("""t0 AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48) SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT p FROM t0)""")
def orphan_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that nothing refers to."""
    links = corpus.table(spark, folder, "lineitem").filter("l_returnflag = 'R' and l_quantity > 48").select(F.col("l_partkey").alias("part"))
    return C.orphans(corpus.table(spark, folder, "part").select(F.col("p_partkey").alias("part")), links, "part")


@query("""t0 AS (SELECT p_partkey AS i FROM part), f AS (SELECT DISTINCT vec_id AS i FROM embeddings WHERE vec_id % 3 = 0)
SELECT i AS definition_id, CASE WHEN f.i IS NOT NULL THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2010-01-01' END AS last_seen_at FROM t0 LEFT JOIN f USING (i)""".replace("f.i IS NOT NULL", "i IN (SELECT i FROM f)"))
def catalog_touched(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions that a round of questions found are seen now."""
    catalog = corpus.table(spark, folder, "part").select(F.col("p_partkey").alias("definition_id"), F.lit("2010-01-01").cast("timestamp").alias("last_seen_at"))
    found = corpus.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("definition_id"), F.when(F.col("vec_id") % 3 == 0, "VECTOR").otherwise("CREATED").alias("how"))
    return C.touched(catalog, found, "2020-01-01").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp_ntz"))


@query("""t0 AS (SELECT l_orderkey AS job_id, l_linenumber AS stage_id FROM lineitem) SELECT job_id, stage_id FROM t0 WHERE stage_id NOT IN (2, 3)""")
def rows_without_stages(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage_id"))
    return C.delete_by_stage(rows, [2, 3])


@query("""SELECT chapter_id, scene_index, rows FROM (SELECT doc_id % 50 AS chapter_id, doc_id % 7 AS scene_index, count(*) AS rows FROM documents GROUP BY 1, 2) WHERE rows > 1""")
def repeated_scene_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Natural keys that more than one row has."""
    d = corpus.table(spark, folder, "documents").select((F.col("doc_id") % 50).alias("chapter_id"), (F.col("doc_id") % 7).alias("scene_index"))
    return schemas.repeated_keys(d, "scene")


# texts


@query(_HITS + """, k AS (SELECT * FROM hits ORDER BY score DESC, chunk_id LIMIT 20), p AS (SELECT chapter_id, list_sort(list_distinct(list(display_name))) AS n FROM individuals GROUP BY 1), l AS (SELECT chapter_id, list_sort(list_distinct(list(display_name))) AS n FROM locations GROUP BY 1)
SELECT chunk_id, coalesce(array_to_string(p.n, ','), '') AS individuals, coalesce(array_to_string(l.n, ','), '') AS locations FROM k LEFT JOIN p USING (chapter_id) LEFT JOIN l USING (chapter_id)""")
def chunk_context(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunks with the people and places of their chapter."""
    hits = S.semantic_search(corpus.chunks(spark, folder), _first_vector(spark, folder), 20)
    of = hits.select("chapter_id")
    people, places = (m.join(of, "chapter_id", "left_semi") for m in (corpus.individuals(spark, folder), corpus.locations(spark, folder)))
    out = R.scene_context(hits, people, places)
    return out.select("chunk_id", *[F.coalesce(F.array_join(x, ","), F.lit("")).alias(x) for x in ("individuals", "locations")])


@query("""t0 AS (SELECT chapter_id AS rank, book_number, CASE WHEN chapter_id % 5 > 0 THEN chapter_number END AS chapter_number, series, universe, substring(text, 1, 20) AS quote FROM chapters)
SELECT rank, '[' || rank || '] ' || quote || CASE WHEN tag <> '' THEN ' (' || tag || ')' ELSE '' END AS line FROM (SELECT *, concat_ws(' — ', CASE WHEN chapter_number IS NOT NULL THEN 'Book ' || book_number || ', Chapter ' || chapter_number END,
CASE WHEN series IS NOT NULL THEN 'featuring: ' || series || ', ' || universe END, CASE WHEN rank % 2 = 0 THEN 'at: ' || universe END) AS tag FROM t0)""")
def evidence_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence as it is shown to a model: text, place, who and where."""
    i, none = F.col("chapter_id"), F.array().cast("array<string>")
    rows = corpus.chapters(spark, folder).select(
        i.alias("rank"), "book_number", F.when(i % 5 > 0, F.col("chapter_number")).alias("chapter_number"), F.substring("text", 1, 20).alias("quote"),
        F.when(F.col("series").isNotNull(), F.array("series", "universe")).otherwise(none).alias("individuals"), F.when(i % 2 == 0, F.array("universe")).otherwise(none).alias("locations"),
    )
    return R.evidence_context(rows)


@query(f"""t0 AS (SELECT chapter_id, scene_index, nullif({_TRIM.format('substring(text, 1, 40)')}, '') AS anchor FROM scenes), g AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY scene_index) - 1 AS n FROM t0)
SELECT chapter_id, CAST(n AS INT) AS place, scene_index AS "index", trim(anchor) AS start_anchor FROM (SELECT chapter_id, scene_index, anchor, row_number() OVER (PARTITION BY chapter_id ORDER BY scene_index) - 1 AS n FROM g WHERE scene_index % 4 <> 3)""")
def parsed_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in XML with escaped text, read back; scenes without a summary are dropped."""
    s = corpus.scenes(spark, folder).withColumn("anchor", T.blank_to_null(F.substring("text", 1, 40)))
    xml = F.concat(F.lit("<scene><index>"), "scene_index", F.lit("</index><start_anchor>"), T.escape_xml(F.col("anchor")), F.lit("</start_anchor><context_summary>"), F.when(F.col("scene_index") % 4 == 3, "").otherwise("s"), F.lit("</context_summary></scene>"))
    answers = s.groupBy("chapter_id").agg(F.concat(F.lit("```xml\n<scenes>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_index", xml.alias("x")))), lambda x: x.x), ""), F.lit("</scenes>\n```")).alias("answer"))
    out = answers.select("chapter_id", F.posexplode(X.parse_scenes(F.col("answer"))).alias("place", "s"))
    return out.select("chapter_id", "place", "s.index", "s.start_anchor")


@query("""t0 AS (SELECT scene_id, extraction_index, display_name FROM individuals)
SELECT scene_id, extraction_index, CASE extraction_index % 3 WHEN 0 THEN display_name ELSE 'alias ' || display_name END AS display_name, 'unresolved' AS resolution_status, CAST(extraction_index AS VARCHAR) AS age FROM t0 WHERE extraction_index % 3 < 2""")
def exploded_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions out of the JSON of scene analyses: named, named by an alias, or dropped."""
    i = F.col("extraction_index")
    item = F.struct(i.alias("i"), F.when(i % 3 == 0, F.col("display_name")).otherwise(" ").alias("name"), F.when(i % 3 == 1, F.array(F.lit(""), F.concat(F.lit("alias "), "display_name"))).alias("aliases"), i.cast("string").alias("age"))
    rows = corpus.individuals(spark, folder).groupBy("scene_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))
    return X.explode_extractions(rows, "age:string").drop("aliases")


@query(f"""t0 AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN ' ' ELSE {_TRIM.format('substring(text, 1, 30)')} END AS s, CASE WHEN turn % 5 = 4 THEN '' ELSE role END AS r, substring(text, 31, 20) AS o, text FROM conversations)
SELECT conv_id, turn, {_TRIM.format('s')} AS subject, {_TRIM.format('r')} AS relation, 'R:' || r AS definition_key, {_TRIM.format('o')} AS object, CASE WHEN length({_TRIM.format('text')}) <= 500 THEN {_TRIM.format('text')} ELSE substring({_TRIM.format('text')}, 1, 499) || '…' END AS evidence,
CASE turn % 3 WHEN 0 THEN 'Explicit' WHEN 1 THEN 'StronglyImplied' ELSE 'WeaklyImplied' END AS certainty FROM t0 WHERE {_TRIM.format('s')} <> '' AND r <> '' AND {_TRIM.format('o')} <> ''""")
def clean_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Relation claims made whole and cut to size; incomplete ones are dropped."""
    t = F.col("turn")
    rows = corpus.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(t % 4 == 3, " ").otherwise(T.strip_controls(F.substring("text", 1, 30))).alias("subject"), F.when(t % 5 == 4, "").otherwise(F.col("role")).alias("relation"), F.substring("text", 31, 20).alias("object"),
        F.lit(None).cast("string").alias("description"), F.col("text").alias("evidence"), F.when(t % 3 == 0, "is EXPLICIT").when(t % 3 == 1, "strongly implied").alias("certainty"),
    )
    return A.normalized_claims(rows).drop("description")


@query("""t0 AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'raw ' || o_orderstatus END AS raw, lower(o_orderpriority) AS k FROM orders)
SELECT id, 'about ' || k || ': ' || CASE WHEN raw IS NULL OR raw = ' ' THEN k ELSE raw END AS embedding_text, CASE WHEN raw IS NULL OR raw = ' ' THEN k ELSE raw END AS first_text, k || ',' || 'X' AS names, substring(k, 1, 5) AS cut, sha256(k) AS sha256, length(k) > 5 AS truncated FROM t0""")
def prompt_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts for embeddings, first usable values, unions of names, bodies cut with their hash."""
    i, k = F.col("o_orderkey"), F.lower("o_orderpriority")
    raw = F.when(i % 4 == 1, " ").when(i % 4 > 1, F.concat(F.lit("raw "), "o_orderstatus"))
    body = T.body(k, 5)
    return corpus.table(spark, folder, "orders").select(
        i.alias("id"), T.embedding_text(F.concat(F.lit("about "), k), raw, k).alias("embedding_text"), T.first_non_blank(raw, k).alias("first_text"),
        F.array_join(T.union_names(F.array(k, F.upper(k)), F.array(F.lit("X"), k, F.lit("x"))), ",").alias("names"), body["text"].alias("cut"), body["sha256"].alias("sha256"), body["truncated"].alias("truncated"),
    )


@query("""t0 AS (SELECT user_id AS f, user_id + 1 AS t, event_type, value FROM events) SELECT f AS from_id, t AS to_id, CASE event_type WHEN 'view' THEN 'R:temporal.view' ELSE 'x:' || event_type END AS temporal_type, value AS weight, 'legacy' AS source FROM t0""")
def upgraded_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the old form in the present one."""
    k = F.col("event_type")
    return A.upgraded_edges(corpus.table(spark, folder, "events").select(F.col("user_id").alias("from_id"), (F.col("user_id") + 1).alias("to_id"), F.when(k == "view", F.upper(k)).otherwise(F.concat(F.lit("x:"), k)).alias("type"), F.col("value").alias("confidence")))
