"""A table of questions answered in one plan: routing, lookups, retrieval, fusion and status, grouped by question.

Lookups (who is, where was, tell me about, ...) go to the entity chain, people first, then places; others, and lookups
that find nothing, go to the narrative.  The narrative asks a vector index; names that the question holds move
chunks up.  With `hybrid`, chunks of the chapters that mention the subject are a second branch and the ranks are
fused.  Nothing is collected: names are gathered before they meet questions, and each branch is cut to its
best rows for a name or a question before it is joined further.

Status: OK; DEGRADED (the vector branch failed, the graph branch answers); SEARCH_FAILED (a branch failed and nothing was
found); NO_EVIDENCE.  A question without a vector (its embedding call failed) is one whose vector branch failed.

Defined cases: a null or blank question is narrative; a name that no reader may see finds nothing; ties go to the smaller
book, entity and chunk; question ids are unique; an empty table of questions gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.text import intent, mentions_name, normalize_name, snippet, subject
from narrata.operators.filters import Visibility, visible
from narrata.operators.graph import cut
from narrata.operators.index import Index
from narrata.operators.search import BOOST, RRF, visible_indexed
from narrata.plans.retrieval import BRANCH


def routed(questions: DataFrame) -> DataFrame:
    """Adds intent, subject and the normalised name that a question (question_id, question, embedding) asks about."""
    q = F.col("question")
    return questions.select("question_id", "question", "embedding", intent(q).alias("intent"), normalize_name(F.coalesce(subject(q), q)).alias("name"))


def _first(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("rank") <= n)


def looked_up(asked: DataFrame, chain: DataFrame, chapters: DataFrame, visibility: Visibility | None = None, most: int = BRANCH) -> DataFrame:
    """(question_id, rank, item, score, line): the book entities of the name that each question (question_id, name) asks for."""
    seen = chapters.filter(visible(visibility)).select("chapter_id")
    mine = chain.join(asked.select(F.col("name").alias("normalized_name")).distinct(), "normalized_name", "left_semi").join(seen, "chapter_id", "left_semi")
    entities = mine.groupBy(F.col("normalized_name").alias("name"), "book_id", "book_entity", "display_name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("name").orderBy("book_id", "book_entity")
    entities = entities.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most)
    rows = _first(asked.join(entities, "name"), most, "book_id", "book_entity")
    line = F.concat("display_name", F.lit(": "), "n", F.lit(" mentions in "), "book_id")
    return rows.select("question_id", "rank", F.col("display_name").alias("item"), F.col("n").cast("double").alias("score"), line.alias("line"))


def graph_branch(asked: DataFrame, chain: DataFrame, chunks: DataFrame, size: int, visibility: Visibility | None = None) -> DataFrame:
    """(question_id, chunk_id, rank): visible chunks of the chapters that mention the entity each question is about."""
    places = chain.join(asked.select(F.col("name").alias("normalized_name")).distinct(), "normalized_name", "left_semi").select(F.col("normalized_name").alias("name"), "chapter_id").distinct()
    rows = chunks.filter(visible(visibility)).select("chunk_id", "chapter_id").join(places, "chapter_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("chunk_id"))).filter(F.col("rank") <= size)
    return asked.select("question_id", "name").join(rows, "name").select("question_id", "chunk_id", "rank")


def fused(vector: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion by question: score, branches, best rank, vector rank, id decide; (question_id, chunk_id, score, rank)."""
    both = vector.select("question_id", "chunk_id", "rank", F.col("rank").alias("own")).unionByName(graph.select("question_id", "chunk_id", "rank", F.lit(None).cast("int").alias("own")))
    rows = both.groupBy("question_id", "chunk_id").agg(
        F.round(F.sum(1 / (F.lit(RRF) + F.col("rank"))), 9).alias("score"), F.count("*").alias("branches"), F.min("rank").alias("best"), F.min("own").alias("own")
    )
    return _first(rows, k, F.desc("score"), F.desc("branches"), "best", F.asc_nulls_last("own"), "chunk_id").select("question_id", "chunk_id", "score", "rank")


def boosted(vector: DataFrame, asked: DataFrame, chunks: DataFrame, individuals: DataFrame) -> DataFrame:
    """Vector results (question_id, chunk_id, score, rank) moved up by each distinct name of their chapter that the question holds."""
    rows = cut(vector.join(chunks.select("chunk_id", "chapter_id"), "chunk_id").join(asked.select("question_id", "question"), "question_id"))
    low = F.lower("display_name").alias("low")
    names = individuals.join(rows.select("chapter_id").distinct(), "chapter_id", "left_semi").select("chapter_id", low, "display_name").dropDuplicates(["chapter_id", "low"])
    met = rows.select("question_id", "question", "chapter_id").distinct().join(names, "chapter_id").filter(mentions_name(F.col("question"), F.col("display_name")))
    hits = met.groupBy("question_id", "chapter_id").agg(F.count("*").alias("hits"))
    out = rows.join(hits, ["question_id", "chapter_id"], "left").withColumn("score", F.round(F.col("score") + F.lit(BOOST) * F.coalesce("hits", F.lit(0)), 6))
    again = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank")
    return out.select("question_id", "chunk_id", "score", F.row_number().over(again).alias("rank"))


def answers(
    questions: DataFrame, index: Index, chunks: DataFrame, chapters: DataFrame, people: DataFrame, places: DataFrame, individuals: DataFrame,
    k: int = 5, threshold: float = 0.0, visibility: Visibility | None = None, hybrid: bool = False, probes: int | None = None,
) -> DataFrame:
    """(question_id, route, status, rank, item, score, line): the evidence of each question; a question without any has one row with null rank.

    questions: question_id, question, embedding; index: over chunks, id = chunk_id; people and places: entity chains.
    """
    asked = cut(routed(questions))
    names = asked.select(F.col("name").alias("normalized_name")).distinct()
    people, places = (cut(c.join(names, "normalized_name", "left_semi").select("normalized_name", "book_id", "book_entity", "display_name", "chapter_id")) for c in (people, places))
    lookups = asked.filter("intent = 'ENTITY_LOOKUP' and name is not null").select("question_id", "name")
    persons = cut(looked_up(lookups, people, chapters, visibility))
    others = lookups.join(persons.select("question_id"), "question_id", "left_anti")
    found = cut(persons.unionByName(looked_up(others, places, chapters, visibility)))
    rest = cut(asked.join(found.select("question_id").distinct(), "question_id", "left_anti"))

    size = max(BRANCH, k) if hybrid else k
    with_vector = rest.filter("embedding is not null").select(F.col("question_id").alias("query"), "embedding")
    vector = visible_indexed(index, chunks, with_vector, size, visibility, probes).withColumnRenamed("query", "question_id")
    if hybrid:
        best = fused(vector, graph_branch(rest.filter("name is not null"), people, chunks, size, visibility), k)
    else:
        best = boosted(vector.filter(F.col("score") >= threshold), rest, chunks, individuals)
    place = F.when(F.col("book_number").isNotNull(), F.concat(F.lit(" (Book "), "book_number", F.lit(", Chapter "), "chapter_number", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce(snippet(F.col("snippet"), 120), F.lit("")), place)
    told = best.join(chunks.select("chunk_id", "snippet", "book_number", "chapter_number"), "chunk_id")
    told = told.select("question_id", "rank", F.col("chunk_id").cast("string").alias("item"), "score", line.alias("line"))
    failed = F.col("embedding").isNull()
    status = F.when(F.col("rank").isNotNull(), F.when(failed, "DEGRADED").otherwise("OK")).otherwise(F.when(failed, "SEARCH_FAILED").otherwise("NO_EVIDENCE"))
    narrative = rest.select("question_id", "embedding").join(told, "question_id", "left").withColumn("status", status)
    columns = ["question_id", "route", "status", "rank", "item", "score", "line"]
    return found.withColumns({"route": F.lit("ENTITY_LOOKUP"), "status": F.lit("OK")}).select(columns).unionByName(narrative.withColumn("route", F.lit("NARRATIVE_QA")).select(columns))
