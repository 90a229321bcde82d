"""Scene analyses and the small joins around them: validation, normalisation, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.text import blank_to_null, certainty, clean_aliases, definition_key, embedding_hash, truncate

#: Relations that a scene analysis may state, and phrases that are no names.
ALLOWED = ("before", "after", "overlaps", "contains", "during")
STOP_PHRASES = ("what", "who", "where", "when", "why", "how", "it", "he", "she", "they", "this", "that", "the story", "the book", "the chapter", "the scene")
LONG, SHORT = 1000, 500


def normalized_items(c: Column, kind: str) -> Column:
    """Items of one lane of an analysis (array of structs name, aliases, description, certainty): cleaned, nameless ones dropped.

    Concepts and events also need a description.
    """
    items = F.transform(c, lambda x: F.struct(
        F.coalesce(blank_to_null(x["name"]), F.get(clean_aliases(x["aliases"]), F.lit(0))).alias("name"), clean_aliases(F.coalesce(x["aliases"], F.array().cast("array<string>"))).alias("aliases"),
        truncate(blank_to_null(x["description"]), LONG).alias("description"), certainty(x["certainty"]).alias("certainty"),
    ))
    strict = kind in ("concept", "event")
    return F.filter(items, lambda x: x["name"].isNotNull() & (x["description"].isNotNull() if strict else F.lit(True)))


def normalized_claims(claims: DataFrame) -> DataFrame:
    """Relation claims (subject, relation, object, description, evidence, certainty): keys, cut texts, complete ones only."""
    rows = claims.select(
        *[c for c in claims.columns if c not in ("subject", "relation", "object", "description", "evidence", "certainty")],
        blank_to_null(F.col("subject")).alias("subject"), blank_to_null(F.col("relation")).alias("relation"), blank_to_null(F.col("object")).alias("object"),
        truncate(blank_to_null(F.col("description")), LONG).alias("description"), truncate(blank_to_null(F.col("evidence")), SHORT).alias("evidence"), certainty(F.col("certainty")).alias("certainty"),
    )
    return rows.filter("subject is not null and relation is not null and object is not null").withColumn("definition_key", definition_key(F.col("relation")))


def validated(triads: DataFrame) -> DataFrame:
    """Adds `problem` to analyses (previous_id, next_id, previous_type, next_type): null, MISSING_* or INVALID_*.

    A relation is needed wherever there is a neighbour.
    """
    def check(side: str) -> Column:
        kind = F.replace(F.lower(F.trim(F.col(f"{side}_type"))), F.lit("r:temporal."), F.lit(""))
        missing = F.coalesce(F.trim(F.col(f"{side}_type")), F.lit("")) == ""
        return F.when(F.col(f"{side}_id").isNotNull(), F.when(missing, f"MISSING_{side.upper()}").when(~kind.isin(*ALLOWED), f"INVALID_{side.upper()}"))

    return triads.withColumn("problem", F.coalesce(check("previous"), check("next")))


def chunk_coordinates(chunks: DataFrame, scenes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks (chunk_id, scene_id, chapter_id) with their chapter, reached through the scene or else directly."""
    via = scenes.select("scene_id", F.col("chapter_id").alias("via_chapter"))
    rows = chunks.join(via, "scene_id", "left").withColumn("chapter_id", F.coalesce("via_chapter", "chapter_id")).drop("via_chapter")
    return rows.join(chapters, "chapter_id", "left")


def ordered_chunks(chunks: DataFrame, scenes: DataFrame, chapter_id) -> DataFrame:
    """Chunks of a chapter through its scenes, in order."""
    s = scenes.filter(F.col("chapter_id") == chapter_id).select("scene_id", "scene_index")
    return chunks.join(s, "scene_id").orderBy("scene_index", "chunk_number")


def definitions(catalog: DataFrame, signatures: DataFrame, variants: DataFrame) -> DataFrame:
    """Definitions with their signatures and variants gathered."""
    s = signatures.groupBy("definition_id").agg(F.array_sort(F.collect_set(F.concat_ws("->", "subject_kind", "object_kind"))).alias("signatures"))
    v = variants.groupBy("definition_id").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    return catalog.join(s, "definition_id", "left").join(v, "definition_id", "left")


def to_embed(rows: DataFrame, model: str, content: str = "content_hash", dimensions: int | None = None) -> DataFrame:
    """Rows without an embedding, or with one of another model or content; with `dimensions` also those whose vector has another size.

    content: the column that the embedding's hash is made of (a chunk's hash, an event's card); blank content is left out.
    """
    rows = rows.withColumn("expected_hash", embedding_hash(model, F.col(content))).filter(blank_to_null(F.col(content)).isNotNull())
    old = F.col("embedding").isNull() | F.col("embedding_hash").isNull() | (F.col("embedding_hash") != F.col("expected_hash"))
    return rows.filter(old | (F.size("embedding") != dimensions) if dimensions else old)


def embed_distinct(rows: DataFrame, text: str, embed) -> DataFrame:
    """Adds embeddings, each distinct text embedded once. embed: Column -> Column."""
    once = rows.select(text).distinct().withColumn("embedding", embed(F.col(text)))
    return rows.join(once, text, "left")


def upgraded_edges(edges: DataFrame) -> DataFrame:
    """Old temporal edges (type, confidence) in the present form (temporal_type, weight, source)."""
    kind = F.coalesce(*[F.col(c) for c in ("temporal_type", "type") if c in edges.columns])
    weight = F.coalesce(*[F.col(c) for c in ("weight", "confidence") if c in edges.columns], F.lit(0.5))
    source = F.coalesce(F.col("source"), F.lit("legacy")) if "source" in edges.columns else F.lit("legacy")
    return edges.select("from_id", "to_id", F.when(F.contains(kind, F.lit(":")), kind).otherwise(F.concat(F.lit("R:temporal."), F.lower(kind))).alias("temporal_type"), weight.alias("weight"), source.alias("source"))


def noun_phrases(question: Column, matched: Column, tagger=None) -> Column:
    """Phrases of a question that are neither stop phrases nor matched already; without a tagger, runs of capitalised words."""
    found = tagger(question) if tagger else F.regexp_extract_all(question, F.lit(r"([A-Z][\w'-]*(?: [A-Z][\w'-]*)*)"), F.lit(1))
    known = F.transform(matched, F.lower)
    return F.filter(F.array_distinct(found), lambda x: ~F.lower(x).isin(*STOP_PHRASES) & ~F.array_contains(known, F.lower(x)))


def candidate_scope(events: DataFrame, chapter_id=None, book_id=None, universe=None) -> DataFrame:
    """Events of the narrowest scope that is given; one is needed."""
    for column, value in (("chapter_id", chapter_id), ("book_id", book_id), ("universe", universe)):
        if value is not None:
            return events.filter(F.col(column) == value)
    raise ValueError("a chapter, a book or a universe is needed")


def linked_either_way(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) between which an edge runs in either direction."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).distinct()
    return pairs.join(both, ["a", "b"], "left_semi")


def linked_counts(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): how many edges run from a to b, for each of the pairs."""
    n = edges.groupBy(F.col("from_id").alias("a"), F.col("to_id").alias("b")).agg(F.count("*").alias("n"))
    return pairs.select("a", "b").distinct().join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def records_of(records: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """(record_id, key, there): does each record belong to each owner it is asked for? records: record_id and the owner's key."""
    have = records.select("record_id", key).distinct().withColumn("there", F.lit(True))
    return owners.select("record_id", key).distinct().join(have, ["record_id", key], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def repeated_claims(claims: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("scene_id", "subject", "definition_key", "object")) -> DataFrame:
    """Claims that are there already with the same content."""
    return claims.join(known.select(*keys).distinct(), list(keys), "left_semi")


def rerun_scope(chapters: DataFrame, chapter_id=None, book_id=None, universe=None) -> DataFrame:
    """Chapters that a rerun of candidate generation covers: one chapter, the chapters of a book, or those of a universe."""
    return candidate_scope(chapters, chapter_id, book_id, universe).select("chapter_id", "book_id").distinct()
