"""Question answering: templates over the entity graph, routing, hybrid retrieval, contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.functions.text import intent, location_tag, mentions_name, normalize_name, snippet, subject
from narrata.operators.filters import Filters, SeriesProgress, Visibility, apply_filters, visible
from narrata.operators.graph import cut
from narrata.operators.search import fuse, ranked, rerank, semantic_search

BRANCH = 20


def _named(mentions: DataFrame, name: str) -> DataFrame:
    """Mentions of an entity; names are normalised on both sides."""
    return mentions.filter(normalize_name(F.col("display_name")) == normalize_name(F.lit(name)))


def entity_lookup(mentions: DataFrame, chapters: DataFrame, name: str, visibility: Visibility | None = None) -> DataFrame:
    """One row for each book that has the entity: mentions, chapters and scenes that a reader may see."""
    seen = chapters.filter(visible(visibility)).select("chapter_id", "book_id", "chapter_number")
    return _named(mentions, name).join(seen, "chapter_id").groupBy("book_id").agg(
        F.min("display_name").alias("display_name"), F.count("*").alias("mention_count"), F.count_distinct("chapter_id").alias("chapter_count"), F.count_distinct("scene_id").alias("scene_count")
    )


def entity_scenes(mentions: DataFrame, chapters: DataFrame, name: str, visibility: Visibility | None = None, limit: int = 20) -> DataFrame:
    """Scenes in which the entity is mentioned, in reading order."""
    seen = chapters.filter(visible(visibility)).select("chapter_id", "book_id", "chapter_number")
    rows = _named(mentions, name).select("chapter_id", "scene_id", "scene_index").distinct().join(seen, "chapter_id")
    return rows.orderBy("book_id", "chapter_number", "scene_index").limit(limit)


def co_occurrence(mentions: DataFrame, first: str, second: str) -> DataFrame:
    """Scenes that mention both entities."""
    a, b = (_named(mentions, n).select("chapter_id", "scene_id", "scene_index").distinct() for n in (first, second))
    return a.join(b.select("scene_id"), "scene_id", "left_semi").orderBy("chapter_id", "scene_index")


def first_appearance(mentions: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first scene of each entity within each book."""
    rows = mentions.join(chapters.select("chapter_id", "book_id", "chapter_number"), "chapter_id")
    at = F.struct("chapter_number", "scene_index", "scene_id")
    return rows.groupBy("book_id", "normalized_name").agg(F.min(at).alias("r")).select("book_id", "normalized_name", "r.chapter_number", "r.scene_index", "r.scene_id")


def scene_context(chunks: DataFrame, individuals: DataFrame, locations: DataFrame) -> DataFrame:
    """Chunks with the sorted distinct names of their chapter's scenes; names are gathered before the joins."""
    gather = lambda df, name: df.groupBy("chapter_id").agg(F.array_sort(F.collect_set("display_name")).alias(name))
    return chunks.join(gather(individuals, "individuals"), "chapter_id", "left").join(gather(locations, "locations"), "chapter_id", "left")


def hybrid(chunks: DataFrame, mentions: DataFrame, query: list[float], name: str, k: int, visibility: Visibility | None = None) -> DataFrame:
    """Vector and graph branches fused by reciprocal rank; both run in one job."""
    size = max(BRANCH, k)
    vector = ranked(semantic_search(chunks, query, size, visibility=visibility), size)
    places = _named(mentions, name).select("chapter_id").distinct()
    graph = chunks.filter(visible(visibility)).join(places, "chapter_id", "left_semi").select("chunk_id", F.lit(1.0).alias("score"))
    return fuse({"vector": vector, "graph": ranked(graph, size)}, k)


def citations(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with coordinates and snippets, in one join."""
    tag = location_tag(F.col("universe"), F.col("series"), F.col("book_number"), F.col("chapter_number"), F.lit(None).cast("string"))
    have = chunks.select("chunk_id", "chapter_id", tag.alias("location"), snippet(F.col("snippet"), 120).alias("quote"))
    return results.join(have, "chunk_id", "left")


def merge_candidates(left: DataFrame, right: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """Candidates of two branches by chunk: the first non-null scalar, the ordered union of lists."""
    r = right.select("chunk_id", *[F.col(c).alias(f"r_{c}") for c in (*scalars, *lists)])
    empty = F.array().cast("array<string>")
    return left.join(r, "chunk_id", "full").select(
        "chunk_id", *[F.coalesce(c, f"r_{c}").alias(c) for c in scalars], *[F.array_union(F.coalesce(F.col(c), empty), F.coalesce(F.col(f"r_{c}"), empty)).alias(c) for c in lists]
    )


def members_of(book_names: DataFrame, name: str) -> DataFrame:
    """Mentions of the book entities that carry a name: book entity <- chapter entity <- mention.

    book_names: book_id, book_entity, normalized_name, display_name, and for each member mention chapter_id, scene_id, scene_index.
    """
    return book_names.filter(F.col("normalized_name") == normalize_name(F.lit(name)))


def entity_chain(mentions: DataFrame, chapter_links: DataFrame, book_links: DataFrame, books: DataFrame) -> DataFrame:
    """Every mention (id, chapter_id, scene_id, scene_index, keys) with its book entity.

    chapter_links: chapter_id, keys, chapter_entity; book_links: book_id, id (of a chapter entity), book_entity;
    books: book_id, cluster, display_name, normalized_name.  Entities are joined first, so mentions, by far the most
    rows, meet them once.
    """
    named = books.select("book_id", F.col("cluster").alias("book_entity"), "display_name", "normalized_name", "first_seen_chapter_id")
    entities = chapter_links.join(book_links.withColumnRenamed("id", "chapter_entity"), "chapter_entity").join(named, ["book_id", "book_entity"])
    return mentions.select("chapter_id", "id", "scene_id", "scene_index", "keys").join(entities, ["chapter_id", "keys"]).drop("keys")


def chain_of(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """The chain of the mentions that some sets of keys (`consolidate.named_members`) take in; mentions of other keys go before anything is joined by chapter."""
    some = mentions.select("chapter_id", "id", "scene_id", "scene_index", "keys").join(cut(members.select("keys").distinct()), "keys", "left_semi")
    return some.join(members, ["chapter_id", "keys"]).drop("keys")


def chain_lookup(chain: DataFrame, chapters: DataFrame, name: str, visibility: Visibility | None = None) -> DataFrame:
    """One row for each book entity of that name: chapters, scenes and mentions that a reader may see, and where it is seen first."""
    seen = chapters.filter(visible(visibility)).select("chapter_id")
    return members_of(chain, name).join(seen, "chapter_id", "left_semi").groupBy("book_id", "book_entity", "display_name", "first_seen_chapter_id").agg(
        F.count("*").alias("mention_count"), F.count_distinct("chapter_id").alias("chapter_count"), F.count_distinct("scene_id").alias("scene_count")
    )


def chain_scenes(chain: DataFrame, chapters: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Scenes that any mention of the book entity stands in, in reading order."""
    rows = members_of(chain, name).select("book_id", "book_entity", "chapter_id", "scene_id", "scene_index").distinct()
    rows = rows.join(chapters.select("chapter_id", "chapter_number"), "chapter_id")
    return rows.orderBy("book_id", "chapter_number", "scene_index", "book_entity").limit(limit)


def chain_co_occurrence(chain: DataFrame, first: str, second: str) -> DataFrame:
    """Scenes that mention both book entities, by any of their names."""
    a, b = (members_of(chain, n).select("chapter_id", "scene_id", "scene_index").distinct() for n in (first, second))
    return a.join(b.select("scene_id"), "scene_id", "left_semi")


def chain_first(chain: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first scene of every book entity."""
    rows = chain.join(chapters.select("chapter_id", "chapter_number"), "chapter_id")
    at = F.struct("chapter_number", "scene_index", "scene_id")
    return rows.groupBy("book_id", "book_entity").agg(F.min(at).alias("r")).select("book_id", "book_entity", "r.chapter_number", "r.scene_index", "r.scene_id")


def visibility_of(books: DataFrame, series: DataFrame, universes: DataFrame, *, universe_id=None, universe=None, series_id=None, series_name=None, book_id=None, book_number=None, chapter=None, policy: str = "HIDE") -> Visibility | None:
    """A reader's progress from ids; names and numbers stand in where an id is not given or not known. None without a universe or a book number."""

    def found(df: DataFrame, column: str, value, more=None):
        rows = df.filter((F.col("id") == value) & (more if more is not None else F.lit(True))).select(column).limit(1).collect() if value is not None else []
        return rows[0][0] if rows else None

    clean = lambda x: (x or "").strip() or None
    universe = found(universes, "name", universe_id) or clean(universe)
    series_name = found(series, "name", series_id, F.col("universe_id") == universe_id if universe_id is not None else None) or clean(series_name)
    number = book_number if book_number is not None else found(books, "book_number", book_id)
    if universe is None or number is None:
        return None
    digits = str(chapter).strip() if chapter is not None else ""
    return Visibility(universe, (SeriesProgress(series_name, int(number), int(digits) if digits.isdigit() else None),), policy)


def evidence_context(results: DataFrame) -> DataFrame:
    """(rank, line) of results (rank, quote, book_number, chapter_number, individuals, locations): `[1] text (Book 2, Chapter 5 — featuring: A, B — at: C)`."""
    place = F.when(F.col("book_number").isNotNull() & F.col("chapter_number").isNotNull(), F.concat(F.lit("Book "), "book_number", F.lit(", Chapter "), "chapter_number"))
    listed = lambda c, word: F.when(F.size(c) > 0, F.concat(F.lit(word), F.array_join(c, ", ")))
    tag = F.concat_ws(" — ", place, listed("individuals", "featuring: "), listed("locations", "at: "))
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("quote", F.lit("")), F.when(tag != "", F.concat(F.lit(" ("), tag, F.lit(")"))).otherwise(""))
    return results.select("rank", line.alias("line"))


@dataclass
class Answer:
    status: str
    route: str
    text: str
    evidence: list


class Asker:
    """Routes a question: lookups to the graph, others (and lookups that find nothing) to the narrative.

    The narrative is searched by vector, with a threshold, and names that the question holds move
    results up.  With `hybrid`, the scenes of the question's subject are a second branch; ranks are
    fused and no threshold applies.  A branch that fails leaves the other (DEGRADED), and is an answer
    of its own only if nothing is found.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, chapters: DataFrame, individuals: DataFrame, locations: DataFrame, embed, generate, hybrid: bool = False):
        self.spark, self.chunks, self.chapters, self.individuals, self.locations, self.embed, self.generate, self.hybrid = spark, chunks, chapters, individuals, locations, embed, generate, hybrid

    def ask(self, question: str, k: int = 5, threshold: float = 0.0, visibility: Visibility | None = None, filters: Filters = Filters()) -> Answer:
        row = self.spark.range(1).select(intent(F.lit(question)).alias("intent"), subject(F.lit(question)).alias("subject")).first()
        if row["intent"] == "ENTITY_LOOKUP" and row["subject"]:
            for mentions in (self.individuals, self.locations):
                found = entity_lookup(mentions, self.chapters, row["subject"], visibility).orderBy("book_id").limit(BRANCH).collect()
                if found:
                    return Answer("OK", "ENTITY_LOOKUP", self.generate(question, "\n".join(f"{r.display_name}: {r.mention_count} mentions in {r.book_id}" for r in found)), found)
        size = max(BRANCH, k) if self.hybrid else k
        branches, failed = {}, []
        runs = {"vector": lambda: self._vector(question, size, threshold if not self.hybrid else 0.0, visibility, filters)}
        if self.hybrid:
            runs["graph"] = lambda: self._graph(row["subject"] or question, size, visibility, filters)
        for name, run in runs.items():
            try:
                branches[name] = self.spark.createDataFrame(run(), "chunk_id long, rank int, score double")  # at most `size` rows
            except Exception as e:  # a branch that fails is left out
                failed.append(str(e)[:200])
        found = self._evidence(branches, question, k) if branches else []
        if not found:
            return Answer("SEARCH_FAILED" if failed else "NO_EVIDENCE", "NARRATIVE_QA", failed[0] if failed else "", [])
        return Answer("DEGRADED" if failed else "OK", "NARRATIVE_QA", self.generate(question, "\n".join(r.line for r in found)), found)

    def _vector(self, question: str, size: int, threshold: float, visibility: Visibility | None, filters: Filters) -> list:
        rows = semantic_search(self.chunks, self.embed(question), size, filters, visibility).filter(F.col("score") >= threshold)
        return [(r.chunk_id, r["rank"], r.score) for r in ranked(rows, size).select("chunk_id", "rank", "score").collect()]

    def _graph(self, name: str, size: int, visibility: Visibility | None, filters: Filters) -> list:
        places = _named(self.individuals, name).select("chapter_id").distinct()
        rows = apply_filters(self.chunks, filters.resolved()).filter(visible(visibility)).join(places, "chapter_id", "left_semi").select("chunk_id", F.lit(1.0).alias("score"))
        return [(r.chunk_id, r["rank"], r.score) for r in ranked(rows, size).collect()]

    def _evidence(self, branches: dict, question: str, k: int) -> list:
        """The best k chunks; without a graph branch, names that the question holds move chunks up."""
        if self.hybrid:
            best = fuse(branches, k).withColumn("score", F.col("fused"))
        else:
            best = branches["vector"]
        order = Window.orderBy(F.desc("score"), "chunk_id")  # at most `size` rows
        best = best.withColumn("rank", F.row_number().over(order)).select("chunk_id", "score", "rank")
        have = scene_context(self.chunks.join(best, "chunk_id"), self.individuals.join(self.chunks.join(best, "chunk_id").select("chapter_id"), "chapter_id", "left_semi"), self.locations)
        none = F.array().cast("array<string>")
        rows = have.withColumn("quote", snippet(F.col("snippet"), 120)).withColumns({c: F.coalesce(c, none) for c in ("individuals", "locations")})
        if not self.hybrid:
            asked = F.filter("individuals", lambda x: mentions_name(F.lit(question), x))
            rows = rerank(rows, asked, F.col("individuals")).withColumn("score", F.col("boosted"))
            rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("boosted"), "rank")))
        tag = location_tag(F.col("universe"), F.col("series"), F.col("book_number"), F.col("chapter_number"), F.lit(None).cast("string"))
        lines = evidence_context(rows)
        return rows.select("chunk_id", "rank", "score", "quote", tag.alias("location")).join(lines, "rank").orderBy("rank").limit(k).collect()
