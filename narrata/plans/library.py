"""The library: universes, series, books, chapters; how they are listed, counted and created."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions.text import book_label


def books(chapters: DataFrame) -> DataFrame:
    """Books in shelf order: universe, series (standalone last), number (none last), title."""
    out = chapters.groupBy("universe", "series", "book_number", "book_id").agg(F.count("*").alias("chapter_count"), F.min("chapter_number").alias("first_chapter"), F.max("chapter_number").alias("last_chapter"))
    out = out.withColumn("label", book_label(F.col("series"), F.col("book_number"), F.col("book_id")))
    return out.orderBy(F.lower("universe"), F.col("series").isNull(), F.lower("series"), F.coalesce("book_number", F.lit(2**31 - 1)), F.lower("book_id"))


def hierarchy(chapters: DataFrame) -> DataFrame:
    """One row for each universe: its books by series and its standalone books, as text."""
    b = books(chapters).groupBy("universe", "series").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%03d", "book_number"))), " ").alias("numbers"), F.count("*").alias("n"))
    return b.groupBy("universe").agg(
        F.sum("n").alias("books"), F.count("series").alias("series"), F.coalesce(F.max(F.when(F.col("series").isNull(), F.col("numbers"))), F.lit("")).alias("standalone"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("series").isNotNull(), F.concat_ws(":", "series", "numbers")))), "; ").alias("shelves"),
    )


def chapters_with_scenes(chapters: DataFrame, scenes: DataFrame) -> DataFrame:
    n = scenes.groupBy("chapter_id").agg(F.count("*").alias("scene_count"))
    return chapters.join(n, "chapter_id", "left").select("book_id", "chapter_number", "chapter_id", F.coalesce("scene_count", F.lit(0)).cast("long").alias("scene_count"))


def submit(chapters: DataFrame, known: DataFrame) -> DataFrame:
    """New chapters by content hash: of equal texts the smallest id, none whose hash is known."""
    one = chapters.withColumn("content_hash", F.sha2("text", 256)).groupBy("content_hash").agg(F.min("chapter_id").alias("chapter_id"))
    return one.join(known.select("content_hash"), "content_hash", "left_anti")


def create(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Names to create: trimmed, not blank, not there yet in any case; the smallest spelling of equals."""
    clean = names.select(F.trim("name").alias("name")).filter("name <> ''").groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    return clean.join(existing.select(F.lower("name").alias("low")), "low", "left_anti").select("name")


def up_to(chapters: DataFrame, book_id: str, number: int) -> DataFrame:
    return chapters.filter((F.col("book_id") == book_id) & (F.col("chapter_number") <= number)).orderBy("chapter_number")


def submitted(chapters: DataFrame, known: DataFrame, jobs: DataFrame) -> DataFrame:
    """(submission, chapter_id, state, job_id) of submitted chapters (submission, text).

    A text whose hash is known (content_hash, chapter_id) is that chapter: EXISTING, or ACTIVE with the
    smallest id of its unfinished jobs (chapter_id, job_id, status).  Others are CREATED once for equal texts, by their smallest submission.
    """
    rows = chapters.withColumn("content_hash", F.sha2("text", 256)).drop("text")
    old = known.groupBy("content_hash").agg(F.min("chapter_id").alias("known_id"))
    active = jobs.filter(~F.col("status").isin("COMPLETE", "FAILED")).groupBy(F.col("chapter_id").alias("known_id")).agg(F.min("job_id").alias("job_id"))
    first = rows.groupBy("content_hash").agg(F.min("submission").alias("first"))
    out = rows.join(old, "content_hash", "left").join(active, "known_id", "left").join(first, "content_hash")
    state = F.when(F.col("job_id").isNotNull(), "ACTIVE").when(F.col("known_id").isNotNull(), "EXISTING").when(F.col("submission") == F.col("first"), "CREATED").otherwise("REPEATED")
    return out.select("submission", F.coalesce("known_id", "first").alias("chapter_id"), state.alias("state"), "job_id")


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows by key columns: an id, a content hash, a title within a parent. A null key means no value (a standalone book)."""
    for column, value in keys.items():
        df = df.filter(F.col(column).eqNullSafe(F.lit(value)))
    return df


def checked_name(name: str | None, what: str) -> str:
    if name is None or not name.strip():
        raise ValueError(f"{what} cannot be null or blank")
    return name.strip()


def create_books(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(universe, series, title, book_number, is_new) of wanted books: those that are there already (title within universe and series, any case) are returned as they are.

    Books without a universe or a title are refused, with the state in `problem`.
    """
    t = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = F.struct(t(F.col("universe")).alias("u"), t(F.col("series")).alias("s"), t(F.col("title")).alias("t"))
    here = existing.withColumn("key", key).groupBy("key").agg(F.min(F.struct("title", "book_number")).alias("old"))
    rows = wanted.withColumn("key", key).groupBy("key").agg(F.min(F.struct(F.trim("title").alias("title"), "book_number", "universe", "series")).alias("new"))
    problem = F.when(F.col("key.u") == "", "UNIVERSE").when(F.col("key.t") == "", "TITLE")
    rows = rows.join(here, "key", "left")
    return rows.select("new.universe", "new.series", F.coalesce("old.title", "new.title").alias("title"), F.coalesce("old.book_number", "new.book_number").alias("book_number"), (F.col("old").isNull() & problem.isNull()).alias("is_new"), problem.alias("problem"))


def in_scope(events: DataFrame, **scope) -> DataFrame:
    """Events of a chapter or a book (chapter_id=..., book_id=...; a list for several), ordered by chapter and id."""
    for column, value in scope.items():
        events = events.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return events.orderBy("chapter_id", "event_id")
