"""The knowledge-base tables, derived from the plain tables of a folder.

The same derivation is written twice: as DataFrames, and as SQL (`PRELUDE`) for checking.
A chapter is a document: its universe is the language, its series the source (`src0`:
standalone), its book `doc_id % 3 + 1`, its number the rank within the book.  A scene is a
non-blank line; individuals are capitalised words of a scene, locations those that open it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters with their number; the snippet is cut before the window, so that whole texts pass it only for those who read them."""
    book = Window.partitionBy("universe", "series", "book_number").orderBy("chapter_id")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chapter_id"), F.col("lang").alias("universe"), F.when(F.col("source") != "src0", F.col("source")).alias("series"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("book_number"), "text", F.substring("text", 1, 400).alias("snippet"),
    ).withColumn("chapter_number", F.row_number().over(book)).withColumn(
        "book_id", F.concat_ws("/", "universe", F.coalesce("series", F.lit("-")), F.col("book_number").cast("string"))
    )


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").select(F.col("doc_id").alias("chapter_id"), F.posexplode(F.split("text", "\n")).alias("scene_index", "text"))
    return lines.filter(F.trim("text") != "").withColumn("scene_id", F.concat_ws(":", "chapter_id", "scene_index"))


def individuals(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each mention: scene, position, name and normalised name."""
    found = scenes(spark, folder).select("chapter_id", "scene_id", "scene_index", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))).alias("extraction_index", "display_name"))
    return found.withColumn("normalized_name", F.lower("display_name"))


def locations(spark: SparkSession, folder: str) -> DataFrame:
    found = scenes(spark, folder).select("chapter_id", "scene_id", "scene_index", F.regexp_extract("text", "^([A-Z][a-z]+)", 1).alias("display_name"))
    return found.filter("display_name <> ''").withColumn("normalized_name", F.lower("display_name"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded chunks with their chapter's coordinates where there is a chapter."""
    c = chapters(spark, folder).select("chapter_id", "universe", "series", "book_number", "chapter_number", "book_id", "snippet")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return e.join(c, e.chunk_id == c.chapter_id, "left")


def stages(spark: SparkSession, folder: str) -> DataFrame:
    """Stage rows of jobs: an order is a job, its lines are stages in order of their number."""
    status = F.when(F.col("l_returnflag") == "R", "FAILED").when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), "COMPLETED").when(F.col("l_linestatus") == "F", "SKIPPED").when(F.col("l_quantity") < 25, "RUNNING").otherwise("TRIGGERED")
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("step")).agg(
        F.max(F.struct(F.col("l_shipdate").alias("triggered_at"), status.alias("status"), F.col("l_quantity").alias("attempts"), F.col("l_partkey"))).alias("s")
    ).select("job_id", "step", "s.triggered_at", "s.status", (F.col("s.attempts").cast("int") % 5).alias("attempts"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("chapter_id"))


#: The same tables for the checking engine, as common table expressions.
PRELUDE = r"""
WITH RECURSIVE chapters AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY universe, series, book_number ORDER BY chapter_id) AS INT) AS chapter_number,
         universe || '/' || coalesce(series, '-') || '/' || book_number AS book_id
  FROM (SELECT doc_id AS chapter_id, lang AS universe, CASE WHEN source <> 'src0' THEN source END AS series,
               CAST(doc_id % 3 + 1 AS INT) AS book_number, text FROM documents)),
lines AS (SELECT doc_id AS chapter_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS scene_index FROM documents),
scenes AS (SELECT chapter_id, CAST(scene_index AS INT) AS scene_index, text, chapter_id || ':' || scene_index AS scene_id FROM lines WHERE trim(text) <> ''),
found AS (SELECT *, regexp_extract_all(text, '[A-Z][a-z]+') AS names FROM scenes),
individuals AS (SELECT chapter_id, scene_id, scene_index, unnest(names) AS display_name, CAST(unnest(generate_series(0, len(names) - 1)) AS INT) AS extraction_index, lower(unnest(names)) AS normalized_name FROM found WHERE len(names) > 0),
locations AS (SELECT chapter_id, scene_id, scene_index, regexp_extract(text, '^([A-Z][a-z]+)', 1) AS display_name, lower(regexp_extract(text, '^([A-Z][a-z]+)', 1)) AS normalized_name FROM scenes WHERE regexp_extract(text, '^([A-Z][a-z]+)', 1) <> ''),
chunks AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding, label, c.chapter_id, universe, series, book_number, chapter_number, book_id, substring(text, 1, 400) AS snippet
           FROM embeddings LEFT JOIN chapters c ON vec_id = c.chapter_id),
stages AS (SELECT job_id, step, s.t AS triggered_at, s.u AS status, CAST(s.v AS INT) % 5 AS attempts FROM (
  SELECT l_orderkey AS job_id, l_linenumber AS step, max({'t': l_shipdate, 'u': CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'COMPLETED'
         WHEN l_linestatus = 'F' THEN 'SKIPPED' WHEN l_quantity < 25 THEN 'RUNNING' ELSE 'TRIGGERED' END, 'v': l_quantity, 'w': l_partkey}) AS s FROM lineitem GROUP BY 1, 2)),
jobs AS (SELECT o_orderkey AS job_id, o_orderdate AS created_at, o_custkey AS chapter_id FROM orders)
"""
