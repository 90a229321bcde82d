"""Chapter files: admission, decoding, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions.text import strip_controls

#: Admitted extensions and the greatest size in bytes.
EXTENSIONS, MOST_BYTES, LEAST_CHARS, PREVIEW = (".txt", ".md"), 1 << 20, 10, 100


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Admitted files: file name, text (UTF-8, line feeds, trimmed) and preview.

    The size test runs on the listing, before contents are read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter((F.col("length") <= MOST_BYTES) & (F.col("length") > 0))
    name = F.element_at(F.split("path", "/"), -1)
    text = strip_controls(F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n"))
    good = F.lower(name).rlike(r"\.(" + "|".join(e[1:] for e in EXTENSIONS) + ")$")
    return rows.filter(good).select(name.alias("file_name"), text.alias("text")).filter(F.length("text") >= LEAST_CHARS).withColumn("preview", F.substring("text", 1, PREVIEW))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """Files that are not admitted, and why (the reader itself passes over empty files)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    why = F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > MOST_BYTES, "TOO_LARGE").when(~F.lower(name).rlike(r"\.(txt|md)$"), "EXTENSION")
    return rows.select(name.alias("file_name"), why.alias("reason")).filter("reason is not null")


def write_scope(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions (chapters, books) that `df` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_catalog(spark: SparkSession, path: str | None = None, **jdbc) -> DataFrame:
    """The definition catalog from Parquet, or from a database with JDBC options."""
    return spark.read.parquet(path) if path else spark.read.format("jdbc").options(**jdbc).load()


def write_catalog(catalog: DataFrame, path: str | None = None, **jdbc) -> None:
    """The whole catalog to Parquet, or appended to a database with JDBC options."""
    if path:
        catalog.write.mode("overwrite").parquet(path)
    else:
        catalog.write.format("jdbc").mode("append").options(**jdbc).save()
