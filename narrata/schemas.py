"""Schemas of the knowledge-base tables and edges, their natural keys, and checks of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MENTION = "id string, source string, display_name string, normalized_name string, aliases array<string>, stage_id string, scene_id string, chapter_id string, book_id string, resolution_status string, extraction_index int"
_ENTITY = "id string, chapter_id string, stage_id string, display_name string, normalized_name string, aliases array<string>, mention_count long"
_BOOK_ENTITY = "id string, book_id string, display_name string, normalized_name string, aliases array<string>, chapter_count long, representative_id string, first_seen_chapter_id string"

#: Tables and their columns.
TABLES = {
    "universe": "id string, name string, slug string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "series": "id string, universe_id string, universe_name string, name string",
    "book": "id string, universe_id string, series_id string, universe string, series string, book_number int, title string",
    "chapter": "id string, book_id string, universe string, series string, book_title string, book_number int, chapter_number int, chapter_title string, raw_text string, content_hash string, "
    "coordinates struct<universe:string,series:string,book_title:string,chapter_title:string,book_number:int,chapter_number:int>",
    "scene": "id string, chapter_id string, stage_id string, scene_index int, context_summary string, start_offset long, end_offset long, text string, labels array<string>",
    "chunk": "id string, stage_id string, scene_id string, chapter_id string, chunk_number int, start_char long, end_char long, text string, content_hash string, embedding array<double>, embedding_hash string, embedded_at timestamp_ntz",
    "individual_mention": _MENTION + ", activity string, age string, physical_properties string",
    "location_mention": _MENTION + ", kind string, region string, description string",
    "object_mention": _MENTION + ", type string, material string, purpose string, description string",
    "collective_mention": _MENTION + ", collective_type string, certainty string, evidence string",
    "concept_mention": _MENTION + ", concept_type string, description string, certainty string, evidence string",
    "event_mention": _MENTION + ", event_type string, description string, scene_relative_relation string, certainty string, evidence string",
    **{f"chapter_{x}": _ENTITY + rest for x, rest in (("individual", ""), ("location", ""), ("object", ", type string, material string, purpose string, description string"), ("collective", ", collective_type string, certainty string, evidence string"), ("concept", ", concept_type string, description string, certainty string, evidence string"))},
    **{f"book_{x}": _BOOK_ENTITY for x in ("individual", "location", "object", "collective", "concept")},
    "chapter_event": "id string, chapter_id string, component_id string, display_name string, normalized_name string, event_type string, mention_count long, card string, aliases array<string>, event_types array<string>, evidence array<string>, embedding array<double>, embedding_hash string",
    "book_event": "id string, book_id string, display_name string, normalized_name string, event_type string",
    "relation_claim": "id string, relation_name string, relation_description string, catalog_id string, definition_key string, subject_kind string, subject_name string, object_kind string, object_name string, certainty string, evidence string, scene_id string, chapter_id string, book_id string, extraction_index int",
    "job": "id string, chapter_id string, created_at timestamp_ntz",
    "stage": "id string, job_id string, step string, status string, attempts int, error string, error_retryable boolean, triggered_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz",
    "llm_call": "id string, job_id string, stage_id string, step string, provider string, model string, temperature double, top_p double, max_tokens int, latency_ms long, input_tokens long, output_tokens long, created_at timestamp_ntz",
    "catalog_definition": "id string, definition_key string, display_name string, description string, created_at timestamp, updated_at timestamp, last_seen_at timestamp, embedding array<float>",
    "catalog_variant": "definition_id string, variant string",
    "catalog_signature": "definition_id string, subject_kind string, object_kind string",
    "refers_to": "from_id string, to_id string",
    "same_event": "a string, b string, confidence double, pass_id string, source string, model string",
    "next_in_reading_order": "from_id string, to_id string, source string",
    "temporal": "from_id string, to_id string, temporal_type string, certainty string, weight double, source string, rationale string, evidence string, llm_call_id string",
    "ambiguous_relation": "from_id string, to_id string, payload string, evidence string, job_id string, chapter_id string, stage_id string",
}
#: Natural keys that must be unique.
KEYS = {
    "chapter": ("content_hash",), "scene": ("chapter_id", "scene_index"), "stage": ("job_id", "step"), "catalog_definition": ("definition_key",),
    "catalog_variant": ("definition_id", "variant"), "catalog_signature": ("definition_id", "subject_kind", "object_kind"),
    **{f"chapter_{x}": ("chapter_id", "normalized_name") for x in ("individual", "location", "object", "collective", "concept")},
    **{f"book_{x}": ("book_id", "normalized_name") for x in ("individual", "location", "object", "collective", "concept")},
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """`df` with exactly the columns of a table: cast, missing ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def repeated_keys(df: DataFrame, name: str) -> DataFrame:
    """Natural keys that more than one row has."""
    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("rows")).filter("rows > 1")


def vector_size(df: DataFrame, column: str, expected: int) -> DataFrame:
    """Rows whose vector has another size than expected."""
    return df.filter(F.col(column).isNotNull() & (F.size(column) != expected))
