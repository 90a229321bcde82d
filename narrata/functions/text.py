"""Scalar text functions as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading words that a normalised name loses.
ARTICLES = ("the", "a", "an")
#: Certainty levels and their weights; anything else weighs 0.5.
CERTAINTY_WEIGHTS = {"Explicit": 0.95, "StronglyImplied": 0.8, "WeaklyImplied": 0.6, "Heuristic": 0.5}
#: How questions that ask for an entity begin.
LOOKUP = r"^(?:who|what|where)\s+(?:is|was)\b|^describe\b|^tell\s+me\s+about\b"
LOOKUP_PREFIX = r"(?i)^(?:tell me about |describe |(?:who|what|where) (?:is|was) )"


def strip_controls(c: Column) -> Column:
    """Trims every character up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_controls(c), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Trim, collapse white space, lower, keep [a-z0-9 ], drop one leading article; blank becomes null.

    Most names are one plain word, for which lower case is all there is to do.
    """
    plain = c.rlike(r"^[A-Za-z0-9]+\z")
    s = F.lower(F.regexp_replace(strip_controls(c), r"[ \t\n\x0B\f\r]+", " "))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]", ""), f"^({'|'.join(ARTICLES)}) ", "")
    return F.when(plain, F.lower(c)).when(F.trim(s) != "", s)


def slug(c: Column) -> Column:
    """Lower snake case: other characters than [a-z0-9] and white space go, white space becomes underscores; null is empty."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9 \t\n\x0B\f\r]", "")
    return F.regexp_replace(strip_controls(s), r"[ \t\n\x0B\f\r]+", "_")


def publication_id(universe: Column, series: Column, book: Column, chapter: Column) -> Column:
    return F.concat(slug(universe), F.lit("/"), slug(series), F.lit("/"), F.lpad(book.cast("string"), 3, "0"), F.lit("/"), F.lpad(chapter.cast("string"), 5, "0"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def sanitize_error(c: Column, limit: int = 200) -> Column:
    """Without control characters, cut at `limit` with an ellipsis of dots; null is the text null."""
    s = F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")
    return F.coalesce(F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s), F.lit("null"))


def snippet(c: Column, limit: int = 800) -> Column:
    """At most about `limit` characters: cut at the last blank up to limit - 3, if in the second half, else there; then dots."""
    limit = max(50, limit)
    head = F.substring(c, 1, limit - 2)
    back = F.instr(F.reverse(head), " ")
    at = F.lit(limit - 2) - back
    cut = F.when((back > 0) & (at >= limit // 2), at).otherwise(limit - 3)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, F.lit(1), cut), F.lit("...")))


def chunk_text(c: Column) -> Column:
    """Normalisation before chunking, in this order: ends, line ends, runs of empty lines, blanks and tabs, blanks around line feeds."""
    s = F.regexp_replace(F.regexp_replace(strip_controls(c), "\r\n", "\n"), "\r", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(s, "\n ", "\n"), " \n", "\n")


def definition_key(c: Column) -> Column:
    s = F.regexp_replace(strip_controls(F.regexp_replace(F.lower(c), r"[^a-z0-9 \t\n\x0B\f\r]", " ")), r"[ \t\n\x0B\f\r]+", "_")
    return F.when(s == "", F.lit("R:unparseable")).otherwise(F.concat(F.lit("R:"), s))


def certainty(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(F.contains(s, F.lit("explicit")), "Explicit")
        .when(F.contains(s, F.lit("strongly")) & F.contains(s, F.lit("impl")), "StronglyImplied").otherwise("WeaklyImplied")
    )


def certainty_weight(c: Column) -> Column:
    out = F.lit(0.5)
    for name, weight in CERTAINTY_WEIGHTS.items():
        out = F.when(c == name, F.lit(weight)).otherwise(out)
    return out


def truncate(c: Column, limit: int) -> Column:
    """At most `limit` code points, the last one an ellipsis if something was cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def clean_aliases(c: Column) -> Column:
    """Trimmed non-blank aliases in order, without repeats."""
    return F.array_distinct(F.filter(F.transform(c, strip_controls), lambda x: x != ""))


def tokens(c: Column) -> Column:
    """max(ceil(characters / 3), ceil(words * 1.35)), at least 1; 0 for a null or blank text."""
    words = F.size(F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))
    most = F.greatest(F.ceil(F.length(c) / 3), F.ceil(words * F.lit(1.35)), F.lit(1)).cast("int")
    return F.when(F.coalesce(strip_controls(c), F.lit("")) == "", 0).otherwise(most)


def segmentation_budget(context_tokens: int, ratio: float = 0.70) -> int:
    return int(context_tokens * ratio)


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_xml(c: Column) -> Column:
    """The five named entities, decoded once."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def confidence(c: Column) -> Column:
    """Into [0, 1]; null, NaN and infinities become 0."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def name_keys(name: Column, aliases: Column) -> Column:
    """Distinct normalised keys, the name's first; never null."""
    keys = F.concat(F.array(normalize_name(name)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), normalize_name))
    return F.array_distinct(F.array_compact(keys))


def intent(c: Column) -> Column:
    """ENTITY_LOOKUP, NARRATIVE_QA, or AMBIGUOUS if null or blank."""
    s = F.lower(strip_controls(F.coalesce(c, F.lit(""))))
    return F.when(s == "", "AMBIGUOUS").when(s.rlike(LOOKUP), "ENTITY_LOOKUP").otherwise("NARRATIVE_QA")


def subject(c: Column) -> Column:
    """What a lookup question asks about: without its opening words and closing punctuation; null if nothing is left."""
    s = strip_controls(F.regexp_replace(strip_controls(c), LOOKUP_PREFIX, ""))
    return F.nullif(strip_controls(F.regexp_replace(s, "[?!.,;:]+$", "")), F.lit(""))


def mentions_name(text: Column, name: Column) -> Column:
    """Does the text hold the name as whole words, in any case?"""
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    return (F.length(F.trim(plain(name))) > 0) & F.contains(plain(text), F.concat(F.lit(" "), F.trim(plain(name)), F.lit(" ")))


def union_names(a: Column, b: Column) -> Column:
    """Union of two name arrays without case-insensitive repeats, first spelling kept, in order."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.filter(both, lambda x, i: F.array_position(F.transform(both, F.lower), F.lower(x)) == i + 1)


def embedding_text(description: Column, raw: Column, key: Column) -> Column:
    return F.concat(F.coalesce(description, F.lit("")), F.lit(": "), F.coalesce(blank_to_null(raw), key))


def embedding_hash(model: str, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(model), content), 256)


def body(c: Column, limit: int) -> Column:
    """Struct of a body cut to `limit`, its hash and whether it was cut."""
    return F.struct(F.substring(c, 1, limit).alias("text"), F.sha2(c, 256).alias("sha256"), (F.length(c) > limit).alias("truncated"))


def book_label(series: Column, number: Column, title: Column) -> Column:
    return F.trim(F.concat(F.when(blank_to_null(series).isNull(), "").otherwise(F.concat(series, F.lit(" "))),
                           F.when(number.isNull(), "").otherwise(F.concat(F.lit("#"), number.cast("string"), F.lit(" "))), F.coalesce(title, F.lit(""))))


def url_segment(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("_"), F.lit("-")))


def location_tag(universe: Column, series: Column, book: Column, chapter: Column, scene: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" / ", universe, series, F.concat(F.lit("Book "), book), F.concat(F.lit("Chapter "), chapter), F.concat(F.lit("Scene "), scene)), F.lit("]"))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*map(blank_to_null, columns))
