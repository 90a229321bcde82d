import math

import pytest
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions import vector as V


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("f, value, expected", [
    (T.normalize_name, "  The   One Ring! ", "one ring"), (T.normalize_name, "\t ", None), (T.normalize_name, None, None), (T.normalize_name, "Théo", "tho"), (T.normalize_name, "!!", None),
    (T.slug, "Harbour: The Last  Ferry", "harbour_the_last_ferry"), (T.slug, None, ""), (T.slug, " - ", ""),
    (T.definition_key, "Is Friend-Of!", "R:is_friend_of"), (T.definition_key, "!!", "R:unparseable"), (T.definition_key, None, None),
    (T.certainty, "EXPLICITLY stated", "Explicit"), (T.certainty, "strongly implied", "StronglyImplied"), (T.certainty, "implied", "WeaklyImplied"), (T.certainty, None, "WeaklyImplied"),
    (T.certainty_weight, "Explicit", 0.95), (T.certainty_weight, "StronglyImplied", 0.8), (T.certainty_weight, "WeaklyImplied", 0.6), (T.certainty_weight, None, 0.5), (T.certainty_weight, "x", 0.5),
    (T.intent, "Who is Ana?", "ENTITY_LOOKUP"), (T.intent, "  tell me  about x", "ENTITY_LOOKUP"), (T.intent, "whose island", "NARRATIVE_QA"), (T.intent, "why?", "NARRATIVE_QA"), (T.intent, None, "AMBIGUOUS"), (T.intent, " \n", "AMBIGUOUS"),
    (T.subject, "Who is Ana?", "Ana"), (T.subject, "describe Northport!?", "Northport"), (T.subject, "where was it...", "it"), (T.subject, "?", None),
    (T.tokens, "", 0), (T.tokens, "a", 2), (T.tokens, "abcdefghij", 4), (T.tokens, None, 0),
    (T.escape_xml, "<a & 'b'>", "&lt;a &amp; &apos;b&apos;&gt;"), (T.sanitize_error, "a\x00b\nc", "abc"), (T.sanitize_error, "x" * 300, "x" * 200 + "..."), (T.sanitize_error, None, "null"),
    (T.url_segment, "BOOK_EVENT", "book-event"), (T.chunk_text, " a\r\n\r\n\r\n\r\nb \t c \n d\r", "a\n\nb c\nd"),
])
def test_scalars(spark, f, value, expected):
    assert one(spark, f, value) == expected


@pytest.mark.parametrize("value, expected", [(0.5, 0.5), (-1.0, 0.0), (3.0, 1.0), (math.nan, 0.0), (math.inf, 0.0), (None, 0.0)])
def test_confidence(spark, value, expected):
    assert one(spark, T.confidence, value, "double") == expected


def test_snippet(spark):
    assert one(spark, lambda c: T.snippet(c, 50), "short") == "short"
    assert one(spark, lambda c: T.snippet(c, 50), "word " * 30) == ("word " * 10)[:44].rstrip() + "..."
    assert one(spark, lambda c: T.snippet(c, 50), "x" * 80) == "x" * 47 + "..."
    assert one(spark, lambda c: T.truncate(c, 5), "😀" * 9) == "😀" * 4 + "…"


def test_names(spark):
    df = spark.createDataFrame([("The Ana", ["ana", " Lady Ana ", None, "!"]), (None, None)], "n string, a array<string>")
    assert [r[0] for r in df.select(T.name_keys(F.col("n"), F.col("a"))).collect()] == [["ana", "lady ana"], []]
    assert df.select(T.union_names(F.array(F.lit("Ana"), F.lit("Kai")), F.array(F.lit("ANA"), F.lit("Otto")))).first()[0] == ["Ana", "Kai", "Otto"]
    assert [r[0] for r in df.select(T.mentions_name(F.lit("Then ANA's knife"), F.lit("ana"))).collect()] == [True, True]
    assert not df.select(T.mentions_name(F.lit("Banana"), F.lit("ana"))).first()[0]
    assert df.select(T.clean_aliases(F.col("a"))).first()[0] == ["ana", "Lady Ana", "!"]


def test_labels(spark):
    df = spark.createDataFrame([("U", "S", 2, 7, "T"), ("U", None, None, 7, "T")], "u string, s string, b int, c int, t string")
    assert [r[0] for r in df.select(T.book_label(F.col("s"), F.col("b"), F.col("t"))).collect()] == ["S #2 T", "T"]
    assert df.select(T.publication_id(F.lit("My World"), F.col("s"), F.col("b"), F.col("c"))).first()[0] == "my_world/s/002/00007"
    assert df.select(T.location_tag(F.col("u"), F.col("s"), F.col("b"), F.col("c"), F.lit(None).cast("int"))).first()[0] == "[U / S / Book 2 / Chapter 7]"
    assert df.select(T.embedding_text(F.lit("d"), F.lit(" "), F.lit("k"))).first()[0] == "d: k"
    assert df.select(T.body(F.lit("abcdef"), 3)).first()[0][::2] == ("abc", True)


def test_similarity(spark):
    q = V.literal([1, 0, 0])
    for v, expected in (([1.0, 0, 0], 1.0), ([0.0, 1, 0], 0.5), ([-1.0, 0, 0], 0.0), ([0.0, 0, 0], None), ([1.0, 0], None)):
        assert spark.createDataFrame([([float(x) for x in v],)], "v array<double>").select(V.similarity(F.col("v"), q)).first()[0] == expected
