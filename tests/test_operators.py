import random

import pytest
from pyspark.sql import functions as F

from narrata import models, schemas
from narrata.operators import analysis as A
from narrata.operators import consolidate as C
from narrata.operators import filters as P
from narrata.operators import graph as G
from narrata.operators import search as S
from narrata.operators import segment as X
from narrata.operators import timeline as L
from narrata.plans import library as B
from narrata.plans import retrieval as R

CHUNK = "chunk_id int, embedding array<double>, universe string, series string, book_number int, chapter_number int"


@pytest.fixture
def chunks(spark):
    rows = [(1, [1.0, 0, 0], "U", "S", 1, 4), (2, [0.9, 0.1, 0], "U", "S", 1, 5), (3, [0.5, 0.5, 0], "U", "S", 1, 6), (4, [0.0, 1, 0], "U", "S", 2, 1), (5, [0.0, 0.9, 0.1], "U", None, 0, 8), (6, [0.2, 0.8, 0], None, None, None, None), (7, [-1.0, 0, 0], "U", "S", 1, 1)]
    return spark.createDataFrame([(i, [float(x) for x in v], *rest) for i, v, *rest in rows], CHUNK)


def ids(df):
    return [r.chunk_id for r in df.collect()]


def seen(chunks, progress, policy="HIDE"):
    v = P.Visibility("U", tuple(P.SeriesProgress(*p) for p in progress), policy)
    return sorted(ids(chunks.filter(P.visible(v))))


def test_progress(chunks):
    assert seen(chunks, [("S", 1, 5)]) == [1, 2, 7]
    assert seen(chunks, [("S", 1, None)]) == [1, 2, 3, 7]
    assert seen(chunks, [("S", 2, None)]) == [1, 2, 3, 4, 7]
    assert seen(chunks, [("S", 1, 5)], "SHOW") == [1, 2, 5, 7]
    assert seen(chunks, [(None, 0, 8)]) == [5] and seen(chunks, [(None, 0, 7)]) == []
    assert seen(chunks, [("other", 1, None)], "SHOW") == [1, 2, 3, 4, 5, 7]
    assert seen(chunks, []) == [1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        P.visible(P.Visibility("U", (P.SeriesProgress("S", 1),), "MAYBE"))


def test_search_order_and_modes(chunks):
    q = [1.0, 0.0, 0.0]
    assert ids(S.semantic_search(chunks, q, 10)) == [1, 2, 3, 6, 4, 5]
    late = P.Filters("U", "S", 2)
    assert ids(S.semantic_search(chunks, q, 1, late)) == [] and ids(S.semantic_search(chunks, q, 1, late, mode="prefilter")) == [4]
    assert P.Filters(" ", "S", 2, 3).resolved() == P.Filters() and P.Filters("U", None, 2, 3).resolved() == P.Filters("U")
    with pytest.raises(ValueError):
        P.check_request(0)


def test_stale_vectors(spark):
    df = spark.createDataFrame([(1, None, None), (2, [1.0], "h"), (3, [1.0], "x"), (4, [1.0], None)], "i int, embedding array<double>, embedding_hash string")
    assert [r.i for r in P.unembedded(df).collect()] == [1, 4] and [r.i for r in P.stale(df, F.lit("h")).collect()] == [3]


def test_fusion_counts_repeats(spark):
    v = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "chunk_id int, rank int")
    g = spark.createDataFrame([(3, 1), (4, 2), (4, 3)], "chunk_id int, rank int")
    out = S.fuse({"vector": v, "graph": g}, 10).collect()
    assert [r.chunk_id for r in out] == [3, 4, 1, 2]
    assert [r.branches for r in out] == [2, 2, 1, 1] and out[1].first_rank is None
    assert out[0].fused == pytest.approx(1 / 63 + 1 / 61, abs=1e-8)
    again = S.fuse({"graph": g, "vector": v}, 10).collect()
    assert out == again


def test_rerank_keeps_scores(spark):
    rows = spark.createDataFrame([(1, 0.90, 1, ["Kai"]), (2, 0.88, 2, ["ANA", "ana"]), (3, 0.88, 3, [])], "chunk_id int, score double, rank int, names array<string>")
    out = S.rerank(rows, F.array(F.lit("ana")), F.col("names")).collect()
    assert [r.chunk_id for r in out] == [2, 1, 3] and out[0].score == 0.88 and out[0].boosted == 0.93


def test_greedy_cap(spark):
    pairs = spark.createDataFrame([("b", 1, 2, 0.9), ("b", 1, 3, 0.8), ("b", 2, 3, 0.7), ("b", 3, 4, 0.6), ("c", 1, 2, 0.1)], "book_id string, event_id_1 int, event_id_2 int, score double")
    assert {(r.book_id, r.event_id_1, r.event_id_2) for r in S.cap_pairs(pairs, 1).collect()} == {("b", 1, 2), ("b", 3, 4), ("c", 1, 2)}


def test_clusters_are_transitive_and_order_free(spark):
    rows = [("s", "alice", ["alice"]), ("s", "bob", ["bob"]), ("s", "carol", ["alice", "bob"]), ("s", "dan", ["dan"]), ("s", "eve", []), ("t", "bob", ["bob"])]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = {(r.scope, r.item): r.cluster for r in G.clusters(spark.createDataFrame(rows, "scope string, item string, keys array<string>")).collect()}
        assert got == {("s", "alice"): "alice", ("s", "bob"): "alice", ("s", "carol"): "alice", ("s", "dan"): "dan", ("t", "bob"): "bob"}


def test_components_with_and_without_a_bound(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)], "a int, b int")
    nodes = spark.range(27).select(F.col("id").cast("int").alias("node"))
    full = {r.node: r.component for r in G.min_labels(edges, nodes).collect()}
    assert set(full.values()) == {0, 26}
    near = {r.node: r.component for r in G.min_labels(edges, nodes, 10).collect()}
    assert near[10] == 0 and near[11] == 1 and near[25] == 15


def test_story_order(spark):
    def order(scenes, edges):
        s = spark.createDataFrame([("k", *x) for x in scenes], "scope string, scene_id string, chapter_rank int, scene_index int")
        e = spark.createDataFrame([("k", *x) for x in edges], "scope string, from_id string, to_id string")
        return [r.scene_id for r in G.topological(s, e, "scope").orderBy("position").collect()]

    abc = [("a", 0, 0), ("b", 0, 1), ("c", 0, 2)]
    assert order(abc, [("c", "a"), ("a", "b")]) == ["c", "a", "b"]
    assert order(abc, []) == ["a", "b", "c"]
    assert order([("b", 0, None), ("a", 0, None)], []) == ["a", "b"]
    assert order(abc, [("a", "b"), ("b", "a"), ("a", "b")]) == ["c", "a", "b"]
    assert order([("x", 1, 0), ("y", 0, 5)], [("x", "gone")]) == ["y", "x"]


def test_back_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "from_id int, to_id int")
    assert {tuple(r) for r in G.back_paths(e, 5).collect()} == {(1, 2), (2, 3), (3, 1), (5, 5)}
    assert {tuple(r) for r in G.back_paths(e, 1).collect()} == {(5, 5)}


@pytest.mark.parametrize("kind, relation, flipped", [("meets", "before", False), ("AFTER", "before", True), ("R:temporal.met_by", "before", True), ("contains", "during", True), ("equals", "overlaps", False), ("finished_by", "finishes", True)])
def test_canonical_relations(spark, kind, relation, flipped):
    r = L.canonical(spark.createDataFrame([("a", "b", kind)], "from_id string, to_id string, temporal_type string")).first()
    assert (r.from_id, r.temporal_type) == ("b" if flipped else "a", "R:temporal." + relation)


def test_reconciliation(spark):
    def fold(*kinds):
        rows = [(i, *("ab" if k[0] != "<" else "ba"), k.strip("<"), "Explicit") for i, k in enumerate(kinds)]
        r = L.reconcile(spark.createDataFrame(rows, "seq int, from_id string, to_id string, temporal_type string, certainty string")).collect()
        return [(x.from_id, x.temporal_type.split(".")[1], x.ambiguous) for x in r]

    assert fold("before", "meets") == [("a", "before", 0)]
    assert fold("overlaps", "during") == [("a", "during", 0)] and fold("during", "overlaps") == [("a", "during", 0)]
    assert fold("during", "contains") == [("a", "during", 1)] and fold("before", "<before") == [("b", "before", 0)]
    assert fold("before", "<after", "starts") == [("a", "before", 1)]


def test_windows_and_bounds(spark):
    s = spark.createDataFrame([("c", i, f"s{i}") for i in range(5)] + [("d", 0, "x"), ("d", 1, "y")], "chapter_id string, scene_index int, scene_id string")
    got = {(r.chapter_id, r.window): r.scene_ids for r in L.windows(s).collect()}
    assert got == {("c", 0): ["s0", "s1", "s2"], ("c", 1): ["s1", "s2", "s3"], ("c", 2): ["s2", "s3", "s4"], ("d", 0): ["x", "y"]}


def test_edge_requests(spark):
    df = spark.createDataFrame([("p", "c", None, "before", "Explicit", "e", "after", None, None)], "previous_id string, current_id string, next_id string, previous_type string, previous_certainty string, previous_evidence string, next_type string, next_certainty string, next_evidence string")
    assert [(r.from_id, r.to_id, r.weight) for r in L.edge_requests(df).collect()] == [("p", "c", 0.95)]
    assert [r[0] for r in spark.createDataFrame([("before",), ("R:temporal.contains",), ("starts",)], "v string").select(L.inverted(F.col("v"))).collect()] == ["R:temporal.after", "R:temporal.during", None]


def test_consolidation(spark):
    rows = [("ch", "m1", 0, "Lord Harrow", "lord harrow", ["Teodor"], ["lord harrow", "teodor"], " ", None), ("ch", "m2", 1, "Teodor", "teodor", ["Teodor", "Harrow"], ["teodor"], "cruel", "iron"), ("ch", "m3", 2, "Ana", "ana", [], ["ana"], None, "x")]
    df = spark.createDataFrame(rows, "chapter_id string, id string, rank int, display_name string, normalized_name string, aliases array<string>, keys array<string>, description string, material string")
    df = df.withColumn("type", F.lit(None).cast("string")).withColumn("purpose", F.lit(None).cast("string"))
    got = {r.cluster: r for r in C.consolidate(df, "chapter_id", "object").collect()}
    assert got["m1"].display_name == "Lord Harrow" and got["m1"].aliases == ["Teodor", "Harrow"] and got["m1"].mention_count == 2
    assert got["m1"].description == "cruel" and got["m1"].material == "iron" and got["m3"].mention_count == 1


def test_events(spark):
    rows = [("ch", i, i, n, n.lower(), t, [a], e, d, "during") for i, n, t, a, e, d in [(1, "Duel", "fight", "x", "e1", "d1"), (2, "Duel", "talk", None, "e1", " "), (3, "Battle", "fight", "a", "e0", "d2"), (4, "Feast", "meal", None, None, None)]]
    df = spark.createDataFrame(rows, "chapter_id string, id int, rank int, display_name string, normalized_name string, event_type string, aliases array<string>, evidence string, description string, relation string")
    got = {r.component: r for r in C.event_entities(df, spark.createDataFrame([(1, 2), (3, 2)], "a int, b int")).collect()}
    e = got[1]
    assert (e.display_name, e.event_type, e.mention_count, e.evidence, e.descriptions) == ("Duel", "fight", 3, ["e0", "e1"], ["d1", "d2"])
    assert e.aliases == ["Battle", "Duel", "a", "battle", "duel", "x"] and "during=3" in e.card and got[4].mention_count == 1


def test_claims_and_writes(spark):
    claims = spark.createDataFrame([("s", "individual", "ana", "R:loves", "individual", "otto")] * 2 + [("s", "event", "duel", "R:of", "individual", "ana")], "scene_id string, subject_kind string, subject_key string, definition_key string, object_kind string, object_key string")
    mentions = spark.createDataFrame([("s", "individual", "ana", "m1", 0), ("s", "individual", "ana", "m2", 1), ("s", "event", "duel", "m3", 2)], "scene_id string, kind string, key string, id string, extraction_index int")
    got = {(r.subject_key, r.subject_id, r.object_id) for r in C.resolve_claims(claims, mentions).collect()}
    assert got == {("ana", "m2", None), ("duel", None, "m2")}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, seq int, v string")
    assert C.upsert_first(rows, ["k"], "seq").first().v == "x" and C.upsert_last(rows, ["k"], "seq").first().v == "y"
    staged = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, None)], "i int, stage_id string")
    assert sorted(r.i for r in C.delete_by_stage(staged, ["s1"]).collect()) == [2, 3]
    links = spark.createDataFrame([("e1", "b1"), ("e2", "b1"), ("e3", "b2")], "event_id string, book_event_id string")
    assert {r.event_id for r in C.rewrite_scope(spark.createDataFrame([("e1",), ("e9",)], "event_id string"), links).collect()} == {"e1", "e2", "e9"}
    assert [r.id for r in C.orphans(spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x",)], "id string"), "id").collect()] == ["y"]


def test_verdicts(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.5), ("a", "z", 0.9)], "event_id_1 string, event_id_2 string, score double")
    events = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "event_id string, card string")
    out = C.verdicts(pairs, events, models.merge_above(0.9))
    assert {(r.event_id_2, r.decision, r.confidence) for r in out.collect()} == {("b", "MERGE", 0.95), ("c", "KEEP_SEPARATE", 0.5), ("z", "UNRESOLVED", 0.0)}
    assert tuple(C.tallies(out).first()) == (1, 1, 1)


def test_chunk_spans():
    assert X.chunk_spans("") == [] and X.chunk_spans("x" * 1500) == [(0, 1500)]
    r = random.Random(3)
    for _ in range(30):
        t = "".join(r.choice(["word ", "end. ", "\n\n", '"Hi ', "longerword"]) for _ in range(r.randint(300, 2000))).strip()
        spans = X.chunk_spans(t)
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and (len(t) <= 1500) == (len(spans) == 1)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a + 400 <= c <= b and 400 <= b - a <= 1200 and d > b
    t = "a" * 700 + ". " + "b" * 90 + "\n\n" + "c" * 2000
    assert X.chunk_spans(t)[0] == (0, 794)


def test_segments():
    t = "\n\n".join("word " * 100 for _ in range(20))
    spans = X.segment_spans(t, 1000, 300)
    assert len(spans) == 4 and spans[0][0] == 0 and spans[-1][1] == len(t)
    assert all(t[b - 2 : b] == "\n\n" for _, b in spans[:-1]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert X.segment_spans("", 5, 1) == [] and X.segment_spans("abc", 1, 10) == [(0, 3)]


@pytest.mark.parametrize("anchor, expected", [
    ("quick brown fox", (4, "exact")), ("quick  brown\nfox", (4, "spacing")), ("The quick brown fox jumps over nothing at all", (0, "trimmed")),
    ("quick brawn fox jumps ovir the lazy", (4, "fuzzy")), ("entirely different words here", None), (" ", None),
])
def test_anchors(anchor, expected):
    assert X.locate("The quick brown fox jumps over the lazy dog and runs away.", anchor) == expected


def test_place_and_slice(spark):
    df = spark.createDataFrame([(1, "one two three four", ["one", "nowhere", "three"]), (2, None, ["x"]), (3, "t", None)], "chapter_id int, text string, anchors array<string>")
    got = [(r.chapter_id, r.scene_index, r.start_offset, r.end_offset, r.tier) for r in X.place(df).collect()]
    assert got == [(1, 0, 0, 8, "exact"), (1, 1, None, None, "missing"), (1, 2, 8, 18, "exact"), (2, 0, None, None, "missing")]
    assert df.select(X.scene_slice(F.col("text"), F.lit(-3), F.lit(99))).first()[0] == "one two three four"


def test_answers(spark):
    xml = "```xml\nHere: <scenes><scene><index>0</index><start_anchor>It was</start_anchor><context_summary>s</context_summary><break_reason>r</break_reason></scene><scene><index>1</index></scene></scenes>\n```"
    df = spark.createDataFrame([(xml,), ("no xml",), (None,)], "x string")
    got = [r[0] for r in df.select(X.parse_scenes(F.col("x"))).collect()]
    assert [s.start_anchor for s in got[0]] == ["It was"] and not got[1] and not got[2]
    assert X.parse_scenes and models.fake_segmentation("a b\n\nc d\n\ne f\n\ng h", 2).count("<scene>") == 2
    items = spark.createDataFrame([("s", '[{"name":" ","aliases":["","Ana"]},{"name":null},{"name":"Kai","age":"30"}]')], "scene_id string, payload string")
    assert [(r.extraction_index, r.display_name, r.age) for r in X.explode_extractions(items, "age:string").collect()] == [(0, "Ana", None), (2, "Kai", "30")]


def test_analysis(spark):
    df = spark.createDataFrame([([(" Ana ", ["a", " a"], None, "explicit"), (None, None, "d", None)],)], "v array<struct<name:string,aliases:array<string>,description:string,certainty:string>>")
    assert [x.name for x in df.select(A.normalized_items(F.col("v"), "individual")).first()[0]] == ["Ana"] and not df.select(A.normalized_items(F.col("v"), "event")).first()[0]
    c = spark.createDataFrame([("ana", "loves", "otto", None, "e" * 600, None), (" ", "x", "y", None, None, None)], "subject string, relation string, object string, description string, evidence string, certainty string")
    r = A.normalized_claims(c).collect()
    assert len(r) == 1 and r[0].definition_key == "R:loves" and len(r[0].evidence) == 500
    old = spark.createDataFrame([("a", "b", "BEFORE", 0.7)], "from_id string, to_id string, type string, confidence double")
    assert tuple(A.upgraded_edges(old).first()) == ("a", "b", "R:temporal.before", 0.7, "legacy")
    q = spark.createDataFrame([("Who did Lady Ana meet in Northport",)], "q string")
    assert q.select(A.noun_phrases(F.col("q"), F.array(F.lit("northport")))).first()[0] == ["Lady Ana"]
    with pytest.raises(ValueError):
        A.candidate_scope(q)


def test_embeddings(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    v = [r[0] for r in df.select(models.embedding(F.col("t"), size=8)).collect()]
    assert v[0] == v[1] != v[2] and len(v[0]) == 8 and models.fake_embedding("a", 8) == v[0]
    assert A.embed_distinct(df.filter("t is not null"), "t", lambda c: models.embedding(c, size=4)).count() == 2
    calls = []

    def flaky(temperature):
        calls.append(round(temperature, 1))
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert models.with_retry(flaky) == "ok" and calls == [0.0, 0.2, 0.4]
    assert models.fake_coreference([("1", "Duel"), ("2", "duel"), ("3", "x")])[0]["mention_ids"] == ["1", "2"]


def test_schemas(spark):
    assert all(schemas.schema(n) for n in schemas.TABLES) and set(schemas.KEYS) <= set(schemas.TABLES)
    df = schemas.conform(spark.createDataFrame([("c", 1), ("c", 1), ("c", 2)], "chapter_id string, scene_index long"), "scene")
    assert df.schema == schemas.schema("scene") and [tuple(r) for r in schemas.repeated_keys(df, "scene").collect()] == [("c", 1, 2)]


def test_library(spark):
    names = spark.createDataFrame([(" Seven Isles ",), ("seven isles",), ("Vale",), (" ",)], "name string")
    assert [r.name for r in B.create(names, spark.createDataFrame([("VALE",)], "name string")).collect()] == ["Seven Isles"]


def test_merge_candidates(spark):
    left = spark.createDataFrame([(1, None, ["a"]), (2, "x", None)], "chunk_id int, quote string, names array<string>")
    right = spark.createDataFrame([(1, "q", ["b", "a"]), (3, "z", ["c"])], "chunk_id int, quote string, names array<string>")
    got = {r.chunk_id: (r.quote, r.names) for r in R.merge_candidates(left, right, ["quote"], ["names"]).collect()}
    assert got == {1: ("q", ["a", "b"]), 2: ("x", []), 3: ("z", ["c"])}


def test_ask(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], 10, "U", None, 1, 1, "a quote")], "chunk_id int, embedding array<double>, chapter_id int, universe string, series string, book_number int, chapter_number int, snippet string")
    chapters = spark.createDataFrame([(10, "b", "U", None, 1, 1)], "chapter_id int, book_id string, universe string, series string, book_number int, chapter_number int")
    people = spark.createDataFrame([(10, "s1", 0, "Ana")], "chapter_id int, scene_id string, scene_index int, display_name string")
    asker = R.Asker(spark, chunks, chapters, people, people.limit(0), lambda q: [1.0, 0.0], models.echo)
    assert asker.ask("Who is the Ana?").text == "Ana: 1 mentions in b"
    assert asker.ask("Who is Nobody?").route == "NARRATIVE_QA" and "a quote" in asker.ask("why?").text
    assert asker.ask("why?", threshold=1.1).status == "NO_EVIDENCE"
    asker.embed = lambda q: 1 / 0
    assert asker.ask("why?").status == "SEARCH_FAILED"
