import random
import sqlite3
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from narrata import models
from narrata.operators import analysis as A
from narrata.operators import answers as M
from narrata.operators import consolidate as C
from narrata.operators import graph as G
from narrata.operators import index as V
from narrata.operators import names as N
from narrata.operators import phrases as H
from narrata.operators import search as S
from narrata.operators import segment as X
from narrata.plans import questions as Q
from narrata.plans import retrieval as R
from narrata.sources.catalog import CatalogSource
from narrata.streaming import timers


def test_name_hits_equal_a_plain_search(spark):
    r = random.Random(1)
    vocabulary = ["a", "ab", "the", "of", "x9", "ca"]
    texts = [(i, r.choice([" ", ", ", "--"]).join(r.choices(vocabulary, k=r.randint(0, 25))).upper()) for i in range(60)] + [(60, None), (61, ""), (62, "!!"), (5, "the the the")]
    names = [" ".join(r.choices(vocabulary, k=r.randint(1, 4))) for _ in range(30)] + ["The", "the  THE", None, "", "?", "never there"]
    got = N.name_hits(spark.createDataFrame(texts, "item int, text string"), spark.createDataFrame([(n, 1) for n in names], "name string, word int"))
    clean = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    known, expected = {tuple(clean(n)) for n in names} - {()}, Counter()
    for item, text in texts:
        ws = clean(text)
        expected.update((item, " ".join(n), i, i + len(n) - 1) for n in known for i in range(len(ws)) if tuple(ws[i : i + len(n)]) == n)
    assert Counter(map(tuple, got.collect())) == expected and len(expected) > 300
    assert N.name_hits(spark.createDataFrame(texts, "item int, text string"), spark.createDataFrame([], "name string")).collect() == []


def test_capped_pairs_equal_the_walk(spark):
    r = random.Random(2)
    pairs = list({(b, *sorted(r.sample(range(b * 100, b * 100 + 14), 2))) for b in (1, 2) for _ in range(80)})
    pairs = [(*p, round(r.choice([0.6, 0.7, 0.8, r.random()]), 3)) for p in pairs] + [(3, 300, 300 + i, 0.9) for i in range(1, 30)]
    df = spark.createDataFrame(pairs, "book_id int, event_id_1 int, event_id_2 int, score double")
    for most in (1, 3):
        used, expected = Counter(), set()
        for b, x, y, s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
            if used[b, x] < most and used[b, y] < most:
                used[b, x] += 1
                used[b, y] += 1
                expected.add((b, x, y, s))
        assert set(map(tuple, S.cap_pairs(df, most).collect())) == expected
    assert S.cap_pairs(df.limit(0)).collect() == []


def test_a_silent_stage_becomes_stale_by_itself(spark, tmp_path):
    schema = "job_id long, event_id long, ts timestamp, status string"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    waves = [[(1, 1, at(0), "TRIGGERED"), (1, 2, at(1), "RUNNING"), (2, 3, at(0), "TRIGGERED"), (3, 4, at(1), "COMPLETED")], [(2, 5, at(3), "RUNNING"), (2, 6, at(4), "COMPLETED")], [(4, 7, at(30), "TRIGGERED")], [(1, 8, at(31), "TRIGGERED")]]
    for i, wave in enumerate(waves):
        spark.createDataFrame(wave, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"w{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "w*"))
        got = {r.job_id: (r.status, r.events, r.refused, r.lapses) for r in timers.replay(stream, str(tmp_path / "out"), 10 * 60_000).collect()}
        if i == 1:
            assert got == {1: ("RUNNING", 2, 0, 0), 2: ("COMPLETED", 3, 0, 0), 3: ("PENDING", 1, 1, 0)}
        if i == 2:
            assert got[1] == ("STALE", 2, 0, 1) and got[4] == ("TRIGGERED", 1, 0, 0)
    assert got[1] == ("TRIGGERED", 3, 0, 1)


def test_lapses_within_a_batch():
    state = timers.advance(("PENDING", None, 0, 0, 0), [(0, "TRIGGERED"), (10, "RUNNING"), (100, "RUNNING"), (101, "TRIGGERED")], 50)
    assert state == ("TRIGGERED", 101, 4, 1, 1)


@pytest.fixture(scope="module")
def library(spark):
    vector = lambda i: [1.0 if j == i % 4 else 0.1 * (i % 3) for j in range(4)]
    chunks = [(i, i // 2, "u", "s", 1, i // 2 + 1, f"text {i}", vector(i)) for i in range(12)]
    chunks = spark.createDataFrame(chunks, "chunk_id long, chapter_id long, universe string, series string, book_number int, chapter_number int, snippet string, embedding array<double>")
    chapters = spark.createDataFrame([(i, "u", "s", 1, i + 1, "u/s/1") for i in range(6)], "chapter_id long, universe string, series string, book_number int, chapter_number int, book_id string")
    people = spark.createDataFrame([("u/s/1", "e1", "Mara", "mara", i) for i in (0, 0, 3)] + [("u/s/1", "e2", "Oslo", "oslo", 1)], "book_id string, book_entity string, display_name string, normalized_name string, chapter_id long")
    places = spark.createDataFrame([("u/s/1", "p1", "Tarn", "tarn", 2)], people.schema)
    individuals = people.select("chapter_id", "display_name")
    return V.build(chunks.select(F.col("chunk_id").alias("id"), "embedding"), cells=2), chunks, chapters, people, places, individuals


def ask(spark, library, rows, **options):
    out = {}
    questions = spark.createDataFrame(rows, "question_id int, question string, embedding array<double>")
    for r in Q.answers(questions, *library, **options).orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append(r)
    return out


def test_questions_of_every_route(spark, library):
    near = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, "Who is the Mara?", near), (2, "Where is Tarn?", near), (3, "Who is Nobody?", near), (4, "Did Mara sleep?", near), (5, "Why?", None), (6, None, near), (7, "  ", None)]
    got = ask(spark, library, rows, k=3)
    assert {q: (x[0].route, x[0].status, x[0]["rank"]) for q, x in got.items()} == {
        1: ("ENTITY_LOOKUP", "OK", 1), 2: ("ENTITY_LOOKUP", "OK", 1), 3: ("NARRATIVE_QA", "OK", 1), 4: ("NARRATIVE_QA", "OK", 1),
        5: ("NARRATIVE_QA", "SEARCH_FAILED", None), 6: ("NARRATIVE_QA", "OK", 1), 7: ("NARRATIVE_QA", "SEARCH_FAILED", None),
    }
    assert got[1][0].line == "Mara: 3 mentions in u/s/1" and got[2][0].item == "Tarn" and len(got[3]) == 3
    boosted = {x.item for x in got[4] if round(x.score * 1e6) != round({y.item: y.score for y in got[3]}[x.item] * 1e6)}
    assert boosted == {x.item for x in got[3] if int(x.item) // 2 in (0, 3)}
    none = ask(spark, library, [(1, "Why?", near)], threshold=1.1)
    assert [(x.status, x["rank"]) for x in none[1]] == [("NO_EVIDENCE", None)]
    assert ask(spark, library, []) == {}


def test_hybrid_questions(spark, library):
    near = [1.0, 0.0, 0.0, 0.0]
    got = ask(spark, library, [(1, "Mara", near), (2, "Mara", None), (3, "Nobody", None), (4, "Nobody", near)], hybrid=True, k=4)
    assert {q: x[0].status for q, x in got.items()} == {1: "OK", 2: "DEGRADED", 3: "SEARCH_FAILED", 4: "OK"}
    assert [x.item for x in got[2]] == ["0", "1", "6", "7"] and {x.item for x in got[1][:2]} <= {"0", "1", "6", "7"}


def test_recent_entries():
    now = [0.0]
    c = models.Recent(2, 10, lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)  # b was used longest ago
    assert c.get("b") is None and c.get("a") == 1 and list(c.entries) == ["c", "a"]
    now[0] = 9.9
    assert c.get("c") == 3
    now[0] = 10
    assert c.get("a") is None and len(c.entries) == 1


def test_vectors_ask_the_model_once(spark):
    calls, cache = [], models.Recent(10, 60)

    def batch(texts):
        calls.append(list(texts))
        return [[float(len(t))] for t in texts]

    assert models.vectors_of(["a", "bb", "a", None, " "], batch, 1, 1, cache) == [[1.0], [2.0], [1.0], None, None]
    assert models.vectors_of(["bb", "ccc"], batch, 1, 8, cache) == [[2.0], [3.0]] and calls == [["a"], ["bb"], ["ccc"]]
    with pytest.raises(ValueError):
        models.vectors_of(["x"], lambda t: [], 1)
    df = spark.createDataFrame([("x",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(models.embedding(F.col("t"), size=4, cache="fake")).collect()]
    assert got == [models.fake_embedding("x", 4)] * 2 + [None]


def test_catalog_inserts_what_is_absent(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE definitions (definition_id INTEGER, definition_key TEXT, note TEXT)")
        db.execute("INSERT INTO definitions VALUES (1, 'R:old', 'kept')")
    spark.dataSource.register(CatalogSource)
    options = {"driver": "sqlite3", "database": path, "table": "definitions", "key": "definition_key", "columns": "definition_id long, definition_key string, note string"}
    read = lambda: sorted(map(tuple, spark.read.format("catalog").options(**options).load().collect()))
    new = spark.createDataFrame([(7, "R:old", "no"), (9, "R:new", "later"), (8, "R:new", "first"), (3, None, "no key")], options["columns"])
    expected = [(1, "R:old", "kept"), (8, "R:new", "first")]
    for _ in range(2):
        new.repartition(3).write.format("catalog").options(**options).mode("append").save()
        assert read() == expected
    failing = spark.createDataFrame([(i, f"R:{i}", "x") for i in range(20)], options["columns"]).repartition(4)
    failing = failing.withColumn("note", F.when(F.col("definition_id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="broken"):
        failing.write.format("catalog").options(**options).mode("append").save()
    assert read() == expected
    new.limit(1).write.format("catalog").options(**options).mode("append").save()  # what a late task may have staged stays out of later commits
    assert read() == expected
    assert spark.read.format("catalog").options(numPartitions="3", **options).load().rdd.getNumPartitions() == 3


def test_upkeep_rewrites_what_was_touched(spark):
    r = random.Random(5)
    name = lambda: "".join(r.choices("ab", k=3))
    make = lambda rows: spark.createDataFrame(rows, "chapter_id long, id string, rank int, display_name string, normalized_name string, aliases array<string>")
    rows = [(c, f"{c}-{i}", i, (n := name() + ("" if c % 4 else "x" * c)), n, [name()] if r.random() < 0.4 else []) for c in range(12) for i in range(4)]
    changed = [3, 7]
    later = [x for x in rows if x[0] not in changed or x[2] != 1] + [(3, "3-9", 9, "aab", "aab", ["zzz"])]
    chapters = spark.createDataFrame([(c, f"b{c % 3}") for c in range(12)], "chapter_id long, book_id string")
    entities = C.chapter_entities(make(rows))
    own = C.refers_to(entities.join(chapters, "chapter_id"), "book_id")
    members = entities.join(own.select(own["scope"].alias("book_id"), own["item"].alias("id"), own["cluster"].alias("book_entity")), "id")
    books = C.book_entities(entities, chapters)
    fresh = C.chapter_entities(make([x for x in later if x[0] in changed]))
    kept, new = C.book_entities_after(spark.createDataFrame([(c,) for c in changed], "chapter_id long"), members, fresh, chapters, books)
    whole = C.book_entities(C.chapter_entities(make(later)), chapters).select(books.columns)
    rewritten = new.collect()
    assert sorted(map(repr, [*kept.collect(), *rewritten])) == sorted(map(repr, whole.collect()))
    # Chapters 3 and 7 lie in books 0 and 1; the third book and names that nothing touches are not written.
    assert {x.book_id for x in rewritten} <= {"b0", "b1"} and 0 < len(rewritten) < len(whole.filter("book_id <> 'b2'").collect())


def labelled(seed, n):
    """Sentences with words that are a noun or a verb, or a name or a noun, by their place."""
    r = random.Random(seed)
    nouns, verbs, names = ["dog", "tower", "river", "watch", "run", "guard"], ["watch", "run", "guard", "sees", "opened"], ["Mara", "Oslo", "River", "Tarn"]
    adjectives = ["old", "silver", "broken", "strange", "small"]
    out = []
    for _ in range(n):
        np = lambda: [(r.choice(["the", "a"]), "D")] + [(r.choice(adjectives), "A")] * r.randint(0, 1) + [(r.choice(nouns), "N")] if r.random() < 0.7 else [(r.choice(names), "P")]
        s = [*np(), (r.choice(verbs), "V"), *np()] + ([("near", "I"), *np()] if r.random() < 0.5 else []) + [(r.choice("?."), "X")]
        if r.random() < 0.3:
            s = [("did", "V"), *s]
        out.append(([w for w, _ in s], [t for _, t in s]))
    return out


def test_tagger_on_held_out_sentences(spark):
    tagger = H.fit(spark.createDataFrame(labelled(1, 400), "words array<string>, tags array<string>"))
    pairs = [(x, y) for words, tags in labelled(2, 200) for x, y in zip(tagger.tag(words), tags)]
    assert sum(x == y for x, y in pairs) / len(pairs) >= 0.95
    df = spark.createDataFrame([("Did the old guard watch Mara near a silver tower?", ["the guard"]), (None, []), ("?!", [])], "q string, known array<string>")
    got = [r[0] for r in df.select(A.noun_phrases(F.col("q"), F.col("known"), H.tagged_by(tagger))).collect()]
    assert got == [["old guard", "Mara", "silver tower"], [], []]


def test_phrase_grammar(spark):
    rows = [(["D/the", "A/big", "N/dog", "V/ran", "P/Mara", "P/Oslo", "I/to", "M/two", "N/towns"],), (["A/alone", "V/is"],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(H.phrases(F.col("t"))).collect()]
    assert got == [["big dog", "Mara Oslo", "two towns"], [], [], []]


def test_analyses_of_a_model_that_fails_or_babbles(spark):
    def generate(previous, current, following):
        if current == "fails":
            raise RuntimeError("no answer")
        if current == "babbles":
            return "not json"
        if current == "half":
            return '{"individuals": [{"name": " ", "aliases": ["", " Bo "]}, {"name": null}], "next": {"type": "later"}}'
        return models.fake_triad(previous, current, following)

    scenes = spark.createDataFrame([("s1", "Ann met Bo"), ("s2", "fails"), ("s3", "babbles"), ("s4", "half"), ("s5", "half")], "scene_id string, text string")
    triads = spark.createDataFrame([(None, "s1", "s2"), ("s1", "s2", "s3"), ("s2", "s3", "s4"), (None, "s4", "s5"), ("s4", "s5", None)], "previous_id string, current_id string, next_id string")
    got = {r.current_id: r for r in M.scene_analyses(triads, scenes, generate, 2).collect()}
    assert {k: r.problem for k, r in got.items()} == {"s1": None, "s2": "FAILED", "s3": "UNREADABLE", "s4": "INVALID_NEXT", "s5": "MISSING_PREVIOUS"}
    assert [x.name for x in got["s1"].individuals] == ["Ann", "Bo"] and got["s1"].next_type == "R:temporal.before" and got["s1"].previous_type is None
    assert [x.name for x in got["s4"].individuals] == ["Bo"]


def test_entities_of_a_lane_read_their_mentions_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    kind = "chapter_id long, id string, rank int, display_name string, normalized_name string, aliases array<string>"
    rows = [(c, f"{c}-{i}", i, f"Name {i % 3}", f"name {i % 3}", ["N"] if i % 3 == 0 else []) for c in range(4) for i in range(9)]
    mentions = spark.createDataFrame(rows, kind).mapInPandas(count, kind)
    entities, books, links, named = C.lane_tables(mentions, spark.createDataFrame([(c, "b") for c in range(4)], "chapter_id long, book_id string"))
    assert (entities.count(), books.count(), links.count(), named.count()) == (12, 3, 12, 12)
    assert seen.value == len(rows)


def test_components_of_one_hub_need_no_rounds_and_others_are_whole(spark, monkeypatch):
    rounds = []
    labels = G.min_labels
    monkeypatch.setattr(G, "min_labels", lambda *a, **k: rounds.append(1) or labels(*a, **k))

    def entities(rows):
        kind = "chapter_id long, id string, rank int, display_name string, normalized_name string, aliases array<string>"
        made = C.chapter_entities(spark.createDataFrame(rows, kind))
        return {(r.chapter_id, r.cluster): (r.mention_count, sorted(r.aliases)) for r in made.collect()}

    stars = [(c, f"{c}-{i:02}", i, n, n, [n[:2]]) for c in (1, 2) for i, n in enumerate(["abel", "abba", "cain", "ab", "cab", "cain"])]
    expected = {(c, f"{c}-{i}"): v for c in (1, 2) for i, v in (("00", (3, ["ab"])), ("02", (3, ["ca"])))}
    assert entities(stars) == expected and not rounds

    r = random.Random(5)
    rows = [(c, f"{c}-{i:03}", i, n, n, r.choices([f"k{j}" for j in range(25)], k=r.randint(0, 3))) for c in range(6) for i, n in enumerate(r.choices([f"n{j}" for j in range(30)], k=25))]
    found = {}
    for c in range(6):
        left = [(x[1], {x[3], *x[5]}) for x in rows if x[0] == c]
        while left:
            ids, keys = {left[0][0]}, set(left[0][1])
            while more := [x for x in left if x[0] not in ids and x[1] & keys]:
                ids |= {x[0] for x in more}
                keys |= set().union(*(x[1] for x in more))
            found[(c, min(ids))] = (len(ids), sorted({a for x in rows if x[1] in ids for a in x[5]}))
            left = [x for x in left if x[0] not in ids]
    assert entities(rows) == found and rounds and any(n > 2 for n, _ in found.values()) and len(found) > 12


def test_members_of_names_are_the_chain_of_those_names(spark):
    r = random.Random(6)
    kind = "chapter_id long, id string, rank int, scene_id string, scene_index int, display_name string, normalized_name string, aliases array<string>"
    rows = [(c, f"{c}-{i:02}", i, f"s{i // 3}", i // 3, n, n.lower(), [n[:2]]) for c in range(9) for i, n in enumerate(r.choices(["The", "Them", "Thor", "Of", "Offa", "Ann", "Bo"], k=12))]
    mentions, chapters = spark.createDataFrame(rows, kind), spark.createDataFrame([(c, f"b{c % 3}") for c in range(9)], "chapter_id long, book_id string")
    keyed = C.resolvable(mentions).withColumn("keys", C.key_set(F.col("keys")))
    _, books, links, named = C.lane_tables(mentions, chapters)
    columns = ["chapter_id", "id", "scene_id", "book_id", "book_entity", "normalized_name", "first_seen_chapter_id"]
    whole = R.entity_chain(keyed, named, links, books).filter("normalized_name in ('the', 'ann')").select(columns)
    some = R.chain_of(keyed, C.named_members(mentions, chapters, spark.createDataFrame([("the",), ("ann",), ("ann",), ("nobody",)], "normalized_name string"))).select(columns)
    assert Counter(map(tuple, some.collect())) == Counter(map(tuple, whole.collect())) and some.count() > 20


def test_name_hits_shuffle_only_what_the_map_lets_through(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(80)]
    names = [" ".join(r.choices(vocabulary[:20], k=r.choice([1, 1, 2, 4]))) for _ in range(60)]
    df, known = spark.createDataFrame(texts, "item int, text string"), spark.createDataFrame([(n,) for n in names + names[:25]], "name string")
    expected = Counter()
    for item, text in texts:
        ws = text.split()
        expected.update((item, n, i, i + n.count(" ")) for n in set(names) for i in range(len(ws)) if " ".join(ws[i : i + n.count(" ") + 1]) == n)
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    out = N.name_hits(df, known)
    assert Counter(map(tuple, out.collect())) == expected and len(expected) > 200 and "Exchange" not in plan(out)
    monkeypatch.setattr(N, "WORDS", 50)
    monkeypatch.setattr(N, "MAP_BITS", 8)  # names beyond those held, and windows that the map lets through without cause
    for held in (0, 30):
        monkeypatch.setattr(N, "HELD", held)
        out = N.name_hits(df, known)
        assert Counter(map(tuple, out.collect())) == expected and "Join" in plan(out)


def test_fuzzy_anchors_measure_few_distances(monkeypatch):
    asked, made = [], X.distances_to
    monkeypatch.setattr(X, "distances_to", lambda a: lambda b, most: asked.append(b) or made(a)(b, most))
    r = random.Random(8)
    text = " ".join(r.choices(["that", "this", "those", "these", "then"], k=4000))
    assert X.locate(text, "thatzz") is None and not asked  # too short for an edit
    assert X.locate(text, "thatzzzzz") is None and len(asked) <= text.count("that")  # one edit, so one of two halves, in its place
    at = text.index("those these", 9000)
    for wrong in (text[at : at + 30][:7] + "#" + text[at + 8 : at + 30], text[at : at + 12] + "#" + text[at + 12 : at + 21] + text[at + 22 : at + 30]):
        spots = [(d, i) for i in range(len(text) - 29) if (d := made(wrong)(text[i : i + 30], 3)) is not None]
        assert X.locate(text, wrong) == (min(spots)[1], "fuzzy")
