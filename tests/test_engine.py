"""Operators whose order of work SQL can't state, against plain versions; and cases that went wrong once."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata import models
from narrata.operators import analysis as A
from narrata.operators import consolidate as C
from narrata.operators import filters as P
from narrata.operators import graph as G
from narrata.operators import search as S
from narrata.operators import segment as X
from narrata.operators import timeline as L
from narrata.plans import dag as D
from narrata.plans import jobs as J
from narrata.plans import library as B
from narrata.plans import retrieval as R
from narrata.streaming import jobs as streams

RND = random.Random(5)
WORDS = ["Ana", "went", "down", "to", "the", "harbour", "where", "ships", "lay", "still", "“Stop”", "and", "Tom", "&", "x"]


def prose(n):
    out = []
    for i in range(n):
        out.append(RND.choice(WORDS) + RND.choice(["", "", "", ".", "?", "!"]))
        if RND.random() < 0.05:
            out[-1] += "\n\n"
    return " ".join(out)


# chunks


def plain_chunks(t):
    """Every place is tried one after another, as the rules of the chunker say."""
    n, out, start = len(t), [], 0
    if n <= 1500:
        return [(0, n)] if n else []

    def weight(p):
        found = []
        for m in re.finditer(r"\n\s*\n", t):
            found += [100] if m.end() == p else []
        for m in re.finditer(r"""[.!?…]+["'”’)]*\s+""", t):
            found += [40] if m.end() == p else []
        for m in re.finditer(r"""(?:\n\s*["“'‘-]|["“'‘][A-Z])""", t):
            found += [25] if m.start() == p else []
        return max(found, default=None)

    weights = {p: w for p in range(n + 1) if (w := weight(p)) is not None}
    while start < n:
        target, best = start + 800, None
        for p in range(start + 400, min(start + 1200, n) + 1):
            if p in weights:
                score = weights[p] - abs(p - target) // 10
                if best is None or score >= best[0]:
                    best = (score, p)
        end = best[1] if best else target
        if 400 <= n - start <= 1200 and (best is None or abs(n - target) >= 10):
            end = n
        end = min(end, n)
        following = max(start + 400, end - 200)
        if n - following < 400:
            out.append((start, n))
            break
        out.append((start, end))
        start = following
    return out


def test_chunks(spark):
    texts = [prose(k) for k in (0, 5, 240, 300, 700)] + ["a" * 4000, "word " * 500, ("x" * 799 + ". ") * 4]
    rows = X.chunk(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.chunk_number, r.start, r.end, r.text))
    clean = dict(spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", X.chunk_text(F.col("text"))).collect())
    for i, t in clean.items():
        assert sorted(got.get(i, [])) == [(n + 1, a, b, t[a:b]) for n, (a, b) in enumerate(plain_chunks(t))]


# anchors


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def plain_place(text, anchors):
    out, after = [], 0
    for a in anchors:
        a, hit = a.strip(), None
        words = a.split()
        if a and (at := text.find(a, after)) >= 0:
            hit = at, "exact"
        if a and not hit:
            m = re.compile(r"\s+".join(map(re.escape, words))).search(text, after)
            hit = (m.start(), "spacing") if m else None
        for n in range(len(words) - 1, 4, -1):
            if not hit:
                found = [m.start() for m in re.compile(r"\s+".join(map(re.escape, words[:n]))).finditer(text, after)]
                hit = (found[0], "trimmed") if len(found) == 1 else None
        if a and not hit:
            near = [(d, p) for p in range(after, len(text) - len(a) + 1) if (d := levenshtein(a, text[p : p + len(a)])) <= 3 and 1 - d / len(a) >= 0.85]
            hit = (min(near)[1], "fuzzy") if near else None
        out.append(hit or (None, "missing"))
        after = hit[0] + 1 if hit else after
    return out


def test_placed_anchors(spark):
    cases = []
    for i in range(8):
        text = "\n".join(prose(9).replace("\n", " ") for _ in range(6))
        lines = text.split("\n")
        odd = [lines[0], lines[1].replace(" ", "  "), lines[2] + " and nothing else", lines[3][:20] + "z" + lines[3][21:], "not in the text at all", "", lines[5][:25]]
        cases.append((i, text, odd))
    got = {}
    placed = X.place(spark.createDataFrame(cases, "chapter_id int, text string, anchors array<string>"))
    for r in placed.collect():
        got.setdefault(r.chapter_id, []).append((r.scene_index, r.start_offset, r.tier))
    tiers = set()
    for i, text, anchors in cases:
        expected = plain_place(text, anchors)
        assert sorted(got[i]) == [(n, at, tier) for n, (at, tier) in enumerate(expected)]
        tiers |= {t for _, t in expected}
    assert tiers == {"exact", "spacing", "trimmed", "fuzzy", "missing"}
    assert {r.error for r in X.placement_errors(placed).collect()} == {"DROPPED"}


def test_segmentation_end_to_end(spark):
    text = "\n\n".join(f"Tom & Ana <{i}> met at gate {i} of the old town, and stayed." for i in range(40))
    calls = spark.sparkContext.accumulator(0)

    def segmenter(t, temperature):
        calls.add(1)
        if temperature < 0.1:
            raise RuntimeError("busy")
        return models.fake_segmentation(t, 5)

    df = spark.createDataFrame([(1, text), (2, "Short & sweet."), (3, "")], "chapter_id int, text string")
    parts = [(r.segment, r.start, r.text) for r in X.segments(df.filter("chapter_id = 1"), 300).collect()]
    assert len(parts) > 1 and "".join(t for _, _, t in sorted(parts)) == text and all(text[a : a + len(t)] == t for _, a, t in parts)
    rows = sorted(tuple(r) for r in X.detect_scenes(df, segmenter, 300).collect())
    mine = [r for r in rows if r[0] == 1]
    assert len(mine) >= 8 and all(r[4] == "exact" and text[r[2] :].startswith("Tom & Ana <") for r in mine) and mine[-1][3] == len(text)
    assert [r[2:4] for r in rows if r[0] == 2] == [(0, 14)] and calls.value >= 2
    scenes = X.detect_scenes(df, segmenter, 300).filter("start_offset is not null").join(df, "chapter_id").select(F.concat_ws(":", "chapter_id", "scene_index").alias("scene_id"), X.scene_slice(F.col("text"), F.col("start_offset"), F.col("end_offset")).alias("text"), "start_offset")
    chunks = X.chunk_scenes(scenes, spark.createDataFrame([("1:0",)], "scene_id string")).collect()
    assert chunks and not any(r.scene_id == "1:0" for r in chunks) and all(text[r.start : r.end].startswith(r.text[:10]) for r in chunks if r.scene_id[0] == "1")


# vectors


def test_similar_pairs_in_tiles(spark):
    r = np.random.default_rng(4)
    rows = [(i, i % 2, i % 5 if i % 7 else None, r.normal(size=3).tolist()) for i in range(40)] + [(40, 0, 1, [0.0, 0.0, 0.0]), (41, 0, 1, [1.0, 2.0]), (42, 1, 2, None)]
    items = spark.createDataFrame(rows, "id long, scope int, kind int, embedding array<double>")
    score = lambda a, b: round((1 + float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))) / 2, 6)
    expected = {}
    for i, s, k, v in rows[:40]:
        for j, t, m, w in rows[:40]:
            if i != j and s == t and (k is None or m is None or k != m) and score(v, w) >= 0.6:
                expected[i, j] = score(v, w)
    got = {(x.source, x.target): x.score for x in S.similar_pairs(items, 0.6, tile=6).collect()}
    assert got == {p: v for p, v in expected.items() if p[0] < p[1]}
    best = {i: sorted((-v, b) for (a, b), v in expected.items() if a == i)[:3] for i in range(40)}
    near = S.similar_pairs(items, 0.6, 3, tile=6).collect()
    assert {(x.source, x.target) for x in near} == {(i, b) for i, held in best.items() for _, b in held}


def test_embedding_batches(spark):
    def batch(texts):
        assert len(texts) <= 32 and all(t.strip() for t in texts)
        return [[float(len(t))] * 4 for t in texts]

    df = spark.createDataFrame([(i, "x" * (i % 9) if i % 10 else None) for i in range(100)], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in df.select("i", models.embedding(F.col("t"), batch, 4).alias("v")).collect()}
    assert all(got[i] == ([float(i % 9)] * 4 if i % 10 and i % 9 else None) for i in range(100))
    with pytest.raises(Exception, match="number or size"):
        df.select(models.embedding(F.col("t"), lambda texts: [[1.0]] * len(texts), 4)).collect()
    e = spark.createDataFrame([(1, "c", [1.0, 2.0], None), (2, " ", None, None), (3, "c", [1.0], "h")], "i int, card string, embedding array<double>, embedding_hash string")
    e = e.withColumn("embedding_hash", F.when(F.col("i") == 3, F.sha2(F.lit("m:c"), 256)))
    assert [r.i for r in A.to_embed(e, "m", "card", 2).orderBy("i").collect()] == [1, 3] and [r.i for r in A.to_embed(e, "m", "card", 1).collect()] == [1]


# graphs and relations


def test_walks_are_counted(spark):
    edges = [(a, b) for a in range(7) for b in range(7) if a != b and (a * 3 + b) % 4 == 1]
    e = spark.createDataFrame(edges, "from_id int, to_id int")
    m = np.zeros((7, 7), int)
    for a, b in edges:
        m[a, b] = 1
    total = sum(np.linalg.matrix_power(m, k) for k in range(1, 5))
    assert {(r.from_id, r.to_id): r.paths for r in G.path_counts(e, e, 4).collect()} == {(a, b): int(total[b, a]) for a, b in edges if total[b, a]}
    assert sorted(r.id for r in L.later(e, 0).collect()) == [b for a, b in edges if a == 0] and sorted(r.id for r in L.earlier(e, 0).collect()) == [a for a, b in edges if b == 0]


def test_relations_in_opposite_directions(spark):
    rows = [(1, "a", "b", "before"), (2, "b", "a", "before"), (3, "a", "b", "during"), (4, "c", "d", "during"), (5, "c", "d", "contains"), (6, "e", "f", "overlaps"), (7, "f", "e", "during"), (8, "e", "f", "equals")]
    df = spark.createDataFrame([(s, a, b, "R:temporal." + k, f"sure {s}") for s, a, b, k in rows], "seq int, from_id string, to_id string, temporal_type string, certainty string")
    got = {(r.from_id, r.to_id): (r.temporal_type[11:], r.certainty, r.ambiguous) for r in L.reconcile(df).collect()}
    # The second request turns the edge round; `equals` is an overlap, which turns the enclosure round and leaves it one.
    assert got == {("b", "a"): ("before", "sure 2", 1), ("c", "d"): ("during", "sure 4", 1), ("e", "f"): ("during", "sure 8", 0)}
    refused = {(r.seq, r.from_id, r.existing_type[11:], r.incoming_type[11:]) for r in L.ambiguous_relations(df).collect()}
    assert refused == {(3, "a", "before", "during"), (5, "c", "during", "contains")}
    again = df.unionByName(spark.createDataFrame([(9, "a", "b", "R:temporal.overlaps", "sure 9"), (10, "b", "a", "R:temporal.starts", "sure 10")], df.schema))
    assert {(r.seq, r.from_id) for r in L.ambiguous_relations(again).filter("seq <> 5").collect()} == {(9, "a"), (10, "b")}


def test_groups_of_answers_are_stable(spark):
    answers = spark.createDataFrame([("w1", [1, 2], 0.8), ("w1", [2, 1], 0.9), ("w1", [3, 4], 0.9), ("w2", [1, 3], 0.5), ("w2", [5, 6], 0.8)], "window string, mention_ids array<long>, confidence double").repartition(3)
    allowed = spark.createDataFrame([("w1", i) for i in (1, 2, 3, 4)] + [("w2", 5)], "window string, id long")
    assert {(r.a, r.b, r.confidence) for r in C.coreference(answers, allowed).collect()} == {(1, 2, 0.9), (3, 4, 0.9)}


def test_status_follows_the_declared_order(spark):
    rows = [(1, "CHUNKING", "RUNNING"), (1, "BOOK_CONCEPT_CONSOLIDATION", "PENDING"), (1, "SCENE_SEGMENTATION", "COMPLETED"), (2, "OTHER", "RUNNING"), (2, "EMBEDDING", "PENDING")]
    df = spark.createDataFrame([(*r, None) for r in rows], "job_id int, step string, status string, triggered_at timestamp")
    assert {r.job_id: r.status for r in J.summaries(df, D.LAST, D.STEPS).collect()} == {1: "CHUNKING", 2: "EMBEDDING"}
    before = {t.name for t in spark.catalog.listTables()}
    assert D.closure(spark).count() > 10 and {t.name for t in spark.catalog.listTables()} == before


def test_entities_in_xml(spark):
    xml = "<scenes><scene><index>0</index><start_anchor>Tom &amp; Ana &lt;3 &amp;amp;</start_anchor><context_summary>s</context_summary></scene></scenes>"
    df = spark.createDataFrame([(xml,)], "x string")
    assert df.select(X.parse_scenes(F.col("x"))).first()[0][0].start_anchor == "Tom & Ana <3 &amp;"


# scopes, claims, library


def test_rewritten_scope_drops_orphans(spark):
    ev = spark.createDataFrame([("B", c, i, f"E{i}", f"e{i}", "t", 1) for i, c in ((1, 1), (2, 1), (3, 2), (4, 2), (5, 3))], "book_id string, chapter_id int, event_id int, display_name string, normalized_name string, event_type string, mention_count int")
    dec = lambda *p: spark.createDataFrame([(a, b, "MERGE") for a, b in p], "event_id_1 int, event_id_2 int, decision string")
    before = C.book_events(ev, dec((1, 3), (4, 5)))
    links = before.select(F.explode("members").alias("event_id"), "book_event_id")
    events, new = C.rewrite_book_events(1, ev, dec((2, 3)), links, before)
    assert {r.book_event_id: r.members for r in events.collect()} == {1: [1], 2: [2, 3], 4: [4, 5]}
    assert {(r.event_id, r.book_event_id) for r in new.collect()} == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 4)}


def test_disabled_catalog_and_guards(spark):
    q = spark.createDataFrame([(1, "R:a")], "query_id int, definition_key string")
    with pytest.raises(RuntimeError):
        C.find_or_create(q, q, q, enabled=False)
    scopes, members = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert {tuple(r) for r in C.guarded(spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int"), scopes, members, "k").collect()} == {(1, "READY", 2), (2, "EMPTY", 0), (3, "MISSING", 0)}
    with pytest.raises(ValueError):
        B.checked_name("  ", "title")
    books = B.create_books(spark.createDataFrame([("U", None, " ", 1), (" ", "S", "T", 2), ("U", None, "New ", 3)], "universe string, series string, title string, book_number int"), spark.createDataFrame([], "universe string, series string, title string, book_number int"))
    assert {(r.title, r.is_new, r.problem) for r in books.collect()} == {("", False, "TITLE"), ("T", False, "UNIVERSE"), ("New", True, None)}


def test_visibility_from_ids(spark):
    universes, series = spark.createDataFrame([(1, "U")], "id int, name string"), spark.createDataFrame([(5, 1, "S")], "id int, universe_id int, name string")
    books = spark.createDataFrame([(9, 3)], "id int, book_number int")
    make = lambda **k: R.visibility_of(books, series, universes, **k)
    assert make(universe_id=1, series_id=5, book_id=9, chapter=" 4 ") == P.Visibility("U", (P.SeriesProgress("S", 3, 4),))
    assert make(universe=" V ", series_name=" ", book_number=2, chapter="x", policy="SHOW") == P.Visibility("V", (P.SeriesProgress(None, 2, None),), "SHOW")
    assert make(universe_id=7, book_id=9) is None and make(universe_id=1, book_id=8) is None


# asking


def test_hybrid_questions(spark):
    cols = "chunk_id int, embedding array<double>, chapter_id int, universe string, series string, book_number int, chapter_number int, snippet string"
    chunks = spark.createDataFrame([(1, [1.0, 0.0], 10, "U", None, 1, 1, "by vector"), (2, [-1.0, 0.0], 11, "U", None, 1, 2, "by graph")], cols)
    chapters = spark.createDataFrame([(10, "b", "U", None, 1, 1), (11, "b", "U", None, 1, 2)], "chapter_id int, book_id string, universe string, series string, book_number int, chapter_number int")
    people = spark.createDataFrame([(11, "s2", 0, "Ana"), (10, "s1", 0, "Bo")], "chapter_id int, scene_id string, scene_index int, display_name string")
    asker = R.Asker(spark, chunks, chapters, people, people.limit(0), lambda q: [1.0, 0.0], models.echo, hybrid=True)
    a = asker.ask("Ana")
    assert a.status == "OK" and [r.chunk_id for r in a.evidence] == [1, 2]
    assert a.text.splitlines() == ["[1] by vector (Book 1, Chapter 1 — featuring: Bo)", "[2] by graph (Book 1, Chapter 2 — featuring: Ana)"]
    asker.embed = lambda q: 1 / 0
    a = asker.ask("Ana")
    assert a.status == "DEGRADED" and [r.chunk_id for r in a.evidence] == [2]
    assert asker.ask("Nobody").status == "SEARCH_FAILED"
    asker.embed, asker.individuals = (lambda q: [1.0, 0.0]), people.drop("display_name")
    assert asker._vector("x", 5, 0.0, None, P.Filters())
    vector = R.Asker(spark, chunks.union(spark.createDataFrame([(3, [0.99, 0.14], 11, "U", None, 1, 2, "third")], cols)), chapters, people, people.limit(0), lambda q: [1.0, 0.0], models.echo)
    assert [r.chunk_id for r in vector.ask("what did ana do").evidence][:1] == [3]


def test_pushing_from_executors(spark, tmp_path):
    from pyspark.sql.types import StructType

    src, out = tmp_path / "in", tmp_path / "out"
    out.mkdir()
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    rows = [(1, 7, "signup", 1), (2, 7, "view", 2), (3, 7, "purchase", 3), (4, 8, "signup", 4)]
    df = spark.createDataFrame([(i, u, k, float(t)) for i, u, k, t in rows], "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds("value")).select("event_id", "user_id", "event_type", "ts", "value").write.parquet(str(src))
    stream = streams.stage_events(spark.readStream.schema(StructType.fromDDL(schema)).parquet(str(src)))
    folder = str(out)

    def connect():
        def send(d):
            with open(f"{folder}/{d['job_id']}", "w") as f:
                f.write(d["status"])

        return send

    q = streams.push_from_executors(streams.job_states(stream, None), connect, str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(120)
    assert {p.name: p.read_text() for p in out.iterdir()} == {"7": "COMPLETED"}
    calls = []
    q = streams.push(streams.job_states(stream.filter("job_id = 8"), None), calls.append, str(tmp_path / "cp2"), once=True, alive=lambda: calls.append("alive"))
    assert q.awaitTermination(120) and calls and set(calls) == {"alive"}


def test_strong_components(spark):
    import random

    r = random.Random(3)
    for _ in range(2):
        edges = {(r.randrange(25), r.randrange(25)) for _ in range(r.randint(10, 45))} | {(40 + i, 41 + i) for i in range(30)} | ({(70, 40)} if r.random() < 0.5 else set()) | {(90, 90)}
        reach = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
        for k in reach:
            for i in reach:
                if k in reach[i]:
                    reach[i] |= reach[k]
        expected = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
        assert {x.node: x.component for x in G.strong_components(spark.createDataFrame(sorted(edges), "from_id long, to_id long")).collect()} == expected
    assert G.strong_components(spark.createDataFrame([], "from_id long, to_id long")).collect() == []


def test_paths_use_no_edge_twice(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (5, 1)]

    def trails(at, end, used, left):
        return sum((1 if b == end else 0) + trails(b, end, used | {(a, b)}, left - 1) for a, b in edges if a == at and (a, b) not in used) if left else 0

    df = spark.createDataFrame(edges, "from_id long, to_id long")
    pairs = [*edges, (1, 3), (4, 1)]
    for most in (1, 3, 6):
        got = {(r.from_id, r.to_id): r.paths for r in G.path_counts(spark.createDataFrame(pairs, "from_id long, to_id long"), df, most).collect()}
        assert got == {p: n for p in pairs if (n := trails(p[1], p[0], frozenset(), most))}
    assert trails(2, 1, frozenset(), 6) == 2


def test_story_order_equals_a_plain_version(spark):
    r = random.Random(12)
    scenes = [(b, f"{b}{i:02}", i // 5, i % 5) for b in "xy" for i in range(40)]
    edges = [(b, *r.sample([s for k, s, *_ in scenes if k == b], 2)) for b in "xy" for _ in range(45)]
    got = {x.scene_id: x.position for x in G.topological(spark.createDataFrame(scenes, "book_id string, scene_id string, chapter_rank int, scene_index int"), spark.createDataFrame(edges, "book_id string, from_id string, to_id string"), "book_id").collect()}
    for book in "xy":
        left, done = sorted((c, i, s) for b, s, c, i in scenes if b == book), []
        while ready := [x for x in left if not any(t == x[2] and f not in done for b, f, t in edges if b == book)]:
            done.append(ready[0][2])
            left.remove(ready[0])
        done += [x[2] for x in left]
        assert {s: i for i, s in enumerate(done)} == {s: p for s, p in got.items() if s[0] == book}


def test_beginnings_and_distances_equal_plain_versions():
    r = random.Random(13)
    for _ in range(1500):
        words = ["a", "ab", "b", "ba", "c."]
        text = "".join(r.choice(words) + r.choice([" ", "  ", "\n", " ", "\u2003"]) for _ in range(r.randint(0, 40)))
        asked = [r.choice(words) for _ in range(r.randint(6, 9))]
        after = r.randint(0, 10)
        before = r.randint(after, max(after, len(text)))
        expected = None
        for n in range(len(asked) - 1, 4, -1):
            hits = [m.start() for m in re.compile(r"\s+".join(map(re.escape, asked[:n]))).finditer(text, after, before)]
            if len(hits) == 1:
                expected = hits[0]
                break
        assert X.Placed(text).beginning(asked, after, before) == expected
        a, b = ("".join(r.choices("abc", k=r.randint(0, 9))) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert X.distance_within(a, b, 3) == (row[-1] if row[-1] <= 3 else None)


def test_anchors_of_a_long_text_share_one_index():
    import time

    r = random.Random(14)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(60_000))
    spots = [m.start() for m in re.finditer(" ", text)][::300]
    anchors = [" ".join(text[s:].split(None, 9)[:8]) + " elsewhere" for s in spots[:150]]
    began, after, index = time.process_time(), 0, X.Placed(text)
    for s, a in zip(spots, anchors):
        hit = X.locate(index, a, after)
        assert hit == (s + 1, "trimmed")
        after = hit[0] + 1
    assert time.process_time() - began < 3


def test_requests_of_a_pair_are_folded_over_batches_with_its_state_alone():
    import pyarrow as pa

    r = random.Random(5)
    kinds = [L.PREFIX + k for k in ("before", "overlaps", "during")]
    rows = []
    for a in range(40):
        for seq in range(r.choice([1, 3, 90])):
            ends = (a, a + 1) if r.random() < 0.5 else (a + 1, a)
            kind = r.choice(kinds)
            rows.append((a, a + 1, *ends, kind, "Explicit", *ends, r.choice([kind, L.PREFIX + "contains"]), 1000 * a + seq))
    names = ["a", "b", *L._REQUEST]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some)], names)
    read = lambda parts, most: [tuple(x.values()) for out in L._fold(parts, most) for x in out.to_pylist()]
    whole = [x for a in range(40) for x in read([batch([y for y in rows if y[0] == a])], 10_000)]
    assert read([batch(rows[at : at + 7]) for at in range(0, len(rows), 7)], 5) == whole
    assert sum(x[6] is None for x in whole) == 40
    assert list(L._fold([])) == []
