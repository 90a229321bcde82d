"""Queries over whole tables that have no SQL, against brute force on a small fixture."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from narrata import corpus, queries
from narrata.operators import search as S

R = random.Random(3)
NAMES = ["Al", "Eder", "Ederin", "Mara", "Marabel", "Josefin", "Bo", "Quillon"]
DOCS = [(i, "\n".join(f"{R.choice(NAMES)} met {R.choice(NAMES)} at line {j} of {i} today" for j in range(R.choice([1, 4, 25]))) + "\n \nEnd Quill.") for i in range(47, 62)]
ITEMS = [(1, "Who is MARABEL, and al?"), (2, "nobody"), (3, "Eder's Bo")]
EVENTS = [(i, i % 97, float(R.choice([1, 14, 16, 19])), R.choice(["view", "purchase"])) for i in range(300)]
VECTORS = [(i, "ab"[i % 2], [R.gauss(0, 1) for _ in range(3)]) for i in range(45)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(EVENTS, "event_id long, user_id long, value double, event_type string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, label string, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def scenes():
    return [(i, j, line) for i, t in DOCS for j, line in enumerate(t.split("\n")) if line.strip()]


def mentions():
    return [(i, name.lower()) for i, _, line in scenes() for name in re.findall("[A-Z][a-z]+", line)]


def test_names(spark, folder):
    names = {n for _, n in mentions()}
    expected = {(i, w) for i, t in ITEMS for w in re.findall("[a-z0-9]+", t.lower()) if w in names}
    got = [(r.item_id, r.name) for r in queries.known_names(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and (1, "al") in expected


def test_scenes(spark, folder):
    expected = []
    for i, _ in DOCS:
        at = sorted(j * 37 % 1009 for c, j, _ in scenes() if c == i)
        expected += [(i, n, a, b) for n, (a, b) in enumerate(zip(at, at[1:] + [5000]))]
    got = [(r.chapter_id, r.scene_number, r.start_offset, r.end_offset) for r in queries.scene_bounds(spark, folder).collect()]
    assert sorted(got) == sorted(expected)
    placed = Counter(r.chapter_id for r in queries.placed_scenes(spark, folder).collect())
    assert placed == Counter(i for i, _, _ in scenes())


def test_individuals(spark, folder):
    by = Counter((i, n[:4]) for i, n in mentions())
    got = {(r.scope, r.normalized_name[:4]): r.mention_count for r in queries.chapter_individuals(spark, folder).collect()}
    assert got == by
    book = {r.chapter_id: r.book_id for r in corpus.chapters(spark, folder).collect()}
    chapters, total = Counter(), Counter()
    for (i, stem), n in by.items():
        chapters[book[i], stem] += 1
        total[book[i], stem] += n
    rows = queries.book_individuals(spark, folder).collect()
    assert {(r.scope, r.stem): (r.chapters, r.mentions) for r in rows} == {k: (n, total[k]) for k, n in chapters.items()}


def test_links(spark, folder):
    groups = defaultdict(list)
    for i, w, v, _ in EVENTS:
        groups[w, i // 2000].append((i, v))
    expected = {}
    for rows in groups.values():
        if (best := max(v for _, v in rows) / 20) >= 0.75:
            expected |= {(a, b): best for a, _ in rows for b, _ in rows if a < b and a % 5 and b % 5}
    assert {(r.a, r.b): r.confidence for r in queries.coreference_links(spark, folder).collect()} == expected and any(a % 97 >= 40 for a, _ in expected)


def test_catalog(spark, folder):
    unit = {i: (k, np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float))) for i, k, v in VECTORS}
    expected = {}
    for i, (k, v) in unit.items():
        near = sorted((round(1 - float(v @ w), 6) + 0.0, j) for j, (kind, w) in unit.items() if kind == k)
        expected[i] = [j for d, j in near if d < 0.9][:3]
    e = corpus.table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    catalog = e.select(F.col("vec_id").alias("definition_id"), F.col("label").alias("definition_kind"), F.col("embedding").alias("definition_embedding"))
    got = defaultdict(list)
    for r in sorted(S.catalog_matches(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("kind"), "embedding"), catalog, 0.9).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.definition_id)
    assert got == expected
    few = [r.definition_id for r in sorted(queries.catalog_matches(spark, folder).collect(), key=lambda r: r["rank"])]
    assert few == expected[0]
    assert [(r.query_id, r.definition_id, r.how) for r in queries.catalog_resolve(spark, folder).collect()] == [(0, "1", "EXACT")]


def test_back_paths(spark, folder):
    step, expected = {u: (u * 7 + 3) % 97 for _, u, _, _ in EVENTS}, set()
    for a, b in step.items():
        at = b
        for _ in range(6):
            at = step[at]
            if at == a:
                expected.add((a, b))
    assert {tuple(r) for r in queries.edges_with_back_path(spark, folder).select("from_id", "to_id").collect()} == expected
