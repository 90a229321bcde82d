import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata import corpus, further_queries
from narrata.operators import index as V
from narrata.operators import search as S

FOLDER = os.environ.get("NARRATA_TABLES", "/root/testdata/sf0.001")
ROWS = "id long, embedding array<double>, cell int, unit string, part string, score int"


@pytest.fixture(scope="module")
def make(spark):
    """Rows with columns of clashing names besides."""
    return lambda pairs: spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, "u", "p", 2) for i, v in pairs], ROWS).select("id", "embedding")


def clustered(n, seed, dim=8, centres=6):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim)) * 3
    return [(i, (c[i % centres] if i % 4 else c[0]) + r.normal(size=dim)) for i in range(n)]


def brute(rows, k):
    good = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) == 8 and np.linalg.norm(v) > 0]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    s = np.round((1 + u @ u.T) / 2, 6)
    return {q: sorted(((-s[a, b], i) for b, (i, _) in enumerate(good)))[:k] for a, (q, _) in enumerate(good)}


def test_exact_search_equals_brute_force(spark, make):
    rows = clustered(300, 1) + [(1000 + i, [1.0] + [0.0] * 7) for i in range(30)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0, 2.0]), (2003, [])]
    index = V.build(make(rows), cells=9, part_rows=20)
    assert index.rows == 330 and index.dimension == 8 and max(index.parts) > 1
    got = {}
    for r in V.search(index, make(rows).withColumnRenamed("id", "query"), 7).collect():
        got.setdefault(r["query"], []).append((-r.score, r.id))
    expected = brute(rows, 7)
    assert {q: sorted(x) for q, x in got.items()} == expected


def test_probes_prune_the_scan(spark, make):
    rows = clustered(400, 2)
    index = V.build(make(rows), cells=16)
    cells = index.probe(rows[5][1], 2)
    found = index.nearest(rows[5][1], 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and len(cells) == 2
    assert {r.cell for r in index.table(cells).select("cell").distinct().collect()} <= set(cells)
    assert found.first().id == 5 and found.first().score == 1.0
    read = index.table(cells).select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len(read) < 16 and all(any(f"cell={c}/" in r.f for c in cells) for r in read)


def test_recall_of_the_probes(spark, make):
    rows = clustered(600, 3)
    index = V.build(make(rows), cells=24)
    probes = V.probes_for(index, 10)
    assert 1 <= probes < 24
    truth, hits, n = brute(rows, 10), 0, 0
    for r in V.search(index, make([x for x in rows if x[0] % 10 == 0]).withColumnRenamed("id", "query"), 10, probes).collect():
        hits += any(i == r.id for _, i in truth[r["query"]])
    n = 10 * 60
    assert hits / n >= 0.9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["visible_chunks_indexed", "event_neighbours_indexed"])
def test_recall_on_the_tables(spark, name):
    got = {tuple(r)[:2] if name.startswith("v") else (r.source, r.target) for r in getattr(further_queries, name)(spark, FOLDER).collect()}
    if name.startswith("v"):
        exact = {tuple(r)[:2] for r in further_queries.visible_chunks_bounded(spark, FOLDER).collect()}
    else:
        events = further_queries._events(spark, FOLDER)
        exact = {(r.source, r.target) for r in S.neighbours(events, 8, 0.55, None, "oversample").filter("source % 100 = 0").collect()}
    assert len(exact) == 0 or len(got & exact) / len(exact) >= 0.9


def test_refresh(spark, make, tmp_path):
    rows = clustered(200, 4)
    path = str(tmp_path / "i")
    first = V.build(make(rows), path, cells=8)
    assert V.refresh(spark, path, make(rows))[1] == "kept"
    more = rows + [(5000 + i, v + 0.01) for i, v in rows[:40]]
    index, done = V.refresh(spark, path, make(more))
    assert done == "appended" and index.rows == 240 and V.load(spark, path).version == 1
    got = {r.id for r in V.search(index, make([more[210]]).withColumnRenamed("id", "query"), 2).collect()}
    assert got == {5010, 10}
    r = np.random.default_rng(9)
    away = more + [(9000 + i, r.normal(size=8)) for i in range(200)]
    index, done = V.refresh(spark, path, make(away))
    assert done == "rebuilt" and index.rows == 440 and index.generation != first.generation
    wider = [(i, list(v) + [0.5]) for i, v in rows]
    index, done = V.refresh(spark, path, make(wider), dimension=9)
    assert done == "rebuilt" and index.dimension == 9 and index.table().count() == 200


def test_empty_index(spark, make):
    index = V.build(make([]))
    assert index.rows == 0 and V.search(index, make([(1, [1.0])]).withColumnRenamed("id", "query"), 3).collect() == []
    assert V.probes_for(index, 3) == 1


def test_a_query_travels_once_a_bin(spark, make):
    rows = clustered(300, 5)
    index = V.build(make(rows), cells=16)
    asked = make(rows).withColumnRenamed("id", "query").withColumn("worst", F.lit(None).cast("double"))
    assert V._sent(asked, index, V._reachable, V._bins(index)).count() == 300


def test_bins_blocks_and_tiles_change_nothing(spark, make, monkeypatch):
    monkeypatch.setattr(V, "BIN_ROWS", 50)
    monkeypatch.setattr(V, "LEAST_BLOCK", 40)
    rows = clustered(300, 6) + [(2000 + i, [1.0] + [0.0] * 7) for i in range(40)]
    index = V.build(make(rows), cells=9, part_rows=20)
    assert max(b.max() for b in V._bins(index)) > 3
    got = {}
    for r in V.search(index, make(rows).withColumnRenamed("id", "query"), 7).collect():
        got.setdefault(r["query"], []).append((-r.score, r.id))
    assert {q: sorted(x) for q, x in got.items()} == brute(rows, 7)
    u = V.unit([v for _, v in rows])
    order, cell = np.random.default_rng(1).permutation(len(u)), np.arange(len(u)) // 30
    mask = np.random.default_rng(2).random((len(u), cell.max() + 1)) < 0.8
    a, b, s = V._best(u, np.full(len(u), -1.0), mask, u, cell, order, 5, tile=64)
    score = np.where(mask[:, cell], np.round((1 + u @ u.T) / 2, 6), -1)
    assert {q: sorted(zip(-s[a == q], order[b[a == q]])) for q in range(len(u))} == {q: sorted(zip(-score[q], order))[:5] for q in range(len(u))}
