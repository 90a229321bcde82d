import random

import corpus_pipeline
import pytest
from narrata.llm import op9_decontaminate, op10_secrets
from narrata.llm.op7_toxicity import toxicity
from test_dedup import brute_near


@pytest.fixture(scope="module")
def folder(spark, make_docs, prose_of, tmp_path_factory):
    """A small folder of tables with planted cases; returns it and its documents."""
    r = random.Random(12)
    bench = [(i, prose_of(r, 30)) for i in range(4)]
    rows, labels = [], []
    for i in range(420):
        w, bad = prose_of(r, r.randint(40, 100)).split(), r.random() < 0.3
        for j in range(0, len(w), 20) if bad else ():
            w[j] = "grumpf" + r.choice(["", "el", "ed"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    clean = [t for (i, t), (_, _, bad) in zip(rows, labels) if not bad]
    rows += [(1000 + i, t) for i, t in enumerate(clean[:10])]
    rows += [(1100 + i, t + " tail") for i, t in enumerate(clean[10:20])]
    rows += [(1200 + i, prose_of(r, 30) + "\n" + t + " " + prose_of(r, 30)) for i, t in bench]
    rows += [(1300, prose_of(r, 40) + " token = ghp_aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0dF3gH6 " + prose_of(r, 9)), (1301, None), (1302, ""), (None, "loose words here")]
    d = tmp_path_factory.mktemp("tables")
    make_docs(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def test_pipeline(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "sentencepiece"]
    texts = dict(rows)
    rejected = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.predicted}
    texts = {i: t for i, t in texts.items() if i not in rejected}
    classes = brute_near(list(texts.items()), 80)
    texts = {i: t for i, t in texts.items() if i is None or classes[i][1] == i}
    items = [op9_decontaminate.folded(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(x in op9_decontaminate.folded(t) for x in items)}
    out, stage_docs = corpus_pipeline.run(spark, d).collect(), docs
    assert {r.doc_id for r in out} == set(texts) and len(out) == len(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, d)
        assert stage_docs.columns == docs.columns, name
    masked = {r.doc_id: r for r in stage_docs.collect()}
    assert "<SECRET>" in masked[1300].text and masked[1300].n_chars == len(masked[1300].text)
    for r in out:
        t = masked[r.doc_id].text or ""
        assert r.lossless and r.n_ids == len(r.ids) and (r.n_ids > 0) == bool(t)
        assert not [s for s in op10_secrets.find([t.encode()], op10_secrets.model())[0] if s[1] == 0]
    assert not {1000, 1109, 1200, 1203} & set(texts) and {1300, 1301, 1302, None} <= set(texts)


def test_empty_tables_and_repeated_rows(spark, make_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    again = "some words that stand here twice over"
    make_docs([(1, again), (1, again), (2, None), (None, ""), (None, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_ids > 0) for r in out) == [(0, False), (0, False), (1, True), (2, False)]
    make_docs([]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
