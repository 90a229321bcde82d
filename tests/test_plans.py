import datetime as dt

import pytest

from narrata.plans import dag as D
from narrata.plans import jobs as J
from narrata.sources import files
from narrata.streaming import jobs as streams


def test_dag():
    g = D.StageDag()
    assert g.roots() == ["SCENE_SEGMENTATION"] and len(g.children_of(D.ROOT)) == 7 and len(g.parents_of(D.LAST)) == 7
    assert not g.unreachable() and g.downstream(D.ROOT) == set(D.STEPS) - {D.ROOT} and len(D.STEPS) == 17
    assert g.downstream("CHUNKING") == {"EMBEDDING", "INGESTION_COMPLETE"}
    assert g.deepest_first(["CHUNKING", D.LAST, D.ROOT]) == [D.LAST, "CHUNKING", D.ROOT]
    assert D.segment_of("BOOK_EVENT_CANDIDATE_GENERATION") == "book-event-candidate-generation"


def test_barrier(spark):
    rows = [(1, D.ROOT, "COMPLETED", 1), (1, "CHUNKING", "PENDING", 0), (1, "EMBEDDING", "PENDING", 0), (2, D.ROOT, "PENDING", 0), (3, D.ROOT, "FAILED", 1), (3, "CHUNKING", "PENDING", 0), (4, D.ROOT, "SKIPPED", 1), (4, "CHUNKING", "PENDING", 2)]
    df = spark.createDataFrame(rows, "job_id int, step string, status string, attempts int")
    edges = D.StageDag().frame(spark)
    assert {tuple(r) for r in D.ready(df, edges).collect()} == {(1, "CHUNKING"), (2, D.ROOT), (4, "CHUNKING")}
    out = {(r.job_id, r.step): (r.status, r.attempts) for r in D.trigger(df, edges).collect()}
    assert out[4, "CHUNKING"] == ("TRIGGERED", 3) and out[3, "CHUNKING"] == ("PENDING", 0)
    again = {(r.job_id, r.step): r.status for r in D.rerun(df, 1, D.ROOT).collect()}
    assert again[1, D.ROOT] == "TRIGGERED" and again[1, "CHUNKING"] == "PENDING" and again[3, D.ROOT] == "FAILED"


def test_recovery(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "A", "TRIGGERED", t, 1), (2, "A", "RUNNING", t, 2), (3, "A", "RUNNING", t, 3), (4, "A", "TRIGGERED", t + dt.timedelta(seconds=590), 1), (5, "A", "COMPLETED", t, 1)]
    df = spark.createDataFrame(rows, "job_id int, step string, status string, triggered_at timestamp, attempts int")
    assert {(r.job_id, r.new_status) for r in D.recover(df, "2024-01-01 00:10:00").collect()} == {(1, "TRIGGERED"), (2, "TRIGGERED"), (3, "FAILED")}


def test_status(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "COMPLETED", t), (1, 2, "RUNNING", t), (2, 1, "FAILED", t), (2, 2, "PENDING", None), (3, 1, "SKIPPED", t), (3, 2, "COMPLETED", t)]
    got = {r.job_id: (r.status, r.progress_percent) for r in J.summaries(spark.createDataFrame(rows, "job_id int, step int, status string, triggered_at timestamp"), 2).collect()}
    assert got == {1: ("2", 50), 2: ("FAILED", -1), 3: ("COMPLETE", 100)}
    with pytest.raises(ValueError):
        J.by_status(spark.createDataFrame([("x",)], "status string"), "nonsense!")


def test_dispatcher():
    d = D.Dispatcher()
    d.register("CHUNKING", lambda x: x + 1)
    d.register("EMBEDDING", lambda: 1 / 0)
    assert d.run("CHUNKING", 1) == ("COMPLETED", 2) and d.run("EMBEDDING")[0] == "FAILED" and d.run(D.ROOT)[0] == "SKIPPED"
    for bad in ("CHUNKING", "NOPE"):
        with pytest.raises(ValueError):
            d.register(bad, print)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿éa line\r\nnext\r \n".encode().replace(b"\xef\xbb\xbf", b""))
    (tmp_path / "b.md").write_text("short")
    (tmp_path / "c.pdf").write_text("a longer text here")
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.txt").write_bytes(b"x" * (files.MOST_BYTES + 1))
    assert [(r.file_name, r.text) for r in files.read_chapters(spark, str(tmp_path)).collect()] == [("a.txt", "éa line\nnext")]
    assert {tuple(r) for r in files.rejected(spark, str(tmp_path)).collect()} - {("d.txt", "EMPTY")} == {("c.pdf", "EXTENSION"), ("e.txt", "TOO_LARGE")}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "book_id int, v string")
    out = str(tmp_path / "out")
    files.write_scope(df, out, "book_id")
    files.write_scope(spark.createDataFrame([(2, "c")], "book_id int, v string"), out, "book_id")
    assert {(r.book_id, r.v) for r in files.read_catalog(spark, out).collect()} == {(1, "a"), (2, "c")}


def test_streaming_job_states(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t, "TRIGGERED"), (1, 2, t + dt.timedelta(seconds=1), "RUNNING"), (1, 3, t + dt.timedelta(seconds=2), "COMPLETED"), (2, 4, t, "COMPLETED"), (2, 5, t + dt.timedelta(seconds=9), "TRIGGERED")]
    spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, event_id long, ts timestamp, status string").parquet(str(tmp_path / "in"))
    sent = []
    q = streams.push(streams.job_states(stream, None), sent.append, str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(60)
    assert [(r["job_id"], r["status"], r["events"], r["refused"]) for r in sent] == [(1, "COMPLETED", 3, 0)]
    counts = streams.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    assert counts.awaitTermination(60)
    assert "n" in spark.table("counts").columns
