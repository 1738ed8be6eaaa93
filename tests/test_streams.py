"""Streams: keyed state over restarts and replays, changed keys only, compaction, and what readers see between steps."""

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import converse
from corpusweave.streaming import flows

CHAPTERS = "textbook_id string, chapter_id string, title string, content string"
DECISIONS = [("run1_merge_0001", "merge", "水肿 together", 0.86), ("run1_keep_0002", "keep", "发热", 0.82), ("run1_keep_0003", "keep", "稳态", 0.82)]


def arrive(spark, rows, schema, inbox):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    return spark.readStream.schema(schema).parquet(inbox)


def test_progress_counts_a_chapter_that_comes_again_once(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    state = lambda: {r["textbook_id"]: (r["done"], r["nodes"]) for r in flows.progressed(spark, out).collect()}

    def run(rows):
        flows.progress(arrive(spark, rows, CHAPTERS, inbox), ["水肿", "发热"], out).awaitTermination()

    run([("a", "c1", "标题一", "水肿"), ("a", "c2", "标题二", "发热 水肿"), ("b", "c1", "标题一", "x")])
    assert state() == {"a": (2, 5), "b": (1, 1)}
    # one chapter again with other content, one anew; the other book isn't touched
    run([("a", "c1", "标题一", "nothing"), ("a", "c3", "标题三", "x"), ("a", "c3", "标题三", "发热")])
    assert state() == {"a": (3, 6), "b": (1, 1)}
    changed = {r["textbook_id"] for r in spark.read.parquet(f"{out}/changes").filter(f"batch = {flows._numbers(spark, out).agg(F.max('n')).first()[0]}").collect()}
    assert changed == {"a"}
    flows.progress(spark.readStream.schema(CHAPTERS).parquet(inbox), ["水肿"], out).awaitTermination()
    assert state() == {"a": (3, 6), "b": (1, 1)}


def test_feedback_over_restarts_and_repeated_messages(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "decision_id string, session_id string, id long, intent string"
    d = spark.createDataFrame(DECISIONS, "decision_id string, action string, reason string, confidence double")

    def run(rows):
        flows.feedback(arrive(spark, rows, schema, inbox), d, out).awaitTermination()
        return {r["decision_id"]: (r["action"], r["reason"], r["confidence"]) for r in flows.decided(spark, out).collect()}

    keep, split = converse.KEEP_NOTE, converse.SPLIT_NOTE
    got = run([("run1_merge_0001", "s", 2, "keep"), ("run1_merge_0001", "s", 1, "split"), ("run1_keep_0002", "s", 3, "query_rag"), (None, "s", 4, "keep")])
    assert got["run1_merge_0001"] == ("keep", "水肿 together" + split + keep, 0.96) and got["run1_keep_0002"] == ("keep", "发热", 0.82)
    got = run([("run1_merge_0001", "s", 2, "keep"), ("run1_keep_0003", "t", 2, "keep"), ("run1_merge_0001", "t", 9, "keep")])
    assert got["run1_merge_0001"][1] == "水肿 together" + split + keep + keep and got["run1_keep_0003"] == ("keep", "稳态" + keep, 0.96)
    assert got == run([("run1_merge_0001", "s", 1, "split")])
    whole = spark.read.parquet(inbox).dropDuplicates().select("decision_id", F.struct("session_id", "id").alias("id"), "intent")
    want = {r["decision_id"]: (r["action"], r["reason"], r["confidence"]) for r in converse.apply_feedback(d, whole).collect()}
    assert got == want


def test_messages_with_a_time_are_forgotten_when_they_can_not_come_again(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "decision_id string, session_id string, id long, intent string, ts timestamp"
    d = spark.createDataFrame(DECISIONS, "decision_id string, action string, reason string, confidence double")
    from datetime import datetime

    at = lambda day, hour=0: datetime(2024, 1, day, hour)

    def run(rows):
        flows.feedback(arrive(spark, rows, schema, inbox), d, out, late="1 day").awaitTermination()
        return {r["decision_id"]: r["reason"] for r in flows.decided(spark, out).collect()}["run1_keep_0003"]

    note = converse.KEEP_NOTE
    assert run([("run1_keep_0003", "s", 1, "keep", at(1))]) == "稳态" + note
    assert run([("run1_keep_0003", "s", 1, "keep", at(1, 5)), ("run1_keep_0003", "s", 2, "keep", at(1, 9))]) == "稳态" + 2 * note
    # time goes on for another decision; the first one's messages expire, and too late ones don't count
    run([("run1_keep_0002", "s", 7, "keep", at(9))])
    assert run([("run1_keep_0003", "s", 1, "keep", at(1))]) == "稳态" + 2 * note
    assert run([("run1_keep_0003", "s", 2, "keep", at(10))]) == "稳态" + 3 * note


def test_raw_messages_are_routed_and_resolved_in_the_stream(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, id long, content string"
    d = spark.createDataFrame(DECISIONS, "decision_id string, action string, reason string, confidence double")

    def run(rows):
        flows.turns(arrive(spark, rows, schema, inbox), d, out).awaitTermination()
        return {r["decision_id"]: (r["action"], r["reason"]) for r in flows.decided(spark, out).collect()}

    # splitting prefers merges though the word is in another decision
    got = run([("s", 1, "保留 [[稳态]]"), ("s", 2, "请分开 发热"), ("s", 3, "什么是水肿")])
    assert got == {"run1_merge_0001": ("keep", "水肿 together" + converse.SPLIT_NOTE), "run1_keep_0002": ("keep", "发热"), "run1_keep_0003": ("keep", "稳态" + converse.KEEP_NOTE)}
    got = run([("t", 1, "保留 run1_keep_0002")])
    assert got["run1_keep_0002"] == ("keep", "发热" + converse.KEEP_NOTE) and got["run1_keep_0003"][1] == "稳态" + converse.KEEP_NOTE


def test_changes_are_drawn_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "COMPACT", 2)
    path = str(tmp_path / "log")
    want = {}
    for n in range(9):
        rows = [(k, n * 10 + k) for k in range(n % 3, 5, 2)]
        want |= dict(rows)
        flows._change(spark.createDataFrame(rows, "k int, v int"), path, n, ["k"])
        flows._change(spark.createDataFrame(rows, "k int, v int"), path, n, ["k"])  # a batch may run again
        assert {r["k"]: r["v"] for r in flows.latest(spark, path, ["k"]).collect()} == want
    kept = sorted(int(f.name.split("=")[1]) for f in (tmp_path / "log/changes").iterdir() if "=" in f.name)
    assert kept[0] >= 4 and kept[-1] == 8 and len([f for f in (tmp_path / "log/snapshots").iterdir() if f.name.startswith("batch=")]) <= 2


def test_a_reader_between_the_steps_of_ingest_sees_the_old_version(spark, tmp_path, monkeypatch):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema, long = "filename string, content string, modified int", "words of a text that go on " * 9

    def run(rows):
        flows.ingest(arrive(spark, rows, schema, inbox), out).awaitTermination()

    run([("a.md", f"# One\n{long}\n# Two\n{long}", 1)])
    before = sorted(r["chunk_id"] for r in flows.ingested(spark, out, "chunks").collect())
    seen, done = [], flows._done

    def look(spark_, path, n):
        seen.append((sorted(r["chunk_id"] for r in flows.ingested(spark, out, "chunks").collect()), flows.ingested(spark, out, "textbooks").count()))
        done(spark_, path, n)

    monkeypatch.setattr(flows, "_done", look)
    run([("a.md", f"# Three\n{long}\n# Four\n{long} new", 2), ("b.md", long, 2)])
    assert seen == [(before, 1)]
    assert {r["title"] for r in flows.ingested(spark, out, "chapters").collect()} == {"Three", "Four", "全文"}


def test_a_broken_batch_runs_again(spark, tmp_path, monkeypatch):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "c1", "标题一", "水肿"), ("b", "c1", "标题一", "x")]
    stream = arrive(spark, rows, CHAPTERS, inbox)
    done = flows._done
    monkeypatch.setattr(flows, "_done", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        flows.progress(stream, ["水肿"], out).awaitTermination()
    monkeypatch.setattr(flows, "_done", done)
    flows.progress(spark.readStream.schema(CHAPTERS).parquet(inbox), ["水肿"], out).awaitTermination()
    assert {r["textbook_id"]: (r["done"], r["nodes"]) for r in flows.progressed(spark, out).collect()} == {"a": (1, 2), "b": (1, 1)}
