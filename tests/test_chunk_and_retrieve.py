import math
import random
import re

import numpy as np

from corpusweave.operators import chunk, converse, encode, evaluate, retrieve, words
from corpusweave.sources import readers, tables
from corpusweave.streaming import flows
from pyspark.sql import functions as F


def one(text, **options):
    return chunk.windows([text], **options)[0]


def test_windows_break_where_they_may():
    assert one("x" * 700) == [(0, "x" * 700)]
    assert [s for s, _ in one("x" * 701)] == [0, 610]
    early, late = "x" * 385 + "\n" + "y" * 400, "x" * 386 + "\n" + "y" * 400
    assert one(early)[0][1] == early[:700] and one(late)[0][1] == "x" * 386
    for mark in ("\n##", "\n\n", "。", "；", "\n"):
        text = "x" * 400 + mark + "y" * 500
        assert [s for s, _ in one(text)][1] == 400 + len(mark) - 90
    assert one("  ") == [(0, "")] and chunk.windows([]) == []


def plain_windows(text, size=700, overlap=90):
    """The rules one window after the other, as a table of all possible ends."""
    body = re.sub(r"\n{3,}", "\n\n", text).strip()
    ends = {a: min(len(body), a + size) for a in range(max(1, len(body)))}
    for a, full in ends.items():
        if full < len(body):
            for mark in chunk.BREAKS:
                fits = [p for p in range(a, full - len(mark) + 1) if body.startswith(mark, p) and p - a >= 0.55 * size]
                if fits:
                    ends[a] = fits[-1] + len(mark)
                    break
    a, out = 0, []
    while True:
        if body[a : ends[a]].strip() or len(body) <= size:
            out.append((a, body[a : ends[a]].strip()))
        if ends[a] >= len(body):
            return out
        a = max(ends[a] - overlap, a + 1)


def test_windows_of_a_batch_match_the_rules():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc。；\n# ") for _ in range(rnd.randrange(600))) for _ in range(60)] + ["", "\0\n\n" * 40]
    for size, overlap in ((60, 9), (50, 60)):
        assert chunk.windows(texts, size, overlap) == [plain_windows(t, size, overlap) for t in texts]


def test_sections(spark):
    text = "lead " * 30 + "\n## A  b\nx\n# not\n#### C\ny\n##### no"
    rows = [(1, text), (2, "short\n## A\nx"), (3, "no heading\n##"), (4, None), (5, "## only　title　\n\n\n"), (6, "a\u2028## b c\n### 标题 x\n正文")]
    got = {r["k"]: [(s["title"], s["text"]) for s in r["s"]] for r in spark.createDataFrame(rows, "k int, t string").select("k", chunk.sections(F.col("t")).alias("s")).collect()}
    assert [t for t, _ in got[1]] == ["", "A b", "C"] and got[1][2][1] == "#### C\ny\n##### no"
    assert got[2] == [("A", "## A\nx")] and got[3] == [("", rows[2][1])] and got[4] == [("", "")]
    assert got[5] == [("only title", "## only　title")]
    assert got[6] == [("标题 x", "### 标题 x\n正文")]


def test_index_is_replaced_and_survives_its_encoder(spark, tmp_path):
    c = spark.createDataFrame([("c1", "b", "some text"), ("c2", "b", "other")], "chunk_id string, textbook_id string, text string")

    def broken(rows):
        raise RuntimeError("no model here\nat all")

    path = str(tmp_path / "i")
    first = chunk.write_index(c, path, lambda rows: encode.encode(rows, "text"), "hashing").first()
    assert (first["chunks"], first["embedded"], first["width"], first["encoder"], first["error"]) == (2, 2, 512, "hashing", None)
    second = chunk.write_index(c.limit(1), path, broken, "hashing").first()
    assert (second["chunks"], second["embedded"], second["status"], second["error"]) == (1, 0, "ready", "no model here")
    assert spark.read.parquet(path + "/index").count() == 1


def test_tokens_agree_with_the_encoder(spark):
    for text, want in (("Ab c 稳态调节 x1 été", ["ab", "稳态", "态调", "调节", "x1"]), ("一", []), ("", [])):
        assert spark.createDataFrame([(text,)], "t string").select(words.pair_tokens(F.col("t")).alias("y")).first()["y"] == want == words.pair_words([text])[0]


def test_bm25_against_plain_formula(spark):
    docs = {"c1": ["aa", "bb", "aa"], "c2": ["aa", "cc"], "c3": ["aa"], "c4": ["dd", "dd", "ee"]}
    tokens = spark.createDataFrame(list(docs.items()), "chunk_id string, tokens array<string>")
    q = spark.createDataFrame([(1, "aa bb bb"), (2, "zz"), (3, "a")], "question_id int, question string")
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    score = lambda d: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ("aa", "bb", "bb"))
    got = {(r["question_id"], r["chunk_id"]): r["bm25"] for r in retrieve.bm25_scores(tokens, q).collect()}
    assert got == {(1, c): round(score(d), 6) for c, d in docs.items() if round(score(d), 6)}


def test_vector_top_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((50, 6))
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(50)] + [(99, None)], "chunk_id long, embedding array<double>")
    asked = rows.filter("chunk_id < 9").select(F.col("chunk_id").alias("question_id"), "embedding")
    for block in (4, 1000):
        got = {(r["question_id"], r["vector_rank"]): r["chunk_id"] for r in retrieve.vector_top(rows, asked, 5, block).collect()}
        assert got == {(i, k + 1): int(j) for i in range(9) for k, j in enumerate(np.argsort(-np.round(v @ v[i], 6), kind="stable")[:5])}


def test_fusion_ties(spark):
    vec = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "question_id int, chunk_id string, vector double, vector_rank int")
    lex = spark.createDataFrame([(1, "c", 5.0, 1), (1, "b", 4.0, 2)], "question_id int, chunk_id string, bm25 double, bm25_rank int")
    assert [r["chunk_id"] for r in retrieve.fuse(vec, lex).orderBy("rank").collect()] == ["b", "a", "c"]


def test_answers_refuse_without_hits(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "question_id int, question string")
    hits = spark.createDataFrame([(1, "c1", 1, 0.03, "B", "Ch", 4, "line\nnext")], "question_id int, chunk_id string, rank int, score double, textbook_title string, chapter_title string, page_start int, text string")
    got = {r["question_id"]: r for r in retrieve.answers(q, hits).collect()}
    assert got[1]["answer"].endswith("- line next [B, Ch, 第4页]") and got[1]["source_chunks"] == ["c1"]
    assert got[2]["answer"] == retrieve.REFUSAL and got[2]["source_chunks"] == []
    cases = spark.createDataFrame([(1, "fact", ["nope", "next"], ["B"]), (2, "fact", ["x"], ["B"])], "id int, type string, expected_keywords array<string>, expected_textbooks array<string>")
    assert [(r["keyword_hit"], r["book_hit"], r["top1"]) for r in evaluate.eval_cases(cases, hits).orderBy("id").collect()] == [(True, True, "B"), (False, False, "")]


def test_intents_and_lookup(spark):
    m = spark.createDataFrame([("s", 1, "为什么合并 run1_merge_0002"), ("s", 2, "保留 [[水肿]]"), ("s", 3, "请拆开它"), ("s", 4, "what?"), ("s", 5, "好")], "session_id string, id long, content string")
    assert [r["intent"] for r in converse.intents(m).orderBy("id").collect()] == ["explain_decision", "keep", "split", "query_rag", "summarize_integration"]
    assert converse.intents(m, has_decision=False).filter("id = 1").first()["intent"] == "query_rag"
    d = spark.createDataFrame([("run1_keep_0001", "keep", "发热", 0), ("run1_merge_0002", "merge", "x", 1), ("run1_keep_0003", "keep", "关于水肿", 2)], "decision_id string, action string, haystack string, position long")
    got = {r["id"]: r["decision_id"] for r in converse.decision_lookup(m, d).collect()}
    assert got == {1: "run1_merge_0002", 2: "run1_keep_0003", 3: "run1_keep_0001", 4: "run1_keep_0001", 5: "run1_keep_0001"}


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    delta = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, version int")
    assert sorted(tuple(r)[:2] for r in tables.upsert(base, delta, ["id"], "version").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    blobs = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(tables.vector_to_blob("v").alias("b")).select("b", tables.blob_to_vector("b").alias("v"))
    assert [r["v"] for r in blobs.collect()] == [[1.5, -2.0], None]


def test_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/My Book.md").write_text("# a\ntext")
    (tmp_path / "e.jsonl").write_text('{"id": "q1", "type": "fact", "question": "x", "expected_keywords": ["k"], "expected_textbooks": []}\n\n')
    row = readers.read_corpus(spark, str(tmp_path / "c")).first()
    assert (row["title"], row["content"]) == ("My Book", "# a\ntext")
    assert readers.read_eval_set(spark, str(tmp_path / "e.jsonl")).count() == 1


def test_click_stream_drops_repeated_events(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7), (1, "2024-01-01 00:00:00", 7), (1, "2024-01-01 03:00:00", 7), (2, "2024-01-01 01:00:00", 7), (3, "2024-01-01 02:00:00", 8)], "event_id long, ts string, id long").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    flows.clicks(events, str(tmp_path / "out")).awaitTermination()
    assert dict(flows.latest(spark, str(tmp_path / "out")).collect()) == {7: 2, 8: 1}


def test_ingest_replaces_files_that_come_again(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    long = "words of a text that go on " * 9
    schema = "filename string, content string, modified int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        for _ in range(2):  # the second run finds nothing new
            flows.ingest(spark.readStream.schema(schema).parquet(inbox), out).awaitTermination()

    arrive([("a book.md", f"# One\n{long}\n# Two\n{long}", 1), ("b.exe", long, 1), ("c.txt", long, 1), ("d.txt", None, 1)])
    books = {r["title"]: (r["parse_status"], r["error_message"]) for r in flows.ingested(spark, out, "textbooks").collect()}
    assert books == {"a book": ("done", None), "b": ("failed", "unsupported format: exe"), "c": ("done", None), "d": ("failed", "no text")}
    assert flows.ingested(spark, out, "chunks").select("chunk_id").distinct().count() == flows.ingested(spark, out, "chunks").count() == 3
    arrive([("a book.md", f"# Three\n{long}\n# Four\n{long} end", 9), ("c.txt", " ", 9), ("a book.md", "older", 8)])
    assert {r["title"] for r in flows.ingested(spark, out, "chapters").collect()} == {"Three", "Four"}
    assert flows.ingested(spark, out, "chunks").count() == 2 and flows.ingested(spark, out, "textbooks").count() == 4


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x y.md").write_text("# One\n" + "text " * 60)
    flows.ingest(readers.stream_corpus(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert [r["textbook_title"] for r in flows.ingested(spark, str(tmp_path / "out"), "chunks").collect()] == ["x y"]


def test_slices_are_written_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_slices(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string"), path, "k")
    tables.write_slices(spark.createDataFrame([(2, "d")], "k int, v string"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "d")]


def test_fusion_has_the_scores_of_chunks_outside_a_list(spark):
    vec = spark.createDataFrame([(1, "a", 0.9, 1)], "question_id int, chunk_id string, vector double, vector_rank int")
    lex = spark.createDataFrame([(1, "b", 4.0, 1)], "question_id int, chunk_id string, bm25 double, bm25_rank int")
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 4.0)], "question_id int, chunk_id string, bm25 double")
    index = spark.createDataFrame([("a", [0.9, 0.1]), ("b", [0.25, 0.5])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, embedding array<double>")
    got = {r["chunk_id"]: (r["rank"], r["vector"], r["bm25"]) for r in retrieve.fuse(vec, lex, scores, index=index, questions=asked).collect()}
    assert got == {"a": (1, 0.9, 0.5), "b": (2, 0.25, 4.0)}


def test_encoder_by_batches_is_the_plain_one():
    texts = ["Ab ab 稳态调节 x1", "", "zz", "ab " * 9]
    got = encode.hashing_encoder(texts)
    for t, v in zip(texts, got):
        plain = np.zeros(512)
        for token in words.pair_words([t])[0]:
            at, sign = encode._place(token, 512)
            plain[at] += sign
        assert np.allclose(v, plain / (np.linalg.norm(plain) or 1))
    assert encode.hashing_encoder([]).shape == (0, 512)
