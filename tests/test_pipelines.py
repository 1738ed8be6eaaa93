from corpusweave.jobs import pipelines


def test_books_to_decisions_and_answers(spark):
    body = "水肿是指组织间隙液体过多。" * 12
    chapters = spark.createDataFrame(
        [("A", "ch_001", "第一章 水肿", 1, 3, body), ("B", "ch_001", "第一章 水肿", 5, 9, body), ("B", "ch_002", "第二章 稳态", 10, 12, "稳态是人体的平衡。" * 20), ("B", "ch_003", "空", 13, 13, " ")],
        "textbook_id string, chapter_id string, title string, page_start int, page_end int, content string",
    )
    books = spark.createDataFrame([("A", "甲书", "done", 1000), ("B", "乙书", "done", 2000)], "textbook_id string, title string, parse_status string, total_chars long")
    answers = spark.createDataFrame([("B", "ch_002", '{"nodes": [{"name": "稳态"}]}')], "textbook_id string, chapter_id string, response string")
    nodes, edges = pipelines.extract_graph(chapters, answers, ("水肿",))
    assert {(n["textbook_id"], n["chapter_id"], n["name"]) for n in nodes.collect()} >= {("A", "ch_001", "水肿"), ("B", "ch_001", "水肿"), ("B", "ch_002", "稳态")}
    weighted, _ = pipelines.graph_view(nodes, edges)
    assert {n["name"]: n["frequency"] for n in weighted.collect()}["水肿"] == 2
    decisions, stats = pipelines.integrate_books("run9", books, chapters, nodes, edges)
    got = {d["decision_id"]: d for d in decisions.collect()}
    assert got["run9_merge_0001"]["confidence"] == 0.86 and "《甲书》、《乙书》" in got["run9_merge_0001"]["reason"]
    assert stats.first()["original_textbooks"] == 2
    questions = spark.createDataFrame([(1, "什么是水肿？"), (2, "qq")], "question_id int, question string")
    replies, hits = pipelines.answer_questions(books, chapters, questions)
    assert {h["chapter_id"] if "chapter_id" in h else h["chapter_title"] for h in hits.filter("question_id = 1 AND rank = 1").collect()} == {"第一章 水肿"}
    assert replies.filter("question_id = 1").first()["answer"].count("水肿") > 1
