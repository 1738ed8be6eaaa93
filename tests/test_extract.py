import json

from pyspark.sql import functions as F

from corpusweave.operators import extract

CH = "textbook_id string, chapter_id string, title string, page_start int, content string"


def test_recovered_json(spark):
    given = ['```json\n{"a": [1]}\n```', 'Here: [1, 2] thanks', "no json", '{"a": 1} tail }']
    got = [r["j"] for r in spark.createDataFrame([(g,) for g in given], "x string").select(extract.recovered_json(F.col("x")).alias("j")).collect()]
    assert got == ['{"a": [1]}', "[1, 2]", "no json", '{"a": 1} tail }']


def responses(spark, body):
    raw = body if isinstance(body, str) or body is None else json.dumps(body, ensure_ascii=False)
    df = spark.createDataFrame([("b", "ch_001", "t", 3, "c", raw)], CH + ", response string")
    return df.withColumn("json", extract.recovered_json(F.col("response")))


def test_model_nodes_and_edges(spark):
    body = {
        "nodes": [{"name": " 稳态 ", "definition": "x" * 600}, {"name": "稳态", "definition": "second"}, {"name": "水肿", "category": "病理"}, {"name": "长" * 51}, {"name": "主要"}, {"name": "发热（高）"}, {}],
        "edges": [
            {"source": "稳态", "target": "水肿", "relation_type": "contains", "description": "y" * 300}, {"source": "稳态", "target": "未知", "relation_type": "contains"},
            {"source": "稳态", "target": "水肿", "relation_type": "likes"},
        ],
    }
    r = responses(spark, body)
    nodes = extract.model_nodes(r)
    got = {n["name"]: n for n in nodes.collect()}
    assert set(got) == {"稳态", "水肿"} and len(got["稳态"]["definition"]) == 500 and got["稳态"]["category"] == "核心概念" and got["水肿"]["category"] == "病理"
    edges = extract.model_edges(r, nodes).collect()
    assert [(e["source"], e["target"], len(e["description"])) for e in edges] == [(got["稳态"]["id"], got["水肿"]["id"], 200)]


def test_routes(spark):
    for body, content, want in ((None, "c", "rules"), ("broken {", "c", "rules"), ("[1]", "c", "empty"), ({"nodes": []}, "c", "model"), ({}, " \n", "none")):
        raw = body if isinstance(body, str) or body is None else json.dumps(body)
        chapters = spark.createDataFrame([("b", "ch_001", "t", 3, content)], CH)
        answers = spark.createDataFrame([("b", "ch_001", raw)], "textbook_id string, chapter_id string, response string")
        assert extract.response_route(chapters, answers).first()["route"] == want


def test_rule_nodes_order_dedup_and_evidence(spark):
    text = "前句。水肿是指组织间隙液体过多。\n## 二、 休克 概念\n### Shock\n缺氧为低氧。"
    ch = spark.createDataFrame([("b", "ch_001", "第一章 稳态", 1, text)], CH)
    nodes = extract.rule_nodes(ch, ("缺氧", "水肿", "发热")).orderBy("rank").collect()
    assert [n["name"] for n in nodes] == ["稳态", "缺氧", "水肿", "Shock", "水肿是"]
    assert {n["name"]: n["definition"] for n in nodes}["水肿"] == "水肿是指组织间隙液体过多。"
    assert nodes[0]["definition"].startswith("稳态 是本章")


def test_no_candidates_gives_the_short_title(spark):
    ch = spark.createDataFrame([("b", "c1", "x" * 20, 1, "text"), ("b", "c2", "", 1, "text"), ("b", "c3", "x" * 20, 1, "  ")], CH)
    assert sorted((n["chapter_id"], n["name"]) for n in extract.rule_nodes(ch, ()).collect()) == [("c1", "x" * 12), ("c2", "核心概念")]


def test_rule_edges(spark):
    nodes = spark.createDataFrame([("b", "c", f"n{i}", f"N{i}", i) for i in range(1, 9)] + [("b", "lone", "x", "X", 1)], "textbook_id string, chapter_id string, id string, name string, rank int")
    got = {(e["source"], e["target"], e["relation_type"]) for e in extract.rule_edges(nodes).collect()}
    assert got == {("n1", f"n{i}", "contains") for i in range(2, 7)} | {(f"n{i}", f"n{i + 1}", "parallel") for i in range(2, 6)}
