"""Many terms in many texts against plain search, and what rests on it: lookups, dictionaries, node search, message turns."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import converse, extract, graph, terms


def plain(texts, words):
    """{key: [(ord, term, at)]}"""
    first = {}
    for o, t in words:
        if t:
            first[t] = min(o, first.get(t, o))
    return {k: sorted((o, t, text.find(t) + 1) for t, o in first.items() if text and t in text) for k, text in texts}


@pytest.mark.parametrize("block,parts", [(200_000, 1), (7, 4)])
def test_hits_match_plain_search(spark, block, parts):
    rng = random.Random(block)
    texts = [(k, "".join(rng.choices("ab水🙂 ", k=rng.randint(0, 60)))) for k in range(80)] + [(100, None), (101, "")]
    words = [(o, "".join(rng.choices("ab水🙂", k=rng.randint(1, 4)))) for o in range(60)] + [(70, ""), (71, None), (3, "ab"), (99, "ab")]
    rows = spark.createDataFrame([(k, t, 1) for k, t in texts], "k int, text string, term int").repartition(parts)
    got = terms.with_hits(rows, spark.createDataFrame(words, "ord int, term string"), block=block)
    assert got.columns == ["k", "text", "term", "hits"]
    assert {r["k"]: [tuple(h) for h in r["hits"]] for r in got.collect()} == plain(texts, words)
    assert all(r["hits"] == [] for r in terms.with_hits(rows, spark.createDataFrame([], "ord int, term string")).collect())


def test_a_hundred_thousand_terms_take_one_pass(spark):
    rng = random.Random(1)
    words = [(i, f"{rng.choice('abcdefgh')}{i:x}{rng.choice('xyz')}") for i in range(100_000)]
    texts = [(k, " ".join(words[rng.randrange(100_000)][1] for _ in range(20))) for k in range(300)]
    began = time.perf_counter()
    got = terms.with_hits(spark.createDataFrame(texts, "k int, text string").repartition(4), spark.createDataFrame(words, "ord int, term string")).collect()
    assert time.perf_counter() - began < 60
    known = {w for _, w in words}
    for r in got:
        assert set(r["text"].split()) <= {h["term"] for h in r["hits"]} <= known
        assert all(r["text"][h["at"] - 1 :].startswith(h["term"]) and r["text"].find(h["term"]) == h["at"] - 1 for h in r["hits"])


def test_first_text_with_a_term(spark):
    texts = spark.createDataFrame([("d1", 3, "xay"), ("d2", 1, "ab"), ("d3", 2, "b a")], "decision_id string, position long, text string")
    got = terms.first_with(spark.createDataFrame([("a",), ("b",), ("b a",), ("q",), ("",)], "term string"), texts, "decision_id", "position")
    assert {r["term"]: r["decision_id"] for r in got.collect()} == {"a": "d2", "b": "d2", "b a": "d3"}


def test_a_dictionary_table_gives_the_nodes_of_a_list(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("天地玄黄宇", k=rng.randint(2, 3))) for _ in range(40)]
    rows = [("b", f"ch_{i:03}", f"第{i}章 标题{i}", 1, "".join(rng.choices("天地玄黄宇宙。", k=80))) for i in range(30)] + [("b", "ch_900", "空", 1, " ")]
    ch = spark.createDataFrame(rows, "textbook_id string, chapter_id string, title string, page_start int, content string")
    table = spark.createDataFrame(list(enumerate(words)), "ord int, term string")
    key = lambda df: sorted((r["chapter_id"], r["rank"], r["name"], r["definition"]) for r in df.collect())
    assert key(extract.rule_nodes(ch, table)) == key(extract.rule_nodes(ch, words))


def test_many_node_searches_at_once(spark):
    nodes = spark.createDataFrame([("n1", "Alpha", "first one", "c1", "b1"), ("n2", "beta", "ALPHA again", "c2", "b2"), ("n3", "gamma", None, "c3", "b1")], "id string, name string, definition string, chapter_title string, textbook_id string")
    titles = spark.createDataFrame([("b1", "Big Book"), ("b2", "Other")], "textbook_id string, title string")
    queries = [(1, " alpha "), (2, "BOOK"), (3, ""), (4, "nowhere"), (5, "a"), (6, None), (7, "alpha")]
    got = {(r["query_id"], r["id"]) for r in graph.search_nodes_for(nodes, titles, spark.createDataFrame(queries, "query_id int, query string")).collect()}
    assert got == {(i, r["id"]) for i, q in queries if q and q.strip() for r in graph.search_nodes(nodes, titles, q).collect()}


DECISIONS = [("run1_merge_0001", "merge", "关于水肿的合并", 0), ("run1_merge_0002", "merge", "稳态", 1), ("run1_keep_0001", "keep", "发热", 2), ("run1_keep_0002", "keep", "休克 shock", 3)]
LISTING = "decision_id string, action string, reason string, position long"


def turns(spark, contents, decisions=DECISIONS, status=("state",), answers=((4, "an answer"),)):
    m = spark.createDataFrame([("s", i, c) for i, c in enumerate(contents, 1)], "session_id string, id long, content string")
    listing = spark.createDataFrame(decisions, LISTING).withColumn("haystack", F.col("reason"))
    got = converse.message_turns(m, listing, spark.createDataFrame([(s,) for s in status], "reply string"), spark.createDataFrame([("s", *a) for a in answers], "session_id string, id long, answer string"))
    return {r["id"]: (r["intent"], r["decision_id"], r["tool"], r["reply"]) for r in got.collect()}


def test_message_turns(spark):
    got = turns(spark, ["为什么 [[休克]]", "保留 run1_keep_0001", "请分开 发热", "什么是水肿", "好", "不要合并 稳态", "解释 nothing known"])
    assert got == {
        1: ("explain_decision", "run1_keep_0002", "explain_decision", "这条决策的理由是：休克 shock"),
        2: ("keep", "run1_keep_0001", "modify_decision", "已更新：run1_keep_0001 调整为 keep。"),
        # only merges are split: the first one, as none has the term
        3: ("split", "run1_merge_0001", "modify_decision", "已更新：run1_merge_0001 已由 merge 调整为 keep。"),
        4: ("query_rag", None, "query_rag", "an answer"),
        5: ("summarize_integration", None, "summarize_integration", "state"),
        6: ("split", "run1_merge_0002", "modify_decision", "已更新：run1_merge_0002 已由 merge 调整为 keep。"),
        7: ("explain_decision", "run1_merge_0001", "explain_decision", "这条决策的理由是：关于水肿的合并"),
    }


def test_message_turns_without_decisions_or_merges(spark):
    said = ["为什么", "保留", "分开?", "分开"]
    got = turns(spark, said, [], (), ())
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["query_rag" if "什么" in c or c.endswith("?") else "summarize_integration" for c in said]
    assert got[2][3].startswith("当前还没有整合结果") and got[3][3] == ""
    got = turns(spark, said, DECISIONS[2:])
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["explain_decision", "keep", "query_rag", "summarize_integration"]
