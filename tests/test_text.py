"""Title, term and excerpt expressions, on Chinese and odd white space."""

from pyspark.sql import functions as F

from corpusweave.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normal_title_collapses_every_kind_of_space(spark):
    assert one(spark, "  第一章　 绪论\r\n  与\t方法 ", text.normal_title) == "第一章 绪论 与 方法"
    assert one(spark, "a b  c", text.normal_title) == "a b c"


def test_front_matter(spark):
    cases = {"前 言": False, "前言": True, "目录": True, "参考文献与索引": True, "第一章 索引方法" + "很" * 30: False, "细胞": False}
    assert {c: one(spark, c, text.is_front_matter) for c in cases} == cases


def test_chapter_titles(spark):
    cases = {"第 十二 章 水肿": True, "第3篇": True, "chapter 4": True, "PART 2": True, "绪论": True, "绪论二": False, "小结": False}
    assert {c: one(spark, c, text.is_chapter_title) for c in cases} == cases


def test_clean_and_valid_terms(spark):
    assert one(spark, "一、 1. 稳态 调节：概念", text.clean_term) == "稳态调节"
    cases = {"稳态": True, "水": False, "主要作用": False, "图一": False, "细胞": False, "认为": False, "水肿。": False, "很长" * 7: False, "Re.": True}
    assert {c: one(spark, c, text.is_valid_term) for c in cases} == cases


def test_name_keys(spark):
    assert one(spark, " A b-C（d）", text.space_free_key) == "ab-c（d）"
    assert one(spark, " A b-C（d）；/_", text.mark_free_key) == "abcd"


def test_ids_are_stable_and_differ(spark):
    a, b, c = (spark.range(1).select(text.node_id(F.lit(t), F.lit(ch), F.lit(n)).alias("i")).first()["i"] for t, ch, n in (("b1", "ch_001", "稳态"), ("b1", "ch_001", "稳态"), ("b1", "ch_002", "稳态")))
    assert a == b != c and a.startswith("b1_ch_001_") and len(a) == len("b1_ch_001_") + 6


def test_truncate_middle(spark):
    long = "a" * 4200 + "b" * 100 + "c" * 1800
    assert one(spark, "x" * 6000, text.truncate_middle) == "x" * 6000
    got = one(spark, long, text.truncate_middle)
    assert got.startswith("a" * 4200 + "\n\n...") and got.endswith("...\n\n" + "c" * 1800) and "b" not in got


def excerpt(spark, content, name, definition, limit):
    row = spark.createDataFrame([(content, name, definition)], "c string, n string, d string")
    return row.select(text.excerpt(F.col("c"), F.col("n"), F.col("d"), limit).alias("y")).first()["y"]


def test_excerpt_around_name_definition_or_start(spark):
    body = "x" * 100 + "水肿" + "y" * 100
    assert excerpt(spark, body, "水肿", "d", 30) == body[90:120]
    assert excerpt(spark, body, "没有", "水肿yyy", 30) == body[90:120]
    assert excerpt(spark, body, "没有", "", 30) == body[:30]
    assert excerpt(spark, "  ", "n", "定义在此", 2) == "定义"
    assert excerpt(spark, None, "n", "定义在此", 9) == "定义在此"
