from corpusweave.operators import segment


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def outline(spark, *levels_titles):
    return spark.createDataFrame([("d", i, lv, t, i * 2 + 1) for i, (lv, t) in enumerate(levels_titles)], "doc_id string, pos int, level int, title string, page int")


def test_outline_rules(spark):
    named1 = [(1, "第一章 甲"), (1, "附录"), (1, "第二章 乙"), (1, "第三章 丙"), (1, "目录")]
    assert rows(segment.outline_chapters(outline(spark, *named1)), "ordinal", "title", "rule") == [(1, "第一章 甲", "level1_named"), (2, "第二章 乙", "level1_named"), (3, "第三章 丙", "level1_named")]
    assert {r["rule"] for r in segment.outline_chapters(outline(spark, (1, "甲"), (1, "乙"))).collect()} == {"level1"}
    level2 = [(1, "甲"), (2, "Chapter 1"), (2, "Chapter 2"), (2, "x"), (2, "part 3")]
    assert rows(segment.outline_chapters(outline(spark, *level2)), "title", "rule") == [("Chapter 1", "level2_named"), ("Chapter 2", "level2_named"), ("part 3", "level2_named")]
    assert {r["rule"] for r in segment.outline_chapters(outline(spark, (2, "a"), (2, "b"), (2, "c"))).collect()} == {"level2"}
    assert segment.outline_chapters(outline(spark, (2, "a"), (2, "b"), (1, "c"))).count() == 0


def pages(spark, n, blank=()):
    return spark.createDataFrame([("d", i, "" if i in blank else f"p{i}") for i in range(1, n + 1)], "doc_id string, page_no int, text string")


def test_page_ranges_skip_empty_ones_and_keep_ordinals(spark):
    chosen = spark.createDataFrame([("d", 1, "a", 1), ("d", 2, "b", 3), ("d", 3, "c", 3), ("d", 4, "e", 5)], "doc_id string, ordinal int, title string, page_start int")
    got = rows(segment.page_range_chapters(chosen, pages(spark, 6)), "chapter_id", "page_start", "page_end", "content")
    assert got == [("ch_001", 1, 2, "p1\n\np2"), ("ch_003", 3, 4, "p3\n\np4"), ("ch_004", 5, 6, "p5\n\np6")]


def test_page_buckets_drop_blank_ones(spark):
    got = rows(segment.page_buckets(pages(spark, 61, blank=range(31, 61))), "chapter_id", "title", "page_end")
    assert got == [("ch_001", "第 1-30 页", 30), ("ch_003", "第 61-61 页", 61)]


def headings(spark, text):
    return rows(segment.heading_chapters(spark.createDataFrame([("d", text)], "doc_id string, content string")), "chapter_id", "title", "content")


def test_heading_chapters(spark):
    assert headings(spark, " plain\n") == [("ch_001", "全文", " plain\n")]
    assert headings(spark, "lead\n# a b\nx\n# c \ny\n") == [("ch_001", "a b", "# a b\nx"), ("ch_002", "c", "# c \ny")]
    two = "# a\n## x\n1\n## y\n2\n## z\n3\n# b\n"
    assert [t for _, t, _ in headings(spark, two)] == ["x", "y", "z"]
    assert [t for _, t, _ in headings(spark, "# a\n# b\n# c\n## x\n## y\n## z\n")] == ["a", "b", "c"]
    assert headings(spark, "# only\ntext")[0][1] == "全文"


def test_line_chapters(spark):
    text = "前文\n## 第一章 水肿\nx\n第 2 章\ny\n第三章（续）\nz\n"
    got = rows(segment.line_chapters(spark.createDataFrame([("d", text)], "doc_id string, content string")), "chapter_id", "title")
    assert got == [("ch_001", "第一章 水肿"), ("ch_002", "第 2 章")]
    assert segment.line_chapters(spark.createDataFrame([("d", "第一章\nx")], "doc_id string, content string")).count() == 0


def test_cascade_takes_the_first_strategy_that_works(spark):
    p = spark.createDataFrame(
        [("outline", 1, "a"), ("outline", 2, "b"), ("heads", 1, "# a\nxxxx"), ("heads", 2, "# b\nyyyy"), ("lines", 1, "第一章\nx"), ("lines", 2, "第二章\ny"), ("none", 1, "x")], "doc_id string, page_no int, text string"
    )
    o = spark.createDataFrame([("outline", 0, 1, "甲", 1), ("outline", 1, 1, "乙", 2)], "doc_id string, pos int, level int, title string, page int")
    got = {(r["doc_id"], r["strategy"]) for r in segment.paged_chapters(p, o).collect()}
    assert got == {("outline", "outline"), ("heads", "headings"), ("lines", "lines"), ("none", "page_buckets")}


def test_styled_paragraphs(spark):
    p = spark.createDataFrame([("d", 2, "Heading 2", " b "), ("d", 1, "HEADING 1", "a"), ("d", 3, "Normal", "  "), ("d", 4, None, "c")], "doc_id string, pos int, style string, text string")
    assert segment.styled_paragraphs(p).first()["markdown"] == "# a\n\n## b\n\nc"
