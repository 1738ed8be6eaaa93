"""Chapters of paged documents line by line, against the same documents as whole texts."""

import random

import pytest

from corpusweave.functions import ranking
from corpusweave.operators import segment


def chapters(spark, pages, outline=(), whole=segment.WHOLE_CHARS, parts=3):
    p = spark.createDataFrame(pages, "doc_id string, page_no int, text string").repartition(parts)
    o = spark.createDataFrame(list(outline), "doc_id string, pos int, level int, title string, page int")
    return sorted(tuple(r) for r in segment.paged_chapters(p, o, whole).collect())


def some_documents(seed, n=40):
    rng = random.Random(seed)
    lines = ["# One", "## Two", "## Three  x", "# ", "#", "##", "### deep", "plain text", "more of it", "", "", "第一章 开始", "  # 第 2 章 继续", "第3章（不是）", " * 第十章", "#no", "text # not", "第4章 " + "长" * 61]
    pages = []
    for d in range(n):
        own = rng.sample(lines, rng.randint(2, len(lines)))
        for k in range(rng.randint(1, 9)):
            pages.append((f"d{d}", k + 1, "\n".join(rng.choice(own) for _ in range(rng.randint(0, 7))) if rng.random() < 0.95 else None))
    return pages


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_give_the_chapters_of_whole_texts(spark, seed):
    pages = some_documents(seed)
    outline = [("d3", 1, 1, "Chapter 1 x", 1), ("d3", 2, 1, "Chapter 2 y", 2)]
    by_lines = chapters(spark, pages, outline, 0)
    assert by_lines == chapters(spark, pages, outline)
    assert {r[-1] for r in by_lines} >= {"headings", "lines", "page_buckets"}


def test_one_document_over_many_partitions(spark):
    pages = [("d", k, f"# Part {k // 10}\n" * (k % 10 == 0) + f"line {k}\n\nmore {k}") for k in range(1, 400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chapters(spark, pages, whole=0, parts=16)
        lines = segment._page_lines(spark.createDataFrame(pages, "doc_id string, page_no int, text string"))
        # the running total of headings is one of ranges of lines: this document lies in several
        assert ranking._placed(lines, [lines["at"].asc()]).select("__p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 39 and got == chapters(spark, pages)
    assert got[0][2] == "Part 1" and got[0][5].startswith("# Part 1\nline 10\n\nmore 10\n\nline 11")
