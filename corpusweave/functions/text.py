"""Column expressions on titles, terms, names and excerpts.

White space is Unicode white space, lines end at \\n only, lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark front and back matter in a title.
FRONT_MATTER = ("封面", "书名", "版权", "编委", "使用说明", "序言", "教材修订", "主审简介", "主编简介", "副主编简介", "前言", "目录", "索引", "缩略语", "缩写", "致谢", "参考文献")
FRONT_MATTER_LENGTH = 30
# Chinese numerals in headings, and what a chapter title begins with.
NUMERALS = "一二三四五六七八九十百零"
CHAPTER_TITLE = rf"(?iU)^(第\s*[{NUMERALS}\d]+\s*[章篇部]|Chapter\s+\d+|Part\s+\d+|(绪论|总论|导论)$)"
# Terms that are no concepts.
STOP_TERMS = (
    "本章", "问题", "复习题", "目录", "参考文献", "答案", "小结", "学习目标", "主要", "尤其", "特别", "目前认", "值得注意的", "此外", "因此", "由于", "一般", "这些", "这种", "临床", "患者", "表现", "发生", "可以", "作为",
    "细胞", "器官", "系统", "血液", "组织", "功能", "结构", "疾病", "内环境", "人体", "生命", "机体", "正常", "异常", "基本", "心脏", "肾脏", "肺", "肝脏", "免疫", "肿瘤",
)
# Ends, beginnings and marks that no concept has.
TERM_MARKS = "[，。？！；：（）()【】\\[\\]『』]"
TERM_ENDS = "[的了认作为]$"
TERM_STARTS = "^(主要|尤其|特别|目前|值得|图|表)"
# Marks that end a term when it is cleaned, and marks that name keys leave out.
CUT_MARKS = "[：:，,。；;（）()【】\\[\\]《》<>]"
KEY_MARKS = "[\\s\\-_/（）()【】\\[\\]《》,，.。:：;；]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is worked out once per row however often f names it."""
    return F.transform(F.array(value), f)[0]


def squish(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normal_title(c: Column) -> Column:
    return squish(F.replace(c, F.lit("\r"), F.lit("")))


def is_front_matter(title: Column) -> Column:
    t = normal_title(title)
    return (F.length(t) <= FRONT_MATTER_LENGTH) & t.rlike("|".join(FRONT_MATTER))


def is_chapter_title(title: Column) -> Column:
    return title.rlike(CHAPTER_TITLE)


def clean_term(c: Column) -> Column:
    """Without leading numbers, without what follows the first mark, without white space."""
    no_number = F.regexp_replace(c, rf"(?U)^[\d{NUMERALS}、.\s]+", "")
    return F.regexp_replace(F.regexp_replace(no_number, rf"{CUT_MARKS}.*\z", ""), r"(?U)\s+", "")


def is_valid_term(c: Column) -> Column:
    bad = c.isin(*STOP_TERMS) | c.rlike(TERM_MARKS) | c.rlike(TERM_ENDS) | c.rlike(TERM_STARTS)
    return F.length(c).between(2, 12) & ~bad


def space_free_key(c: Column) -> Column:
    """Name key of the graph: lower case, no white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def mark_free_key(c: Column) -> Column:
    """Name key of the alignment: lower case, no white space, joiners, brackets or stops."""
    return F.lower(F.regexp_replace(c, f"(?U){KEY_MARKS}", ""))


def short_id(prefix: Column, payload: Column, digits: int) -> Column:
    """prefix followed by the first hex digits of the md5 of payload."""
    return F.concat(prefix, F.substring(F.md5(payload), 1, digits))


def node_id(textbook: Column, chapter: Column, name: Column) -> Column:
    return F.concat_ws("_", textbook, chapter, short_id(F.lit(""), name, 6))


def truncate_middle(c: Column, limit: int = 6000, gap: str = "\n\n...（中间内容因长度限制省略）...\n\n") -> Column:
    """Texts over limit: the first 70 % of limit, a note, the last 30 %."""
    head, tail = limit * 7 // 10, limit * 3 // 10
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(gap), F.substring(c, -tail, tail)))


def excerpt(content: Column, name: Column, definition: Column, limit: int) -> Column:
    """limit characters of the squished content from a third of limit before the name, or else
    before the definition's first 20 characters; from the start if neither is there."""
    words = F.coalesce(definition, F.lit(""))

    def cut(source: Column) -> Column:
        at, second = F.position(name, source), F.position(F.substring(words, 1, 20), source)
        found = F.when((at > 0) & (F.length(name) > 0), at).when((second > 0) & (F.length(words) > 0), second)
        start = F.coalesce(F.greatest(F.lit(1), found - limit // 3), F.lit(1))
        return F.when(F.length(source) == 0, F.substring(words, 1, limit)).otherwise(F.substring(source, start, F.lit(limit)))

    return let(squish(F.coalesce(content, definition, F.lit(""))), cut)


def snippet(content: Column, name: Column, before: int = 650, size: int = 2200, fallback: int = 1800) -> Column:
    """size characters from `before` characters ahead of the name; the first `fallback` if it isn't there."""

    def cut(source: Column) -> Column:
        at = F.position(name, source)
        return F.when(at > 0, F.substring(source, F.greatest(F.lit(1), at - before), F.lit(size))).otherwise(F.substring(source, 1, fallback))

    return let(squish(content), cut)
