"""Documents to chapters: outline choice, page ranges, headings, chapter lines, page buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.ranking import numbered, running_total
from corpusweave.functions.shared import written
from corpusweave.functions.text import NUMERALS, is_chapter_title, is_front_matter, normal_title, strip

TITLE_LENGTH = 100
WHOLE = "全文"
GIANT = 0.85
PAGES_PER_BUCKET = 30
#: Characters of a paged document up to which it is searched for headings as one text.
WHOLE_CHARS = 1 << 24
ACCEPTED = ("pdf", "md", "markdown", "txt", "docx")
LINE_CHAPTER = rf"(?dmU)^[\s#*]{{0,8}}(第\s*[{NUMERALS}\d]+\s*章[^\n（）()]{{0,60}})$"


def format_gate(files: DataFrame, name: str = "filename") -> DataFrame:
    """Adds file_format, status and reason: files of an unknown suffix are rejected."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./\\]*)\z", 1))
    ok = suffix.isin(*ACCEPTED)
    return files.withColumns({"file_format": suffix, "status": F.when(ok, "accepted").otherwise("rejected"), "reason": F.when(~ok, F.concat(F.lit("unsupported format: "), suffix))})


def styled_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, markdown) from (doc_id, pos, style, text): heading styles as marks, blank text dropped."""
    text, style = strip(F.col("text")), F.lower(F.coalesce("style", F.lit("")))
    mark = F.when(style.contains("heading 1"), "# ").when(style.contains("heading 2"), "## ").when(style.contains("heading 3"), "### ").otherwise("")
    lines = paragraphs.select("doc_id", "pos", F.concat(mark, text).alias("line"), text.alias("t")).filter(F.length("t") > 0)
    return lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l")).select("doc_id", F.array_join("l.line", "\n\n").alias("markdown"))


def outline_chapters(outline: DataFrame) -> DataFrame:
    """(doc_id, ordinal, title, page_start, rule) from (doc_id, pos, level, title, page).

    Front matter and empty titles go; then the first rule that holds for the document: three or
    more level-1 chapter titles; two or more of level 1; three or more level-2 chapter titles;
    3 to 50 of level 2. Documents for which none holds give no rows.
    """
    t = normal_title(F.col("title"))
    rows = outline.select("doc_id", "pos", "level", t.alias("title"), "page").filter((F.length("title") > 0) & ~is_front_matter(F.col("title")))
    rows = rows.withColumn("named", is_chapter_title(F.col("title")))
    doc = Window.partitionBy("doc_id")
    n = lambda cond: F.count(F.when(cond, 1)).over(doc)
    one, two, named = F.col("level") == 1, F.col("level") == 2, F.col("named")
    rule = F.when(n(one & named) >= 3, "level1_named").when(n(one) >= 2, "level1").when(n(two & named) >= 3, "level2_named").when(n(two).between(3, 50), "level2")
    fits = F.when(F.col("rule") == "level1_named", one & named).when(F.col("rule") == "level1", one).when(F.col("rule") == "level2_named", two & named).otherwise(two)
    chosen = rows.withColumn("rule", rule).filter(F.col("rule").isNotNull() & fits)
    return chosen.select("doc_id", F.row_number().over(doc.orderBy("pos")).alias("ordinal"), "title", F.col("page").alias("page_start"), "rule")


def chapter_id(ordinal: Column) -> Column:
    return F.format_string("ch_%03d", ordinal)


def page_range_chapters(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters (doc_id, chapter_id, title, page_start, page_end, content, char_count) from chosen
    outline rows and (doc_id, page_no, text): up to the page before the next chapter, the last to the
    end. Chapters without pages are skipped, their ordinals not used again."""
    totals = pages.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    after = F.lead("page_start").over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1
    ranges = chosen.withColumn("after", after).join(totals, "doc_id").withColumn("page_end", F.coalesce("after", "total")).filter(F.col("page_end") >= F.col("page_start"))
    # each chapter meets its own pages by an equi-join; a document's ranges have its pages' length
    wanted = ranges.withColumn("page_no", F.explode(F.sequence("page_start", F.least("page_end", "total")))).filter(F.col("page_start") <= F.col("total"))
    joined = wanted.join(pages, ["doc_id", "page_no"])
    text = strip(F.array_join(F.sort_array(F.collect_list(F.struct("page_no", "text")))["text"], "\n\n"))
    got = joined.groupBy("doc_id", "ordinal", "title", "page_start", "page_end").agg(text.alias("content"))
    return got.select("doc_id", chapter_id(F.col("ordinal")).alias("chapter_id"), F.substring("title", 1, TITLE_LENGTH).alias("title"), "page_start", "page_end", "content", F.length("content").alias("char_count"))


def page_buckets(pages: DataFrame, size: int = PAGES_PER_BUCKET) -> DataFrame:
    """Fixed runs of pages as chapters; blank ones are dropped, their ordinals not used again."""
    totals = pages.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    rows = pages.withColumn("bucket", F.floor((F.col("page_no") - 1) / size).cast("int")).groupBy("doc_id", "bucket").agg(strip(F.array_join(F.sort_array(F.collect_list(F.struct("page_no", "text")))["text"], "\n\n")).alias("content"))
    start, end = F.col("bucket") * size + 1, F.least((F.col("bucket") + 1) * size, F.col("total"))
    return (
        rows.filter(F.length("content") > 0).join(totals, "doc_id")
        .select("doc_id", chapter_id(F.col("bucket") + 1).alias("chapter_id"), F.format_string("第 %d-%d 页", start, end).alias("title"), start.alias("page_start"), end.alias("page_end"), "content", F.length("content").alias("char_count"))
    )


def _pieces(content: Column, at: str, what: str) -> Column:
    """The text cut where `at` matches; the pieces that begin so."""
    return F.filter(F.split(content, f"(?={at})"), lambda x: x.rlike(what))


def heading_pieces(content: Column) -> Column:
    """Level-1 sections if three or more, else level-2 ones if three or more, else two level-1 ones, else empty."""
    mark = lambda k: _pieces(content, rf"(?dmU)^#{{{k}}}\s+.", rf"(?dU)\A#{{{k}}}\s+.")
    one, two = mark(1), mark(2)
    return F.when(F.size(one) >= 3, one).when(F.size(two) >= 3, two).when(F.size(one) >= 2, one).otherwise(F.array().cast("array<string>"))


def line_pieces(content: Column) -> Column:
    """Sections that begin with a chapter line of its own, if there are two or more."""
    got = _pieces(content, LINE_CHAPTER, LINE_CHAPTER.replace("(?dmU)^", r"(?dmU)\A"))
    return F.when(F.size(got) >= 2, got).otherwise(F.array().cast("array<string>"))


def _sections(docs: DataFrame, pieces: str, title: Column) -> DataFrame:
    each = docs.select("doc_id", F.posexplode(pieces).alias("at", "piece"))
    body = strip(F.col("piece"))
    return each.select("doc_id", chapter_id(F.col("at") + 1).alias("chapter_id"), F.substring(title, 1, TITLE_LENGTH).alias("title"), body.alias("content"), F.length(body).alias("char_count"))


def _heading_title() -> Column:
    return normal_title(F.regexp_extract("piece", r"(?dm)\A#{1,3}\s+([^\n]*)$", 1))


def _line_title() -> Column:
    return normal_title(F.regexp_extract("piece", LINE_CHAPTER.replace("(?dmU)^", r"(?dmU)\A"), 1))


def heading_chapters(docs: DataFrame) -> DataFrame:
    """Chapters of (doc_id, content) by headings; one chapter with the unstripped whole if there are too few."""
    rows = docs.withColumn("pieces", heading_pieces(F.col("content")))
    whole = rows.filter(F.size("pieces") == 0).select("doc_id", F.lit("ch_001").alias("chapter_id"), F.lit(WHOLE).alias("title"), "content", F.length("content").alias("char_count"))
    return _sections(rows.filter(F.size("pieces") > 0), "pieces", _heading_title()).unionByName(whole)


def line_chapters(docs: DataFrame) -> DataFrame:
    """Chapters by lines that hold a chapter number; documents with fewer than two give none."""
    return _sections(docs.withColumn("pieces", line_pieces(F.col("content"))), "pieces", _line_title())


def giant_test(chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, giant): no chapters, or one with more than 85 % of all characters."""
    sums = chapters.groupBy("doc_id").agg(F.max("char_count").alias("most"), F.sum("char_count").alias("total"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", (F.col("total").isNull() | ((F.col("total") > 0) & (F.col("most") / F.col("total") > GIANT))).alias("giant"))


def _page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, at, line) of pages joined by blank lines, as a table; at orders the lines of all documents, documents one after the other."""
    lines = pages.filter(F.col("text").isNotNull()).select("doc_id", "page_no", F.posexplode(F.split(F.concat("text", F.lit("\n")), "\n")).alias("pos", "line"))
    return numbered(lines, "at", F.col("doc_id").asc(), F.col("page_no").asc(), F.col("pos").asc()).select("doc_id", "at", "line")


def _starts(lines: DataFrame, k: int) -> DataFrame:
    """(doc_id, at, counts) of the lines where the text is cut: headings of level k, or chapter lines for k = 0.

    A line of marks alone cuts the text where anything follows, and counts when the next line that isn't
    empty is part of its piece, as then that is its title.
    """
    line = F.col("line")
    if not k:
        return lines.filter(line.rlike(LINE_CHAPTER.replace("(?dmU)^", r"(?dU)\A").replace("$", r"\z"))).select("doc_id", "at", F.lit(True).alias("counts"))
    sure = lines.filter(line.rlike(rf"(?dU)\A#{{{k}}}\s+.")).select("doc_id", "at", F.lit(True).alias("counts"))
    bare = lines.filter(line.rlike(rf"(?U)\A#{{{k}}}\s?\z")).select("doc_id", "at")
    if bare.isEmpty():
        return sure
    filled = numbered(lines.filter(line != "").select("doc_id", "at"), "o", F.col("at").asc())
    last = filled.groupBy("doc_id").agg(F.max("at").alias("last"))
    cuts = bare.join(last, "doc_id").filter("at < last").select("doc_id", "at", F.lit(False).alias("counts"))
    own = written(filled.join(sure.unionByName(cuts), ["doc_id", "at"], "left"))
    after = own.select("doc_id", (F.col("o") - 1).alias("o"), F.col("counts").isNull().alias("plain"))
    found = own.filter("counts = false").join(after, ["doc_id", "o"], "left")
    return sure.unionByName(found.select("doc_id", "at", F.coalesce("plain", F.lit(False)).alias("counts")))


def _gathered(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, at, piece): the lines from each start to the next one, joined, where the start counts; at counts from 0 within a document.

    The number of starts up to a line is a running total over ranges of lines, so no task has a document as a whole.
    """
    flagged = lines.join(starts.withColumn("start", F.lit(1)), ["doc_id", "at"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    counted = running_total(flagged.select("doc_id", "at", "line", "start"), "piece_no", "start", F.col("at").asc())
    # what stands before a document's first start goes with the one before it, whose document is another, or with none
    pieces = counted.groupBy("doc_id", "piece_no").agg(F.max("start").alias("started"), F.min("at").alias("first"), F.array_join(F.sort_array(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("piece"))
    named = numbered(starts.filter("counts").select("doc_id", F.col("at").alias("first")), "o", F.col("first").asc())
    begin = named.groupBy("doc_id").agg(F.min("o").alias("begin"))
    return pieces.filter("started = 1").join(named, ["doc_id", "first"]).join(begin, "doc_id").select("doc_id", (F.col("o") - F.col("begin")).cast("int").alias("at"), "piece")


def _ways_by_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces by headings, pieces by chapter lines, doc_id of the others) of documents that are read line by line."""
    lines = _page_lines(pages)
    levels = [written(_starts(lines, k)) for k in (0, 1, 2)]
    count = lambda k: levels[k].groupBy("doc_id").agg(F.count_if("counts").alias(f"n{k}"))
    n = lines.select("doc_id").distinct().join(count(0), "doc_id", "left").join(count(1), "doc_id", "left").join(count(2), "doc_id", "left").na.fill(0)
    n = written(n.withColumn("level", F.when(F.col("n1") >= 3, 1).when(F.col("n2") >= 3, 2).when(F.col("n1") >= 2, 1)))
    of = lambda rows, found: rows.join(found.select("doc_id"), "doc_id", "left_semi")
    heads = None
    for k in (1, 2):
        docs = n.filter(F.col("level") == k)
        part = _gathered(of(lines, docs), of(levels[k], docs))
        heads = part if heads is None else heads.unionByName(part)
    heads = written(heads)
    sizes = heads.groupBy("doc_id").agg(F.max(F.length(strip(F.col("piece")))).alias("most"), F.sum(F.length(strip(F.col("piece")))).alias("total"))
    good = written(sizes.filter(~((F.col("total") > 0) & (F.col("most") / F.col("total") > GIANT))).select("doc_id"))
    rest = n.join(good, "doc_id", "left_anti")
    lined = rest.filter("n0 >= 2")
    return of(heads, good), _gathered(of(lines, lined), of(levels[0], lined)), pages.select("doc_id").distinct().join(good, "doc_id", "left_anti").join(lined, "doc_id", "left_anti")


def _titled(pieces: DataFrame, title: Column) -> DataFrame:
    body = strip(F.col("piece"))
    return pieces.select("doc_id", chapter_id(F.col("at") + 1).alias("chapter_id"), F.substring(title, 1, TITLE_LENGTH).alias("title"), body.alias("content"), F.length(body).alias("char_count"))


def paged_chapters(pages: DataFrame, outline: DataFrame, whole: int = WHOLE_CHARS) -> DataFrame:
    """Chapters of paged documents by the first strategy that works, with the strategy's name:
    outline (two chapters chosen), headings (two, none giant), chapter lines (two), page buckets.

    Documents of up to `whole` characters are searched for headings as one text. Longer ones are
    searched line by line, wherever their pages lie; there a chapter line is one line, while in a text
    blanks within it may be line breaks.
    """
    chosen = outline_chapters(outline)
    by_outline = page_range_chapters(chosen, pages)
    enough = chosen.groupBy("doc_id").count().filter("count >= 2").join(by_outline.filter("char_count > 0").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
    rest = pages.join(enough, "doc_id", "left_anti")
    long = written(pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).filter(F.col("n") > whole).select("doc_id"))
    whole_texts = rest.join(long, "doc_id", "left_anti").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page_no", "text")))["text"], "\n\n").alias("content"))
    cut = whole_texts.select("doc_id", heading_pieces(F.col("content")).alias("heads"), line_pieces(F.col("content")).alias("lines"))
    sizes = lambda c: F.transform(F.col(c), lambda x: F.length(strip(x)))
    total = F.aggregate(sizes("heads"), F.lit(0), lambda a, x: a + x)
    giant = (F.size("heads") < 2) | ((total > 0) & (F.array_max(sizes("heads")) / total > GIANT))
    ways = cut.withColumn("strategy", F.when(~giant, "headings").when(F.size("lines") >= 2, "lines").otherwise("page_buckets"))
    none = {"page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")}
    cols = ["doc_id", "chapter_id", "title", "page_start", "page_end", "content", "char_count", "strategy"]
    plain = ways.filter("strategy = 'page_buckets'").select("doc_id")
    parts = [
        by_outline.join(enough, "doc_id", "left_semi").withColumn("strategy", F.lit("outline")),
        _sections(ways.filter("strategy = 'headings'"), "heads", _heading_title()).withColumns(none | {"strategy": F.lit("headings")}),
        _sections(ways.filter("strategy = 'lines'"), "lines", _line_title()).withColumns(none | {"strategy": F.lit("lines")}),
    ]
    if not long.isEmpty():
        by_heads, by_lines, others = _ways_by_lines(written(rest.join(long, "doc_id", "left_semi")))
        parts += [_titled(by_heads, _heading_title()).withColumns(none | {"strategy": F.lit("headings")}), _titled(by_lines, _line_title()).withColumns(none | {"strategy": F.lit("lines")})]
        plain = plain.unionByName(others)
    parts.append(page_buckets(pages.join(plain, "doc_id", "left_semi")).withColumn("strategy", F.lit("page_buckets")))
    out = parts[0].select(cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(cols))
    return out


def catalogue(textbooks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Textbooks with their number of chapters (0 if none) and characters, newest first."""
    counts = chapters.groupBy("textbook_id").agg(F.count("*").alias("chapter_count"))
    return textbooks.join(counts, "textbook_id", "left").withColumn("chapter_count", F.coalesce("chapter_count", F.lit(0))).orderBy(F.desc("uploaded_at"), "textbook_id")


def document_total(docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, total_chars): the chapters' characters, or the document's own where they are none."""
    sums = chapters.groupBy("doc_id").agg(F.sum("char_count").alias("s"))
    return docs.join(sums, "doc_id", "left").select("doc_id", F.when(F.coalesce("s", F.lit(0)) > 0, F.col("s")).otherwise(F.length("content")).cast("long").alias("total_chars"))


def chapters_of(chapters: DataFrame, textbook_id: str, chapter: str | None = None) -> DataFrame:
    rows = chapters.filter(F.col("textbook_id") == textbook_id)
    return rows.filter(F.col("chapter_id") == chapter) if chapter else rows.orderBy("chapter_id")
