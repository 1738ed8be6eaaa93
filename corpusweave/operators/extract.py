"""Concept nodes and relations of chapters: from model responses, or by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import NUMERALS, TERM_MARKS, clean_term, is_valid_term, let, node_id, strip, truncate_middle
from corpusweave.operators.terms import with_hits

# The relations, and the categories of nodes.
RELATIONS = ("prerequisite", "parallel", "contains", "applies_to")
CORE, BY_RULE = "核心概念", "启发式概念"
NODES_PER_CHAPTER = 10
RESPONSE = "struct<nodes:array<struct<name:string,definition:string,category:string>>,edges:array<struct<source:string,target:string,relation_type:string,description:string>>>"
CHAPTER = ["textbook_id", "chapter_id"]


def recovered_json(raw: Column) -> Column:
    """The JSON in a model's answer: fences off, from the first bracket to the last."""
    bare = F.regexp_replace(strip(raw), r"(?dm)^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)[\{\[].*[\}\]]", 0), F.lit("")), bare)


def is_object(json: Column) -> Column:
    return F.try_parse_json(json).isNotNull() & json.startswith("{")


def response_route(chapters: DataFrame, responses: DataFrame) -> DataFrame:
    """Adds json and route: none (blank chapter), rules (no response or broken), empty (no object), model; of several responses to a chapter the least counts."""
    joined = chapters.join(responses.groupBy(*CHAPTER).agg(F.min("response").alias("response")), CHAPTER, "left").withColumn("json", recovered_json(F.col("response")))
    route = F.when(F.length(strip(F.col("content"))) == 0, "none").when(F.try_parse_json("json").isNull(), "rules").when(~F.col("json").startswith("{"), "empty").otherwise("model")
    return joined.withColumn("route", route)


def model_nodes(chapters: DataFrame) -> DataFrame:
    """Valid nodes of (textbook_id, chapter_id, title, page_start, json), the first of each name per chapter."""
    parsed = chapters.filter(is_object(F.col("json"))).withColumn("n", F.from_json("json", RESPONSE)["nodes"])
    each = parsed.select(*CHAPTER, "title", "page_start", F.posexplode("n").alias("at", "n"))
    name = strip(F.coalesce("n.name", F.lit("")))
    rows = each.select(
        *CHAPTER, F.col("title").alias("chapter_title"), F.col("page_start").alias("page"), "at", name.alias("name"), F.substring(strip(F.coalesce("n.definition", F.lit(""))), 1, 500).alias("definition"),
        F.substring(strip(F.coalesce(F.nullif(F.col("n.category"), F.lit("")), F.lit(CORE))), 1, 30).alias("category"),
    ).filter(F.length("name").between(1, 50) & ~F.col("name").rlike(TERM_MARKS) & is_valid_term(F.col("name")))
    first = F.row_number().over(Window.partitionBy(*CHAPTER, "name").orderBy("at"))
    kept = rows.withColumn("k", first).filter("k = 1")
    return kept.select(node_id(F.col("textbook_id"), F.col("chapter_id"), F.col("name")).alias("id"), *CHAPTER, "chapter_title", "name", "definition", "category", "page")


def model_edges(chapters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the same responses whose relation is known and whose two ends are nodes of the chapter."""
    parsed = chapters.filter(is_object(F.col("json"))).withColumn("e", F.from_json("json", RESPONSE)["edges"])
    each = parsed.select(*CHAPTER, F.explode("e").alias("e")).select(
        *CHAPTER, strip(F.col("e.source")).alias("s"), strip(F.col("e.target")).alias("t"), strip(F.col("e.relation_type")).alias("relation_type"), F.substring(strip(F.coalesce("e.description", F.lit(""))), 1, 200).alias("description")
    ).filter(F.col("relation_type").isin(*RELATIONS))
    ends = nodes.select(*CHAPTER, "name", "id")
    return (
        each.join(ends.withColumnsRenamed({"name": "s", "id": "source"}), [*CHAPTER, "s"]).join(ends.withColumnsRenamed({"name": "t", "id": "target"}), [*CHAPTER, "t"])
        .select("source", "target", "relation_type", "description")
    )


def candidate_terms(title: Column, content: Column, dictionary: Sequence[str] | Column, heading_scan: int = 20_000, definition_scan: int = 25_000) -> Column:
    """Ordered distinct terms of a chapter: its title, dictionary terms it contains, headings, subjects of
    definitions; the short title if there are none. The dictionary is a short list of terms, or a column
    with the array of those that the chapter contains (known_terms)."""
    bare = strip(F.regexp_replace(title, rf"(?U)^第\s*[{NUMERALS}\d]+\s*章\s*", ""))
    none = F.array().cast("array<string>")
    # What a heading and a definition look like, and how much of a chapter is searched for them.
    heading = F.lit(rf"(?dmU)^\s*#{{1,4}}\s*([{NUMERALS}\d、.\s]*[一-龥A-Za-z]{{2,24}})\s*$")
    definition = F.lit(r"([一-龥A-Za-z0-9]{2,12})(?:是指|是|指|为|包括|可分为|称为)")
    # most texts have no such mark at all, which is cheaper to see than to search
    heads = F.when(content.contains("#"), F.regexp_extract_all(F.substring(content, 1, heading_scan), heading, F.lit(1))).otherwise(none)
    subjects = F.when(content.rlike("[是指为]|包括"), F.regexp_extract_all(F.substring(content, 1, definition_scan), definition, F.lit(1))).otherwise(none)
    found = F.transform(F.concat(heads, subjects), clean_term)
    if isinstance(dictionary, Column):
        known = dictionary
    else:
        known = F.filter(F.array(*map(F.lit, dictionary)), lambda t: F.contains(content, t)) if dictionary else none
    terms = F.concat(F.filter(F.array(bare), is_valid_term), known, F.filter(found, is_valid_term))
    keyed = F.transform(terms, lambda t: F.struct(t.alias("t"), F.regexp_replace(t, r"(?U)\s+", "").alias("k")))
    # array_position gives the first place of a key
    first = lambda a: F.filter(a, lambda x, i: (F.array_position(F.transform(a, lambda y: y["k"]), x["k"]) == i + 1) & (F.length(x["k"]) > 0))
    short = F.coalesce(F.nullif(F.substring(title, 1, 12), F.lit("")), F.lit(CORE))
    kept = let(keyed, lambda a: F.transform(first(a), lambda x: x["t"]))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(short)))


def evidence_sentence(text: Column, term: Column) -> Column:
    """The sentence around the term's first place in text (white space squished), 260 characters at
    most; a fixed one if it isn't there."""

    def around(at: Column) -> Column:
        before = F.substring(text, F.lit(1), at - 1)
        start = F.when(before.contains("。"), F.length(before) - F.position(F.lit("。"), F.reverse(before)) + 1).otherwise(0)
        stop = F.position(F.lit("。"), text, at)
        end = F.when(stop > 0, stop).otherwise(F.least(F.length(text), at - 1 + 180) + 1)
        return F.substring(strip(F.substring(text, start + 1, end - start)), 1, 260)

    # Fixed value: the sentence.
    fixed = F.concat(term, F.lit(" 是本章教材文本中识别出的核心知识点。"))
    return let(F.position(term, text), lambda at: F.coalesce(F.when(at > 0, F.nullif(around(at), F.lit(""))), fixed))


def squish_inner(c: Column) -> Column:
    """Runs of white space as one space, also at the ends."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def known_terms(chapters: DataFrame, dictionary: DataFrame, name: str = "known") -> DataFrame:
    """chapters with the array of the terms of a dictionary table (ord, term) that their content contains, in order of ord."""
    return with_hits(chapters, dictionary, text="content", name=name).withColumn(name, F.col(f"{name}.term"))


def rule_nodes(chapters: DataFrame, dictionary: Sequence[str] | DataFrame, most: int = NODES_PER_CHAPTER) -> DataFrame:
    """The first candidate terms of each chapter as nodes, with their rank and evidence; the dictionary is a short list or a table (ord, term) of any length."""
    rows = chapters.filter(F.length(strip(F.col("content"))) > 0)
    if isinstance(dictionary, DataFrame):
        rows = known_terms(rows, dictionary, "__known")
        dictionary = F.col("__known")
    rows = rows.withColumn("terms", candidate_terms(F.col("title"), F.col("content"), dictionary)).drop("__known")
    # evidence is found before the rows multiply, so that contents don't
    told = let(squish_inner(F.col("content")), lambda text: F.transform(F.slice("terms", 1, most), lambda t: F.struct(t.alias("name"), evidence_sentence(text, t).alias("definition"))))
    each = rows.select(*CHAPTER, "title", "page_start", F.posexplode(told).alias("at", "n"))
    return each.select(
        node_id(F.col("textbook_id"), F.col("chapter_id"), F.col("n.name")).alias("id"), *CHAPTER, F.col("title").alias("chapter_title"), "n.name", "n.definition",
        F.lit(BY_RULE).alias("category"), F.col("page_start").alias("page"), (F.col("at") + 1).alias("rank"),
    )


def rule_edges(nodes: DataFrame) -> DataFrame:
    """The first node contains the next five; these are parallel to their neighbours."""
    chapter = nodes.filter("rank <= 6").groupBy(*CHAPTER).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "name"))).alias("n"))
    edge = lambda s, t, kind, words: F.struct(s["id"].alias("source"), t["id"].alias("target"), F.lit(kind).alias("relation_type"), F.concat(s["name"], F.lit(" 与 "), t["name"], F.lit(words)).alias("description"))
    rest = F.slice("n", 2, 5)
    contains = F.transform(rest, lambda t: edge(F.col("n")[0], t, "contains", " 同属本章核心内容"))
    beside = F.transform(F.slice("n", 3, 4), lambda t, i: edge(F.get(F.col("n"), i + 1), t, "parallel", " 是本章相邻知识点"))
    return chapter.select(F.explode(F.concat(contains, F.when(F.size("n") > 2, beside).otherwise(F.array().cast("array<struct<source:string,target:string,relation_type:string,description:string>>")))).alias("e")).select("e.*")


def content_reuse(chapters: DataFrame) -> DataFrame:
    """Each distinct content once: (content_key, n_chapters, first id) joined back to chapters as processed_by."""
    keyed = chapters.withColumn("content_key", F.md5("content"))
    firsts = keyed.groupBy("content_key").agg(F.count("*").alias("n_chapters"), F.min(F.concat_ws(":", *CHAPTER)).alias("processed_by"))
    return keyed.join(firsts, "content_key").select(*CHAPTER, "content_key", "n_chapters", "processed_by")


def extraction_progress(chapters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per textbook: chapters, chapters with nodes, nodes."""
    n = nodes.groupBy(*CHAPTER).agg(F.count("*").alias("n"))
    return chapters.join(n, CHAPTER, "left").groupBy("textbook_id").agg(F.count("*").alias("chapters"), F.count("n").alias("done"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))


def prompts(chapters: DataFrame) -> DataFrame:
    """Adds prompt: title and shortened content, for an external batch model."""
    return chapters.withColumn("prompt", F.concat(F.lit("章节："), F.col("title"), F.lit("\n\n"), truncate_middle(F.col("content"))))
