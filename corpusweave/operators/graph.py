"""The knowledge graph as nodes and edges: name dedup, rewriting, weights, search, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import snippet, space_free_key
from corpusweave.operators.terms import with_hits


def dedupe_nodes(nodes: DataFrame, by_book: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept nodes, id -> kept_id): of equal names the longest definition stays, then the smallest id.

    by_book tells books apart; without it, as in the view of one book, the name alone is the key.
    """
    keyed = nodes.withColumn("name_key", space_free_key(F.col("name")))
    keys = ["textbook_id", "name_key"] if by_book else ["name_key"]
    length = F.length(F.coalesce("definition", F.lit("")))
    best = keyed.groupBy(*keys).agg(F.min(F.struct((-length).alias("l"), "id"))["id"].alias("kept_id"))
    mapping = keyed.select("id", *keys).join(best, keys).select("id", "kept_id")
    return nodes.join(best.select(F.col("kept_id").alias("id")), "id", "left_semi"), mapping


def rewrite_edges(edges: DataFrame, nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between kept nodes: ends mapped, dangling ones and loops dropped, one per relation (smallest description)."""
    s, t = mapping.withColumnsRenamed({"id": "source", "kept_id": "s"}), mapping.withColumnsRenamed({"id": "target", "kept_id": "t"})
    moved = edges.join(s, "source", "left").join(t, "target", "left").select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "relation_type", "description").filter("source <> target")
    there = nodes.select("id")
    kept = moved.join(there.withColumnRenamed("id", "source"), "source", "left_semi").join(there.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.groupBy("source", "target", "relation_type").agg(F.min("description").alias("description"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): in and out."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def node_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds degree, frequency (kept nodes of the same name) and the weights of both views."""
    names = nodes.withColumn("name_key", space_free_key(F.col("name")))
    often = names.groupBy("name_key").agg(F.count("*").alias("frequency"))
    rows = names.join(often, "name_key").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.withColumns({"book_weight": F.col("degree") + 1, "weight": F.greatest(F.col("degree") + 1, F.col("frequency") * 3)}).drop("name_key")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, textbook_count, categories."""
    n = nodes.agg(F.count("*").alias("node_count"), F.countDistinct("textbook_id").alias("textbook_count"), F.sort_array(F.collect_set("category")).alias("categories"))
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each


def search_nodes(nodes: DataFrame, titles: DataFrame, query: str) -> DataFrame:
    """Nodes whose name, definition, chapter or book title contains the query, whatever the case."""
    rows = nodes.join(titles.select("textbook_id", F.col("title").alias("textbook_title")), "textbook_id", "left")
    return rows.filter(F.lower(F.concat_ws(" ", "name", "definition", "chapter_title", "textbook_title")).contains(query.strip().lower()))


def search_nodes_for(nodes: DataFrame, titles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): for each query (query_id, query) the nodes that search_nodes finds, all queries in one pass over the nodes; blank queries are left out."""
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("term"))
    rows = nodes.join(titles.select("textbook_id", F.col("title").alias("textbook_title")), "textbook_id", "left")
    texts = rows.select("id", F.lower(F.concat_ws(" ", "name", "definition", "chapter_title", "textbook_title")).alias("text"))
    found = with_hits(texts, asked.select("term", F.lit(0).alias("ord"))).select("id", F.explode("hits.term").alias("term"))
    return found.join(asked, "term").select("query_id", "id")


def click_size(weight: Column, clicks: Column) -> Column:
    return F.least(F.lit(72), 15 + 3 * weight + 2 * clicks)


def clicked_sizes(nodes: DataFrame, clicks: DataFrame) -> DataFrame:
    """(id, clicks, size) from weighted nodes and one row (id) per click."""
    n = clicks.groupBy("id").agg(F.count("*").alias("clicks"))
    return nodes.join(n, "id", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0))).select("id", "clicks", click_size(F.col("weight"), F.col("clicks")).alias("size"))


def neighbourhood(focus: DataFrame, edges: DataFrame) -> DataFrame:
    """(focus, neighbour, relation_type) for each id of focus."""
    both = edges.select(F.col("source").alias("focus"), F.col("target").alias("neighbour"), "relation_type").unionByName(edges.select(F.col("target").alias("focus"), F.col("source").alias("neighbour"), "relation_type"))
    return both.join(focus.select(F.col("id").alias("focus")), "focus", "left_semi").distinct()


def source_snippets(nodes: DataFrame, chapters: DataFrame) -> DataFrame:
    """(id, snippet): where the node's chapter names it."""
    rows = nodes.select("id", "textbook_id", "chapter_id", "name").join(chapters.select("textbook_id", "chapter_id", "content"), ["textbook_id", "chapter_id"])
    return rows.select("id", snippet(F.col("content"), F.col("name")).alias("snippet"))
