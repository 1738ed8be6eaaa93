"""The three workloads end to end, on the library's own tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.shared import written
from corpusweave.operators import align, chunk, encode, extract, graph, integrate, retrieve
from corpusweave.operators.words import PAIRS, Tokenizer

NODE = ["id", "textbook_id", "chapter_id", "chapter_title", "name", "definition", "category", "page"]


def extract_graph(chapters: DataFrame, responses: DataFrame, dictionary: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chapters: from a model's answer where there is a good one, by rules where
    there is none or a broken one, nothing for blank chapters and answers that are no object."""
    routed = written(extract.response_route(chapters, responses))
    answered, ruled = routed.filter("route = 'model'"), written(extract.rule_nodes(routed.filter("route = 'rules'"), dictionary))
    from_model = written(extract.model_nodes(answered))
    edges = extract.model_edges(answered, from_model).unionByName(extract.rule_edges(ruled))
    return from_model.select(NODE).unionByName(ruled.select(NODE)), edges


def graph_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weighted nodes, edges) after name dedup within books."""
    kept, mapping = graph.dedupe_nodes(nodes)
    new = written(graph.rewrite_edges(edges, kept, mapping))
    return graph.node_weights(kept, new), new


def integrate_books(run_id: str, textbooks: DataFrame, chapters: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, ratio: float = integrate.BUDGET) -> tuple[DataFrame, DataFrame]:
    """(decisions, one row of statistics): clusters by name and, where node vectors (id, group_id,
    embedding) are given, by similarity; then merges and the budgeted rest."""
    books, mine = integrate.eligible(textbooks, nodes)
    n = written(integrate.weighted(mine, edges))
    if vectors is None:
        found = written(align.lexical_clusters(n))
    else:
        found = written(align.combined_clusters(n, align.auto_merged(align.similarity_pairs(vectors))))
    merged = written(integrate.merge_decisions(run_id, n, found, chapters, books))
    decisions = written(merged.unionByName(integrate.budget_decisions(run_id, n, found, merged, chapters, books, ratio)))
    return decisions, integrate.run_stats(decisions, n, books)


def answer_questions(textbooks: DataFrame, chapters: DataFrame, questions: DataFrame, encoder: encode.Encoder | None = None, tokenizer: Tokenizer = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(answers, hits) for a batch of questions (question_id, question): both legs fused, five hits each."""
    c = written(chunk.chunk_table(chapters, textbooks))
    index = written(encode.encode(c.select("chunk_id", "text"), "text", encoder, tokenizer=tokenizer).select("chunk_id", "embedding"))
    asked = written(encode.encode(questions, "question", encoder, tokenizer=tokenizer).select("question_id", "embedding"))
    vectors = retrieve.vector_top(index, asked)
    scores = written(retrieve.bm25_scores(written(retrieve.chunk_words(c, tokenizer)), questions, tokenizer))
    lexical = retrieve.ranked(scores.filter(F.col("bm25") > 0), "bm25", "bm25_rank")
    hits = written(retrieve.with_chunks(retrieve.fuse(vectors, lexical, scores, index=index, questions=asked), c))
    return retrieve.answers(questions, hits), hits
