"""Retrieval: tokens, BM25, vector ranks, fusion, and answers with citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusweave.functions.shared import written
from corpusweave.operators.words import PAIRS, Tokenizer

DEPTH, CONSTANT, TOP = 30, 60, 5
K1, B, FLOOR = 1.5, 0.75, 0.25
CONTEXT_CHARS, SNIPPET_CHARS, SNIPPETS = 1100, 180, 3
# Fixed value: what is said where nothing was found.
REFUSAL = "当前知识库中未找到相关信息。"
BLOCK = 4096
#: Vectors of a batch that are multiplied at once.
SLICE = 1024


def chunk_words(chunks: DataFrame, tokenizer: Tokenizer = PAIRS, *more: str) -> DataFrame:
    """(chunk_id, tokens) of title, chapter, section and text; more names columns of chunks to keep."""
    return chunks.select("chunk_id", *more, tokenizer.column(F.concat_ws(" ", "textbook_title", "chapter_title", "section_title", "text")).alias("tokens"))


def corpus_size(words: DataFrame) -> DataFrame:
    """One row: n chunks and their average length."""
    return words.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def bm25_statistics(words: DataFrame) -> DataFrame:
    """(token, df, idf): logarithmic odds; a negative one becomes a quarter of the mean over all tokens."""
    df = words.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = df.crossJoin(corpus_size(words).select("n")).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(mean).select("token", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row


def bm25_scores(words: DataFrame, questions: DataFrame, tokenizer: Tokenizer = PAIRS) -> DataFrame:
    """(question_id, chunk_id, bm25) of chunks that share a token with the question, rounded to 6 places; zero scores are left out.

    Only tokens that are asked for get postings; document frequencies of all tokens come from one
    pass of their own.
    """
    asked = written(questions.select("question_id", F.explode(tokenizer.column(F.col("question"))).alias("token")).groupBy("question_id", "token").agg(F.count("*").alias("times")))
    some = asked.select("token").distinct()
    each = words.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).join(some, "token", "left_semi")
    found = each.groupBy("token", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    terms = asked.join(bm25_statistics(words).join(some, "token", "left_semi"), "token")
    hits = terms.join(found, "token").crossJoin(corpus_size(words).select("avgdl"))  # one row
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    score = F.round(F.sum(F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + norm)), 6)
    return hits.groupBy("question_id", "chunk_id").agg(score.alias("bm25")).filter("bm25 <> 0")


def ranked(scores: DataFrame, score: str, rank: str, depth: int = DEPTH) -> DataFrame:
    """The best of each question with their rank from 1; ties by chunk."""
    order = Window.partitionBy("question_id").orderBy(F.desc(score), "chunk_id")
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= depth)


def bm25_top(words: DataFrame, questions: DataFrame, depth: int = DEPTH, tokenizer: Tokenizer = PAIRS) -> DataFrame:
    return ranked(bm25_scores(words, questions, tokenizer).filter("bm25 > 0"), "bm25", "bm25_rank", depth)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _best(asks: np.ndarray, has: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the best rows of `has`, which lie in order of their ids, for each row of asks."""
    return _first(asks @ has.T, depth)


def _first(products: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    scores = np.round(products, 6)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :depth]
    return best, np.take_along_axis(scores, best, 1)


def _by_scan(rows: DataFrame, asked: list, depth: int, schema: T.StructType) -> DataFrame:
    """The best rows of each batch for the questions (id, vector), which every task gets."""
    shared = rows.sparkSession.sparkContext.broadcast(([r[0] for r in asked], np.array([r[1] for r in asked], np.float64)))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asks = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            # a few vectors at a time become a matrix; in order of their ids only the scores are put
            order = pc.sort_indices(batch.column(0)).to_numpy()
            every = np.concatenate([asks @ _matrix(batch.column(1).slice(at, SLICE)).T for at in range(0, batch.num_rows, SLICE)], 1)
            best, scores = _first(every[:, order], depth)
            ids = batch.column(0).take(pa.array(order[best.ravel()]))
            yield pa.RecordBatch.from_arrays([pa.array([n for n in names for _ in range(best.shape[1])], kinds[0]), ids, pa.array(scores.ravel())], schema.names)

    return rows.mapInArrow(run, schema)


def _by_cells(rows: DataFrame, asked: DataFrame, n_asked: int, depth: int, block: int, schema: T.StructType) -> DataFrame:
    """Blocks of questions meet blocks of rows; each pair of blocks gives out its best."""
    nq, nr = -(-n_asked // block), max(1, -(-rows.count() // block))
    kinds = {f.name: f.dataType for f in (*rows.schema, *asked.schema)}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    a = asked.select("question_id", none("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("question_id"), F.lit(nq)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("r"))
    b = rows.select(none("question_id"), "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), F.pmod(F.xxhash64("chunk_id"), F.lit(nr)).alias("r"))

    def product(part: pd.DataFrame) -> pd.DataFrame:
        asks, has = part[part["chunk_id"].isna()], part[part["chunk_id"].notna()].sort_values("chunk_id")
        if not len(asks) or not len(has):
            return pd.DataFrame({"question_id": [], "chunk_id": [], "vector": []})
        best, scores = _best(np.array(asks["embedding"].tolist()), np.array(has["embedding"].tolist()), depth)
        return pd.DataFrame({"question_id": np.repeat(asks["question_id"].to_numpy(), best.shape[1]), "chunk_id": has["chunk_id"].to_numpy()[best.ravel()], "vector": scores.ravel()})

    return a.unionByName(b).groupBy("q", "r").applyInPandas(product, schema)


def vector_top(index: DataFrame, questions: DataFrame, depth: int = DEPTH, block: int = BLOCK, id_name: str = "chunk_id") -> DataFrame:
    """(question_id, chunk_id, vector, vector_rank): the nearest rows of index (chunk_id, embedding) to each question (question_id, embedding).

    Exact. Up to `block` questions are sent to all tasks and the index is only read; more of them
    meet it in pairs of blocks. Either way the best of each batch or pair are ranked again. Rows
    without a vector are absent. Scores are rounded to 6 places; ties by id.
    """
    rows = index.dropna(subset=["embedding"]).select(F.col(id_name).alias("chunk_id"), "embedding")
    asked = questions.dropna(subset=["embedding"]).select("question_id", "embedding")
    schema = T.StructType([asked.schema["question_id"], rows.schema["chunk_id"]]).add("vector", "double")
    few = asked.limit(block + 1).collect()
    if not few:
        found = rows.sparkSession.createDataFrame([], schema)
    elif len(few) <= block:
        found = _by_scan(rows, few, depth, schema)
    else:
        found = _by_cells(rows, asked, asked.count(), depth, block, schema)
    return ranked(found, "vector", "vector_rank", depth)


def fuse(vectors: DataFrame, lexical: DataFrame, scores: DataFrame | None = None, constant: int = CONSTANT, top: int = TOP, index: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """(question_id, chunk_id, rank, score, vector, bm25): reciprocal rank fusion of two ranked lists.

    Ties go by vector rank, then lexical rank, then id. Both scores are those of the chunk even where
    it is outside a list: scores (question_id, chunk_id, bm25) fills in lexical ones, the vectors of
    index (chunk_id, embedding) and questions (question_id, embedding) the others; what stays
    unknown is 0. Scores are rounded to 6 places.
    """
    both = vectors.select("question_id", "chunk_id", "vector", "vector_rank").join(lexical.select("question_id", "chunk_id", "bm25", "bm25_rank"), ["question_id", "chunk_id"], "full")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    rows = both.withColumn("score", F.round(part("vector_rank") + part("bm25_rank"), 9))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("question_id", "chunk_id", "rank", "score", "vector", "bm25")
    if scores is not None or index is not None:
        best = written(best)  # `top` rows a question
    if scores is not None:
        best = best.join(scores.select("question_id", "chunk_id", F.col("bm25").alias("any_bm25")), ["question_id", "chunk_id"], "left").withColumn("bm25", F.coalesce("bm25", "any_bm25")).drop("any_bm25")
    if index is not None:
        far = best.filter("vector IS NULL").select("question_id", "chunk_id")
        pairs = far.join(index.dropna(subset=["embedding"]).select("chunk_id", "embedding"), "chunk_id").join(questions.select("question_id", F.col("embedding").alias("asked")), "question_id")
        dots = pairs.select("question_id", "chunk_id", F.round(F.aggregate(F.zip_with("embedding", "asked", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6).alias("any_vector"))
        best = best.join(dots, ["question_id", "chunk_id"], "left").withColumn("vector", F.coalesce("vector", "any_vector")).drop("any_vector")
    return best.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("vector", "bm25")})


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the columns of their chunks; hits are few, so chunks are filtered by them."""
    return hits.join(chunks.select("chunk_id", "textbook_title", "chapter_title", "page_start", "text"), "chunk_id")


def _ordered(hits: DataFrame, value: Column, name: str, sep: str | None = "\n\n") -> DataFrame:
    # a question has at most as many hits as were asked for
    got = hits.select("question_id", F.struct("rank", value.alias("v")).alias("h")).groupBy("question_id").agg(F.sort_array(F.collect_list("h"))["v"].alias("v"))
    return got.select("question_id", (F.array_join("v", sep) if sep is not None else F.col("v")).alias(name))


def context_blocks(hits: DataFrame, questions: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """(question_id, context, prompt)."""
    line = F.concat(F.format_string("[%d] 来源：%s，%s，第%d页\n", "rank", "textbook_title", "chapter_title", "page_start"), F.substring("text", 1, chars))
    prompt = F.concat(F.lit("上下文：\n"), F.col("context"), F.lit("\n\n问题："), F.col("question"), F.lit("\n\n请给出简洁、可核查的中文回答。"))
    return _ordered(hits, line, "context").join(questions.select("question_id", "question"), "question_id").select("question_id", "context", prompt.alias("prompt"))


def citations(hits: DataFrame) -> DataFrame:
    """(question_id, position, textbook, chapter, page, relevance): the first hit of each page, in order."""
    page = F.coalesce("page_start", F.lit(0)).cast("int")
    first = hits.groupBy("question_id", F.col("textbook_title").alias("textbook"), F.col("chapter_title").alias("chapter"), page.alias("page")).agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))
    order = Window.partitionBy("question_id").orderBy("rank")
    return first.select("question_id", F.row_number().over(order).alias("position"), "textbook", "chapter", "page", F.round("score", 4).alias("relevance"))


def extractive_answers(hits: DataFrame, chars: int = SNIPPET_CHARS, most: int = SNIPPETS) -> DataFrame:
    line = F.concat(F.lit("- "), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, chars), F.format_string(" [%s, %s, 第%d页]", "textbook_title", "chapter_title", "page_start"))
    return _ordered(hits.filter(F.col("rank") <= most), line, "answer", "\n").select("question_id", F.concat(F.lit("基于当前检索到的教材原文，相关信息如下：\n"), "answer").alias("answer"))


def source_chunks(hits: DataFrame) -> DataFrame:
    return _ordered(hits, F.col("chunk_id"), "source_chunks", None)


def answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, answer, source_chunks) for every question; a fixed refusal where nothing was found."""
    rows = questions.select("question_id").join(extractive_answers(hits), "question_id", "left").join(source_chunks(hits), "question_id", "left")
    return rows.select("question_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), F.coalesce("source_chunks", F.array().cast("array<string>")).alias("source_chunks"))
