"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, whatever
further columns these have. A stage works on all that it is given: null and empty texts are texts
without letters, which the first stage drops; a null doc_id is an id like others, the last in its
order where one row of a group stays; rows that repeat id and text are one after exact_dedup; an
empty table gives an empty one, and an empty benchmark drops nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusweave.llm import languages, leaks, naming, pieces, shingles
from corpusweave.llm.common import written
from corpusweave.sources.readers import read_table

#: Shares of the largest out-of-place distance below which a text is like no language learned.
LEAST_LIKENESS = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts unlike every language profile; with no language to learn, only those without letters."""
    return languages.keep_known(docs, LEAST_LIKENESS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of texts that are equal after lower-casing A-Z; of rows that repeat it, one."""
    return naming.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of texts with five-word Jaccard similarity 0.8 or more; texts without words are one."""
    return shingles.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null passages and those without words are held by none."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text: one row per row."""
    return pieces.digests(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: Near-duplicate components and latent retrieval are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
