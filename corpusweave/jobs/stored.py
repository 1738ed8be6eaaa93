"""Derived tables that several queries read: built once from the given tables as they are, then read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.shared import shared_dir
from corpusweave.jobs.standins import books, chapters, table
from corpusweave.operators import cells, chunk, encode, postings, retrieve
from corpusweave.sources.readers import table_state

#: (session, name, state of the given tables) -> folder
_BUILT: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, given: tuple[str, ...], build: Callable[[str], object]) -> str:
    """The folder that build(folder) has filled; it is filled anew when a given table has changed since."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, sf_dir, *(table_state(spark, f"{sf_dir}/{t}.parquet") for t in given))
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/stored/{uuid.uuid4().hex}"
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


def chunks(spark: SparkSession, sf_dir: str, size: int = chunk.SIZE) -> DataFrame:
    """The chunk table of all chapters."""
    made = lambda path: chunk.chunk_table(chapters(spark, sf_dir), books(spark, sf_dir), size=size).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(stored(spark, sf_dir, f"chunks {size}", ("documents",), made))


def vectors(spark: SparkSession, sf_dir: str, size: int = chunk.SIZE) -> DataFrame:
    """(chunk_id, embedding) of all chunks."""
    made = lambda path: encode.encode(chunks(spark, sf_dir, size).select("chunk_id", "text"), "text").select("chunk_id", "embedding").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(stored(spark, sf_dir, f"vectors {size}", ("documents",), made))


def index(spark: SparkSession, sf_dir: str, size: int = chunk.SIZE) -> postings.Postings:
    """The lexical index of all chunks; chunks of a chapter lie in one block."""

    def made(path: str) -> None:
        c = chunks(spark, sf_dir, size).withColumn("place", F.concat_ws(" ", "textbook_id", "chapter_id"))
        postings.write_postings(retrieve.chunk_words(c, retrieve.PAIRS, "place"), path, place="place")

    return postings.read_postings(spark, stored(spark, sf_dir, f"postings {size}", ("documents",), made))


def embedding_cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    """The given vectors, in cells."""
    return cells.read_cells(spark, stored(spark, sf_dir, "embeddings", ("embeddings",), lambda path: cells.write_cells(table(spark, sf_dir, "embeddings"), path, "vec_id")))
