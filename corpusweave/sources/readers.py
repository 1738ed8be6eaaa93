"""Readers of corpora and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL = "id string, type string, question string, expected_keywords array<string>, expected_textbooks array<string>"
PAGES = "doc_id string, page_no int, text string"
OUTLINE = "doc_id string, pos int, level int, title string, page int"


#: Bytes of files up to which a table's rows are dealt out anew.
SMALL = 64 << 20


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, time of the last change) of what lies at path now."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = files.getContentSummary(where)
    return size.getLength(), size.getFileCount(), files.getFileStatus(where).getModificationTime()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One of few bytes may be a single row group, which is a single task however
    much is to be done with its rows, so these are dealt out over all cores."""
    rows = spark.read.parquet(path)
    return rows.repartition(spark.sparkContext.defaultParallelism) if table_state(spark, path)[0] <= SMALL else rows


def titled(files: DataFrame) -> DataFrame:
    """(doc_id, filename, title, content) of (filename, content): named by the filename, titled by its stem."""
    return files.select(F.concat(F.lit("tb_"), F.substring(F.md5("filename"), 1, 8)).alias("doc_id"), "filename", F.regexp_replace("filename", r"\.[^.]*\z", "").alias("title"), "content")


def _files(rows: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("filename"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, filename, title, content): each file is a document, titled by its stem."""
    return titled(_files(spark.read.text(path, wholetext=True)))


def stream_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, modified) of files as they arrive in a folder."""
    return _files(spark.readStream.text(path, wholetext=True))


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines; blank lines are skipped."""
    return spark.read.schema(EVAL).json(path)


def read_paged(spark: SparkSession, pages: str, outline: str) -> tuple[DataFrame, DataFrame]:
    """Paged text and outlines as Parquet tables, the input in place of binary formats."""
    return spark.read.schema(PAGES).parquet(pages), spark.read.schema(OUTLINE).parquet(outline)
