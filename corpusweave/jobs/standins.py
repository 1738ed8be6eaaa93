"""The library's tables made from the given ones, in Spark and in SQL.

Books are the sources of documents, chapters the documents; nodes and edges come from the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.text import CHAPTER_TITLE  # noqa: F401
from corpusweave.operators import extract, segment
from corpusweave.sources.readers import read_table

# The terms of the queries' dictionary, in order.
TERMS = ("the", "and", "with", "nicht", "und", "keit", "para", "como", "que", "avec", "dans", "pour")
RUN = "run1"
#: Small, so that the budget overflows on the given tables.
RATIO = 0.012
CANDIDATE, MERGE = 0.40, 0.45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("textbook_id")).agg(F.concat(F.lit("Book "), F.first("source")).alias("title"), F.sum("n_chars").alias("total_chars"), F.lit("done").alias("parse_status"), F.timestamp_seconds(F.min("doc_id")).alias("uploaded_at"))


BOOKS = """books AS (
  SELECT source AS textbook_id, 'Book ' || source AS title, sum(n_chars)::BIGINT AS total_chars, 'done' AS parse_status, make_timestamp(min(doc_id) * 1000000) AS uploaded_at FROM documents GROUP BY source
)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    page = (F.col("doc_id") % 50 + 1).cast("int")
    return d.select(
        F.col("source").alias("textbook_id"), segment.chapter_id(F.col("doc_id")).alias("chapter_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.col("n_chars").alias("char_count"), page.alias("page_start"), (page + 2).alias("page_end")
    )


CHAPTERS = """chapters AS (
  SELECT source AS textbook_id, printf('ch_%03d', doc_id) AS chapter_id, string_split(text, chr(10))[1] AS title, text AS content, n_chars AS char_count, (doc_id % 50 + 1)::INT AS page_start, (doc_id % 50 + 3)::INT AS page_end FROM documents
)"""

_BAD = "'[，。？！；：（）()【】\\[\\]『』]|[的了认作为]$|^(主要|尤其|特别|目前|值得|图|表)'"


def sql_list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rule_nodes(chapters(spark, sf_dir), TERMS)


# no chapter has a definition or heading in the sense of the rules, so title and dictionary are all
NODES = f"""{CHAPTERS}, terms(ord, term) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS, 1))}),
cand AS (
  SELECT textbook_id, chapter_id, 0 AS ord, trim(regexp_replace(title, '^第\\s*[一二三四五六七八九十百零\\d]+\\s*章\\s*', '')) AS name FROM chapters
), valid AS (
  SELECT * FROM cand WHERE length(name) BETWEEN 2 AND 12 AND NOT regexp_matches(name, {_BAD})
  UNION ALL SELECT textbook_id, chapter_id, ord, term FROM chapters, terms WHERE contains(content, term)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY textbook_id, chapter_id, replace(name, ' ', '') ORDER BY ord) AS k FROM valid
), picked AS (
  SELECT textbook_id, chapter_id, ord, name FROM firsts WHERE k = 1
  UNION ALL SELECT c.textbook_id, c.chapter_id, 0, substr(c.title, 1, 12) FROM chapters c ANTI JOIN valid v ON c.textbook_id = v.textbook_id AND c.chapter_id = v.chapter_id
), nth AS (
  SELECT *, row_number() OVER (PARTITION BY textbook_id, chapter_id ORDER BY ord) AS rank FROM picked
), compact AS (
  SELECT n.*, c.title AS chapter_title, c.page_start, regexp_replace(c.content, '\\s+', ' ', 'g') AS t, strpos(regexp_replace(c.content, '\\s+', ' ', 'g'), n.name) AS place
  FROM nth n JOIN chapters c USING (textbook_id, chapter_id) WHERE rank <= 10
), cut AS (
  SELECT *, CASE WHEN contains(substr(t, 1, place - 1), '。') THEN place - strpos(reverse(substr(t, 1, place - 1)), '。') ELSE 0 END AS s, strpos(substr(t, place), '。') AS e FROM compact
), nodes AS (
  SELECT textbook_id || '_' || chapter_id || '_' || substr(md5(name), 1, 6) AS id, textbook_id, chapter_id, chapter_title, name,
    CASE WHEN place > 0 THEN substr(trim(substr(t, s + 1, CASE WHEN e > 0 THEN place + e - 1 - s ELSE least(length(t), place + 179) + 1 - s END)), 1, 260) ELSE name || ' 是本章教材文本中识别出的核心知识点。' END AS definition,
    '启发式概念' AS category, page_start AS page, rank::INT AS rank
  FROM cut
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rule_edges(nodes(spark, sf_dir))


EDGES = f"""{NODES}, edges AS (
  SELECT a.id AS source, b.id AS target, 'contains' AS relation_type, a.name || ' 与 ' || b.name || ' 同属本章核心内容' AS description
  FROM nodes a JOIN nodes b USING (textbook_id, chapter_id) WHERE a.rank = 1 AND b.rank BETWEEN 2 AND 6
  UNION ALL SELECT a.id, b.id, 'parallel', a.name || ' 与 ' || b.name || ' 是本章相邻知识点'
  FROM nodes a JOIN nodes b USING (textbook_id, chapter_id) WHERE a.rank BETWEEN 2 AND 5 AND b.rank = a.rank + 1
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


QUESTIONS = """questions AS (
  SELECT item_id AS question_id, text AS question FROM benchmark
)"""
