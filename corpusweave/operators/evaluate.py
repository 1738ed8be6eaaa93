"""Retrieval evaluation: keyword and book hits per case, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eval_cases(cases: DataFrame, hits: DataFrame, by: str | None = None) -> DataFrame:
    """(id, type, keyword_hit, book_hit, top1, top1_chapter) for every case (id, type, expected_keywords, expected_textbooks).

    hits has question_id, rank, text, textbook_title, chapter_title. A keyword counts when it stands
    anywhere in the joined texts of the hits, a book when it stands in the title of one. With `by`, a
    column of cases and hits (such as the setting of a search), cases have hits of their own value alone.
    """
    keys = [by] if by else []
    got = hits.groupBy(*keys, F.col("question_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("rank", "text")))["text"], "\n").alias("texts"), F.collect_set("textbook_title").alias("titles"), F.min_by("textbook_title", "rank").alias("top1"), F.min_by("chapter_title", "rank").alias("top1_chapter")
    )
    rows = cases.join(got, [*keys, "id"], "left")
    keyword = F.exists("expected_keywords", lambda k: F.contains(F.coalesce("texts", F.lit("")), k))
    book = F.exists("expected_textbooks", lambda b: F.exists(F.coalesce("titles", F.array().cast("array<string>")), lambda t: F.contains(t, b)))
    return rows.select(*keys, "id", "type", keyword.alias("keyword_hit"), book.alias("book_hit"), F.coalesce("top1", F.lit("")).alias("top1"), F.coalesce("top1_chapter", F.lit("")).alias("top1_chapter"))


def roll_up(results: DataFrame, by: str | None = None) -> DataFrame:
    """cases and the share of hits, rounded to 3 places: one row, 0 without cases; with `by` a row for each of its values."""
    mean = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("int")), 3), F.lit(0.0)).alias(f"{c}_at_k")
    return results.groupBy(*([by] if by else [])).agg(F.count("*").alias("cases"), mean("keyword_hit"), mean("book_hit"))


def sweep(settings: list[str], hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(setting, cases, keyword_hit_at_k, book_hit_at_k) for each setting, whether it has hits or not; hits have the setting that found them.

    All settings are judged in one plan, keyed by their name. They are few and named by the caller.
    """
    named = cases.sparkSession.createDataFrame([(s,) for s in settings], "setting string")
    return roll_up(eval_cases(cases.crossJoin(F.broadcast(named)), hits, "setting"), "setting")  # a row a setting
