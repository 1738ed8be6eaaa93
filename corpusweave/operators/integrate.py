"""Merge, keep and remove decisions under a character budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.ranking import numbered, running_total
from corpusweave.functions.shared import written
from corpusweave.functions.text import excerpt, mark_free_key, strip
from corpusweave.operators.graph import degrees

BUDGET = 0.28
MERGE_CHARS, KEEP_CHARS = 900, 650
ACTIONS = ("merge", "keep", "remove")
# Confidences of the decisions.
EXACT, SIMILAR, KEEP, REMOVE, MANUAL, DIALOGUE = 0.86, 0.78, 0.82, 0.74, 0.97, 0.96


def eligible(textbooks: DataFrame, nodes: DataFrame, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(finished textbooks, their nodes); refuses fewer than two books or nodes of fewer than two."""
    books = textbooks.filter(F.col("parse_status") == "done")
    if wanted:
        books = books.filter(F.col("textbook_id").isin(*wanted))
    mine = nodes.join(books.select("textbook_id"), "textbook_id", "left_semi")
    if books.select("textbook_id").limit(2).count() < 2:
        raise ValueError("two finished textbooks are needed")
    if mine.select("textbook_id").distinct().limit(2).count() < 2:
        raise ValueError("nodes of two textbooks are needed")
    return books, mine


def importance(degree: Column, definition: Column) -> Column:
    length, bare = F.length(F.coalesce(definition, F.lit(""))), F.length(strip(F.coalesce(definition, F.lit(""))))
    return degree * 0.45 + F.least(length, F.lit(220)) / 220 * 0.35 + F.when(bare >= 12, 0.2).otherwise(0.0)


def weighted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree (over all edges) and importance, rounded to 9 places so that ties are ties."""
    rows = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.withColumn("importance", F.round(importance(F.col("degree"), F.col("definition")), 9))


def canonical(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster_id, canonical_id, members): most important node of each cluster, then the smallest id."""
    rows = found.join(nodes.select("id", "importance"), "id")
    return rows.groupBy("cluster_id").agg(F.min(F.struct((-F.col("importance")).alias("i"), "id"))["id"].alias("canonical_id"), F.count("*").alias("members"))


def with_excerpts(nodes: DataFrame, chapters: DataFrame, limit: int) -> DataFrame:
    """nodes with source_excerpt of their chapters, or of their definitions where the chapter is missing."""
    text = chapters.select("textbook_id", "chapter_id", "content")
    rows = nodes.join(text, ["textbook_id", "chapter_id"], "left")
    return rows.withColumn("source_excerpt", excerpt(strip(F.coalesce("content", "definition", F.lit(""))), F.col("name"), F.col("definition"), limit)).drop("content")


def source_ref(n: Column | None = None) -> Column:
    return F.concat(F.col("textbook_id"), F.lit(":"), F.col("chapter_id"), F.lit(":p"), F.coalesce("page", F.lit(0)).cast("string"), F.lit(":"), F.col("name"))


def decision_id(run_id: str, action: str, index: Column) -> Column:
    return F.format_string(f"{run_id}_{action}_%04d", index)


def merge_confidence(nodes: DataFrame, found: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(cluster_id, confidence): higher for one name; not below the mean of the run's "same" verdicts."""
    rows = found.join(nodes.select("id", mark_free_key(F.col("name")).alias("key")), "id")
    base = rows.groupBy("cluster_id").agg(F.when(F.min("key") == F.max("key"), EXACT).otherwise(SIMILAR).alias("base"))
    if verdicts is None:
        return base.withColumnRenamed("base", "confidence")
    mean = verdicts.filter("verdict = 'same'").agg(F.avg("confidence").alias("mean"))
    return base.crossJoin(mean).select("cluster_id", F.when(F.col("mean").isNotNull(), F.round(F.greatest("base", "mean"), 3)).otherwise(F.col("base")).alias("confidence"))  # mean: one row


def merge_reasons(nodes: DataFrame, found: DataFrame, textbooks: DataFrame, best: DataFrame) -> DataFrame:
    """(cluster_id, reason): the books in order of their first member, the distinct names, the canonical one."""
    rows = found.join(nodes.select("id", "textbook_id", "name"), "id").join(textbooks.select("textbook_id", "title"), "textbook_id", "left").withColumn("label", F.coalesce("title", "textbook_id"))
    books = rows.groupBy("cluster_id", "label").agg(F.min("id").alias("first")).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("first", "label"))).alias("b"))
    names = rows.groupBy("cluster_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("[["), "name", F.lit("]]")))).alias("n"))
    top = best.join(nodes.select(F.col("id").alias("canonical_id"), F.col("name").alias("top")), "canonical_id").select("cluster_id", "top")
    titles = F.array_join(F.transform("b.label", lambda x: F.concat(F.lit("《"), x, F.lit("》"))), "、")
    # Fixed value: the sentence.
    said = F.concat(titles, F.lit(" 中的 "), F.array_join("n", " / "), F.lit(" 被判定为同一或高度等价概念；保留 [["), F.col("top"), F.lit("]] 所在原文，因为其定义更完整、图谱连接度更高。"))
    return books.join(names, "cluster_id").join(top, "cluster_id").select("cluster_id", said.alias("reason"))


def merge_decisions(run_id: str, nodes: DataFrame, found: DataFrame, chapters: DataFrame, textbooks: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One decision per cluster, numbered by its smallest member. Members stay in the cluster table."""
    best = written(canonical(nodes, found).filter("members >= 2"))
    kept = with_excerpts(nodes.join(best.select(F.col("canonical_id").alias("id"), "cluster_id", "members"), "id"), chapters, MERGE_CHARS)
    rows = numbered(kept, "n", F.col("cluster_id")).join(merge_confidence(nodes, found, verdicts), "cluster_id").join(merge_reasons(nodes, found, textbooks, best), "cluster_id")
    return rows.select(
        decision_id(run_id, "merge", F.col("n") + 1).alias("decision_id"), F.lit("merge").alias("action"), "cluster_id", "members", F.col("id").alias("result_node"), source_ref().alias("result_ref"), "source_excerpt", "reason", "confidence"
    )


def greedy_budget(items: DataFrame, runs: DataFrame, longest: int = KEEP_CHARS) -> DataFrame:
    """(run_id, rank, kept): items kept in order of rank while they fit, going on after one that doesn't.

    items has run_id, rank, len (at most `longest`); runs has run_id and room, what may be used. The
    leading items come from a running total. After the first that overflows less than `longest` is
    left; of each length only so many first items can still fit, and these few go through the plain
    loop of their run.
    """
    total = running_total(items.select("run_id", "rank", F.col("len").cast("long").alias("len")), "total", "len", F.col("run_id"), F.col("rank"))
    base = total.groupBy("run_id").agg(F.min(F.col("total") - F.col("len")).alias("before"))
    rows = total.join(base, "run_id").join(runs.select("run_id", "room"), "run_id").withColumn("used", F.col("total") - F.col("before"))
    over = rows.filter("used > room").groupBy("run_id").agg(F.min(F.struct("rank", (F.col("room") - F.col("used") + F.col("len")).alias("left"))).alias("o")).select("run_id", F.col("o.rank").alias("over_rank"), F.col("o.left").alias("left"))
    marked = written(rows.join(over, "run_id", "left").select("run_id", "rank", "len", "room", "over_rank", "left"))
    lead = (F.col("room") >= 0) & (F.col("over_rank").isNull() | (F.col("rank") < F.col("over_rank")) | (F.col("len") == 0))
    place = F.row_number().over(Window.partitionBy("run_id", "len").orderBy("rank"))
    tail = marked.filter((F.col("room") >= 0) & (F.col("rank") >= F.col("over_rank")) & F.col("len").between(1, F.col("left"))).withColumn("k", place).filter(F.col("k") <= longest).filter(F.col("k") <= F.floor(F.col("left") / F.col("len")))

    def loop(rows: pd.DataFrame) -> pd.DataFrame:
        rows, left, kept = rows.sort_values("rank"), int(rows["left"].iloc[0]), []
        for rank, size in zip(rows["rank"], rows["len"]):
            if size <= left:
                left -= size
                kept.append(rank)
        return pd.DataFrame({"run_id": rows["run_id"].iloc[0], "rank": kept})

    rank = items.schema["rank"].dataType.simpleString()
    fits = tail.groupBy("run_id").applyInPandas(loop, f"run_id string, rank {rank}").withColumn("fits", F.lit(True))
    return marked.join(fits, ["run_id", "rank"], "left").select("run_id", "rank", (lead | F.coalesce("fits", F.lit(False))).alias("kept"))


def unique_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of no cluster with rank by importance, then id."""
    return numbered(nodes.join(found.select("id"), "id", "left_anti"), "rank", F.desc("importance"), F.col("id"))


def budget_decisions(run_id: str, nodes: DataFrame, found: DataFrame, merges: DataFrame, chapters: DataFrame, textbooks: DataFrame, ratio: float = BUDGET) -> DataFrame:
    """keep and remove decisions of the nodes that no cluster has, most important first."""
    rows = written(with_excerpts(unique_nodes(nodes, found), chapters, KEEP_CHARS))
    budget = textbooks.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.sum("total_chars"), F.lit(0)) * ratio)).alias("budget"))
    used = merges.agg(F.coalesce(F.sum(F.length("source_excerpt")), F.lit(0)).alias("used"))
    room = budget.crossJoin(used).select(F.lit(run_id).alias("run_id"), (F.col("budget") - F.col("used")).alias("room"))  # one row each
    kept = greedy_budget(rows.select(F.lit(run_id).alias("run_id"), "rank", F.length("source_excerpt").alias("len")), room).select("rank", "kept")
    parts = []
    for flag, action in ((True, "keep"), (False, "remove")):
        part = numbered(rows.join(kept.filter(F.col("kept") == flag), "rank"), "n", F.col("rank"))
        link = F.concat(F.lit("[["), F.col("name"), F.lit("]] "))
        reason = F.concat(link, F.lit("暂未发现跨教材等价节点，作为独有知识点保留原文摘录。" if flag else "当前重要度低于已保留节点，为满足 30% 压缩预算暂不纳入精华版本。"))
        parts.append(part.select(
            decision_id(run_id, action, F.col("n") + 1).alias("decision_id"), F.lit(action).alias("action"), F.lit(None).cast("string").alias("cluster_id"), F.lit(1).cast("long").alias("members"), (F.col("id") if flag else F.lit(None).cast("string")).alias("result_node"),
            (source_ref() if flag else F.lit(None).cast("string")).alias("result_ref"), (F.col("source_excerpt") if flag else F.lit("")).alias("source_excerpt"), reason.alias("reason"), F.lit(KEEP if flag else REMOVE).alias("confidence"),
        ))
    return parts[0].unionByName(parts[1])


def run_stats(decisions: DataFrame, nodes: DataFrame, textbooks: DataFrame) -> DataFrame:
    """One row of counts, characters and the compression ratio (rounded to 6 places)."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(f"decisions_{a}")
    d = decisions.agg(*map(n, ACTIONS), F.coalesce(F.sum(F.when(F.col("action") != "remove", F.length("source_excerpt"))), F.lit(0)).alias("merged_chars"), F.count("result_node").alias("merged_nodes"))
    b = textbooks.agg(F.count("*").alias("original_textbooks"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("original_chars"))
    both = d.crossJoin(b).crossJoin(nodes.agg(F.count("*").alias("original_nodes")))  # one row each
    return both.withColumn("compression_ratio", F.round(F.when(F.col("original_chars") > 0, F.col("merged_chars") / F.col("original_chars")).otherwise(0.0), 6))


def action_order(action: Column) -> Column:
    return F.when(action == "merge", 0).when(action == "keep", 1).otherwise(2)


def decision_listing(decisions: DataFrame) -> DataFrame:
    """decisions with their position: merge, keep, others; most confident first; then by id."""
    return numbered(decisions, "position", action_order(F.col("action")).asc(), F.desc("confidence"), F.col("decision_id").asc())


def action_counts(decisions: DataFrame) -> DataFrame:
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(f"n_{a}")
    return decisions.groupBy("run_id").agg(*map(n, ACTIONS))


def manual_override(decisions: DataFrame, patches: DataFrame) -> DataFrame:
    """decisions with patches (decision_id, action, reason, confidence) applied; unknown actions are ignored.

    A given reason goes before the old one; a missing confidence is 0.97.
    """
    p = patches.filter(F.col("action").isin(*ACTIONS)).select("decision_id", F.col("action").alias("new_action"), F.col("reason").alias("new_reason"), F.col("confidence").alias("new_confidence"), F.lit(True).alias("patched"))
    rows = decisions.join(p, "decision_id", "left")
    reason = F.when(F.length("new_reason") > 0, F.concat("new_reason", F.lit("（教师手动覆盖，原理由："), "reason", F.lit("）"))).otherwise(F.col("reason"))
    confidence = F.when(F.col("patched"), F.coalesce("new_confidence", F.lit(MANUAL))).otherwise(F.col("confidence"))
    return rows.withColumns({"action": F.coalesce("new_action", "action"), "reason": reason, "confidence": confidence}).select(decisions.columns)


def latest_run(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """The run of the given id, or the one updated last (of equals the largest id)."""
    if run_id:
        return runs.filter(F.col("run_id") == run_id)
    return runs.groupBy().agg(F.max(F.struct("updated_at", "run_id", F.struct(*[c for c in runs.columns if c not in ("updated_at", "run_id")]).alias("rest"))).alias("r")).filter("r IS NOT NULL").select("r.run_id", "r.updated_at", "r.rest.*")


def flow_table(counts: DataFrame) -> DataFrame:
    """(run_id, source, target, value): how the nodes of a run flow into actions and outcomes."""
    flows = [("all", "merge", "n_merge"), ("all", "keep", "n_keep"), ("all", "remove", "n_remove"), ("merge", "kept", "n_merge"), ("keep", "kept", "n_keep"), ("remove", "dropped", "n_remove")]
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.greatest(F.lit(1).cast("long"), n).alias("value")) for s, t, n in flows))).alias("f")
    return counts.select("run_id", each).select("run_id", "f.*")


def run_summary(listing: DataFrame, stats: DataFrame, textbooks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (summary_markdown): head counts, merges among the first 30 decisions, else the first 12 keeps."""
    name = listing.filter("position < 30 OR action = 'keep'").join(nodes.select(F.col("id").alias("result_node"), "name"), "result_node", "left").withColumn("label", F.coalesce("name", "result_node", F.lit("未命名知识点")))
    merges = name.filter("action = 'merge' AND position < 30").agg(F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("- [["), "label", F.lit("]]："), "reason").alias("l")))).alias("m"))
    first = listing.filter("action = 'keep'").orderBy("position").limit(12).select("position")
    keeps = name.join(first, "position", "left_semi").agg(F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("[["), "label", F.lit("]]")).alias("l")))).alias("k"))
    books = textbooks.agg(F.substring(F.md5(F.array_join(F.sort_array(F.collect_list("textbook_id")), "|")), 1, 8).alias("digest"))
    row = stats.crossJoin(merges).crossJoin(keeps).crossJoin(books)  # one row each
    # The sentences.
    body = F.when(F.size("m") > 0, F.array_join("m.l", "\n")).when((F.col("decisions_merge") == 0) & (F.size("k") > 0), F.concat(F.lit("- 当前样本中重复概念较少，优先保留："), F.array_join("k.l", "、"))).otherwise("")
    head = F.format_string("# 知识点进化总结 %s\n\n本次整合覆盖 %d 本教材、%d 个知识点；\n保留原文摘录 %d 字，压缩比 %.1f%%。\n\n## 双链概览\n", "digest", "original_textbooks", "original_nodes", "merged_chars", F.col("compression_ratio") * 100)
    return row.select(F.concat(head, body).alias("summary_markdown"))


def condensed_edition(listing: DataFrame) -> DataFrame:
    """(position, line): excerpts of merged and kept nodes as Markdown, in decision order, with their sources."""
    kept = listing.filter(F.col("action").isin("merge", "keep") & (F.length("source_excerpt") > 0))
    return kept.select("position", F.concat("source_excerpt", F.lit("\n\n> 来源："), "result_ref").alias("line"))


def write_edition(listing: DataFrame, path: str) -> None:
    """The condensed edition as text files whose order is that of the decisions."""
    condensed_edition(listing).repartitionByRange("position").sortWithinPartitions("position").select("line").write.mode("overwrite").text(path)
