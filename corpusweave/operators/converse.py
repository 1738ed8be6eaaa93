"""Conversation tables: history, intents, decisions that messages mean, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.shared import written
from corpusweave.functions.text import strip
from corpusweave.operators.integrate import DIALOGUE
from corpusweave.operators.terms import first_with

HISTORY = 50
# Words that tell what a message wants, in the order they are tried.
INTENTS = (("explain_decision", ("为什么", "解释", "原因")), ("keep", ("保留", "不要删除", "不删除")), ("split", ("不要合并", "分开", "拆开", "不是同一个")), ("query_rag", ("什么", "如何", "请问")))
# What is noted, and how ids of runs and decisions look.
KEEP_NOTE, SPLIT_NOTE = " 教师反馈：要求保留该知识点，系统已将决策调整为 keep。", " 教师反馈：要求拆分该合并簇，系统已取消 merge 并转为 keep。"
EXPLICIT = r"(run_[A-Za-z0-9_]+|manual_[A-Za-z0-9_]+|[A-Za-z0-9_]+_(?:merge|keep|remove)_\d{4})"


def recent_history(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last messages of each session (session_id, id, ...), with their position in time order."""
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    return messages.withColumn("k", last).filter(F.col("k") <= most).withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).drop("k")


def intents(messages: DataFrame, words=INTENTS, has_decision: bool = True) -> DataFrame:
    """Adds intent. The first three need a decision to speak of; else later tests decide."""
    text = F.col("content")
    any_of = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(text, w))
    (first, a), (second, b), (third, c), (asks, d) = words
    found = F.col("has_decision") if "has_decision" in messages.columns else F.lit(has_decision)
    question = strip(text).endswith("?") | text.contains("？") | any_of(d)
    return messages.withColumn("intent", F.when(found & any_of(a), first).when(found & any_of(b), second).when(found & any_of(c), third).when(question, asks).otherwise("summarize_integration"))


def message_terms(messages: DataFrame, pattern: str = "[一-龥A-Za-z]{2,12}") -> DataFrame:
    """(session_id, id, at, term): the [[linked]] terms of a message, else its words."""
    linked = F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    words = F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1))
    return messages.select("session_id", "id", F.posexplode(F.when(F.size(linked) > 0, linked).otherwise(words)).alias("at", "term"))


def decision_lookup(messages: DataFrame, listing: DataFrame, prefer: str | None = None) -> DataFrame:
    """(session_id, id, decision_id): the decision each message means.

    listing has decision_id, action, position and haystack (reason and references). An explicit id
    that stands in a decision's id comes first; then the first term, in order, that stands in a
    haystack, with the first such decision; else the first decision. All different terms are looked
    for in one pass over the haystacks, so no message is compared to every decision.
    """
    ds = listing.filter(F.col("action") == prefer) if prefer else listing
    need = messages.select("session_id", "id", "content", F.regexp_extract("content", EXPLICIT, 1).alias("needle"))
    needles = need.filter("needle <> ''").select(F.col("needle").alias("term")).distinct()
    named = first_with(needles, ds.select("decision_id", "position", F.col("decision_id").alias("text")), "decision_id", "position").select(F.col("term").alias("needle"), F.col("decision_id").alias("by_id"))
    terms = message_terms(messages)
    meant = first_with(terms, ds.select("decision_id", "position", F.col("haystack").alias("text")), "decision_id", "position")
    best = terms.join(meant, "term").groupBy("session_id", "id").agg(F.min_by("decision_id", "at").alias("by_term"))
    first = ds.agg(F.min_by("decision_id", "position").alias("first"))
    rows = need.join(named, "needle", "left").join(best, ["session_id", "id"], "left").crossJoin(first)  # one row
    return rows.select("session_id", "id", F.coalesce("by_id", "by_term", "first").alias("decision_id"))


def message_turns(messages: DataFrame, listing: DataFrame, status: DataFrame, answers: DataFrame | None = None, words=INTENTS) -> DataFrame:
    """(session_id, id, intent, decision_id, tool, reply) of each message (session_id, id, content): what it wants, what it means, what is said.

    Explaining, keeping and splitting need a decision to speak of, splitting one that merges, which it
    then looks for among merges alone; without one a message is a question or asks for the state.
    listing has decision_id, action, position, reason and haystack; status has the reply for a run, no
    row without one; answers (session_id, id, answer) are those to questions, empty where there is none.
    Messages of one table are judged by the decisions as they stand; apply_feedback changes these.
    """
    there = listing.agg((F.count("*") > 0).alias("any"), (F.count_if(F.col("action") == "merge") > 0).alias("merges"))
    rows = messages.select("session_id", "id", "content").crossJoin(there)  # one row
    split = words[2][0]
    meant = intents(rows.withColumn("has_decision", F.col("any")), words)
    # splitting falls through where nothing is merged
    again = intents(rows.withColumn("has_decision", F.lit(False)), words).select("session_id", "id", F.col("intent").alias("otherwise"))
    meant = meant.join(again, ["session_id", "id"]).withColumn("intent", F.when((F.col("intent") == split) & ~F.col("merges"), F.col("otherwise")).otherwise(F.col("intent"))).drop("otherwise")
    meant = written(meant.select("session_id", "id", "content", "intent"))
    of = lambda *names: meant.filter(F.col("intent").isin(*names))
    found = decision_lookup(of(words[0][0], words[1][0]), listing).unionByName(decision_lookup(of(split), listing, "merge"))
    told = found.join(listing.select("decision_id", "reason"), "decision_id", "left")
    rows = meant.join(told, ["session_id", "id"], "left")
    if answers is not None:
        rows = rows.join(answers.select("session_id", "id", "answer"), ["session_id", "id"], "left")
    answer = F.col("answer") if answers is not None else F.lit(None).cast("string")
    state = status.agg(F.first("reply").alias("state"))
    is_ = lambda k: F.col("intent") == words[k][0]
    # The sentences.
    reply = (
        F.when(is_(0), F.concat(F.lit("这条决策的理由是："), F.col("reason")))
        .when(is_(1), F.concat(F.lit("已更新："), F.col("decision_id"), F.lit(" 调整为 keep。")))
        .when(is_(2), F.concat(F.lit("已更新："), F.col("decision_id"), F.lit(" 已由 merge 调整为 keep。")))
        .when(is_(3), F.coalesce(answer, F.lit("")))
        .otherwise(F.coalesce("state", F.lit("当前还没有整合结果。请先运行 Phase 3 跨教材整合。")))
    )
    tool = F.when(is_(1) | is_(2), "modify_decision").otherwise(F.col("intent"))
    return rows.crossJoin(state).select("session_id", "id", "intent", "decision_id", tool.alias("tool"), reply.alias("reply"))  # one row


def apply_feedback(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """decisions with feedback (decision_id, id, intent keep or split) applied: each becomes keep at 0.96 and
    its reason gets the notes in message order. Run counts are left as they are."""
    note = F.when(F.col("intent") == "split", SPLIT_NOTE).otherwise(KEEP_NOTE)
    said = feedback.filter(F.col("intent").isin("keep", "split")).groupBy("decision_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("id", note.alias("n"))))["n"], "").alias("notes"))
    rows = decisions.join(said, "decision_id", "left")
    hit = F.col("notes").isNotNull()
    return rows.withColumns({"action": F.when(hit, "keep").otherwise(F.col("action")), "reason": F.concat("reason", F.coalesce("notes", F.lit(""))), "confidence": F.when(hit, DIALOGUE).otherwise(F.col("confidence"))}).select(decisions.columns)


def status_reply(stats: DataFrame) -> DataFrame:
    # Fixed value: the sentence.
    text = F.format_string("当前整合结果：%d 本教材，%d 条 merge、%d 条 keep、%d 条 remove，压缩比 %.1f%%。", "original_textbooks", "decisions_merge", "decisions_keep", "decisions_remove", F.col("compression_ratio") * 100)
    return stats.select(text.alias("reply"))
