"""Alignment of equivalent nodes across books: similarity joins, verdicts, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.ranking import numbered
from corpusweave.functions.shared import written
from corpusweave.functions.text import mark_free_key
from corpusweave.operators.cells import block_pairs
from corpusweave.operators.components import connected_components
from corpusweave.operators.extract import recovered_json

CANDIDATE, AUTO_MERGE, CONFIDENCE = 0.82, 0.92, 0.7
BATCH = 5
BLOCK = 8192
#: Rows of a block that are multiplied at once.
PRODUCT = 512
VERDICTS = ("same", "related", "different")


def node_text(name: Column, definition: Column) -> Column:
    return F.concat(name, F.lit("："), F.substring(F.coalesce(definition, F.lit("")), 1, 200))


def similarity_classes(vectors: DataFrame) -> DataFrame:
    """(id, group_id, class_id): rows of equal vector and group are one class, named by the smallest id."""
    v = vectors.dropna(subset=["embedding"])
    first = v.groupBy("group_id", "embedding").agg(F.min("id").alias("class_id"))
    return v.join(first, ["group_id", "embedding"]).select("id", "group_id", "class_id")


def _cells(vectors: DataFrame, block: int, threshold: float) -> DataFrame:
    """(i, j, own, id, group_id, embedding): the classes' rows in every pair of blocks where they may find one that is alike."""
    v = written(vectors.dropna(subset=["embedding"]).groupBy("group_id", "embedding").agg(F.min("id").alias("id")))
    return block_pairs(v.select("id", "group_id", "embedding"), "id", "embedding", threshold, block)


def _near(key: tuple, rows: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller ids, larger ids, sims) of a cell's pairs over the threshold, PRODUCT rows of one block at a time."""

    def side(part: pd.DataFrame):
        m = np.array(part["embedding"].tolist(), np.float64).reshape(len(part), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return part["id"].to_numpy(), part["group_id"].to_numpy(), m / np.where(n > 0, n, np.inf)

    i, j = key
    if not (rows["own"] == i).any() or not (rows["own"] == j).any():
        return
    ids, groups, m = side(rows[rows["own"] == i])
    ids2, groups2, m2 = (ids, groups, m) if i == j else side(rows[rows["own"] == j])
    for at in range(0, len(ids), PRODUCT):
        sim = np.round(m[at : at + PRODUCT] @ m2.T, 6)
        x, y = np.nonzero(sim >= threshold)
        p, q = ids[at:][x], ids2[y]
        kept = (groups[at:][x] != groups2[y]) & ((i != j) | (p < q))
        yield np.minimum(p, q)[kept], np.maximum(p, q)[kept], sim[x, y][kept]


def similarity_pairs(vectors: DataFrame, threshold: float = CANDIDATE, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, sim): pairs of classes of different groups with cosine of threshold or more, exact.

    vectors has id, group_id, embedding. Equal vectors of one group are one class, so copies make no
    pairs of their own; similarity_classes has the members. Rows are dealt into cells around centres;
    rows of two cells meet only where their angles allow it, in a few matrix products. Null and zero vectors pair with nothing. sim is rounded to 6
    places. Where a dense set would give more pairs than are wanted, similarity_counts has a row a class.
    """

    def product(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = list(_near(key, rows, threshold))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(("id_a", "id_b", "sim"), cols)))

    kind = vectors.schema["id"].dataType.simpleString()
    return _cells(vectors, block, threshold).groupBy("i", "j").applyInPandas(product, f"id_a {kind}, id_b {kind}, sim double")


def similarity_counts(vectors: DataFrame, threshold: float = CANDIDATE, block: int = BLOCK) -> DataFrame:
    """(class_id, links, first_link, best_sim): how many classes of other groups each class is like, the smallest of them, and the best similarity.

    The pairs of similarity_pairs, counted where they are found: no more rows leave a task than its blocks have.
    """

    def counted(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = None
        for p, q, sim in _near(key, rows, threshold):
            both = pd.DataFrame({"class_id": np.concatenate((p, q)), "other": np.concatenate((q, p)), "sim": np.concatenate((sim, sim))})
            part = both.groupby("class_id", as_index=False).agg(links=("other", "size"), first_link=("other", "min"), best_sim=("sim", "max"))
            out = part if out is None else pd.concat((out, part)).groupby("class_id", as_index=False).agg({"links": "sum", "first_link": "min", "best_sim": "max"})
        return pd.DataFrame({"class_id": [], "links": [], "first_link": [], "best_sim": []}) if out is None else out

    kind = vectors.schema["id"].dataType.simpleString()
    parts = _cells(vectors, block, threshold).groupBy("i", "j").applyInPandas(counted, f"class_id {kind}, links bigint, first_link {kind}, best_sim double")
    return parts.groupBy("class_id").agg(F.sum("links").alias("links"), F.min("first_link").alias("first_link"), F.max("best_sim").alias("best_sim"))


def auto_merged(pairs: DataFrame, threshold: float = AUTO_MERGE) -> DataFrame:
    return pairs.filter(F.col("sim") >= threshold)


def judge_batches(pairs: DataFrame, nodes: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, pair_ids, prompt): pairs numbered by similarity, `size` to a prompt for an external judge."""
    ranked = numbered(pairs, "n", F.desc("sim"), F.col("id_a"), F.col("id_b"))
    side = lambda k: nodes.select(F.col("id").alias(f"id_{k}"), F.col("name").alias(f"name_{k}"), F.col("definition").alias(f"def_{k}"), F.coalesce(F.nullif("chapter_title", F.lit("")), "textbook_id").alias(f"from_{k}"))
    rows = ranked.join(side("a"), "id_a").join(side("b"), "id_b")
    part = lambda k: F.format_string(f"\n  {k.upper()}: 「%s」 来源=《%s》\n     定义: %s", f"name_{k}", f"from_{k}", F.substring(f"def_{k}", 1, 180))
    text = F.concat(F.format_string("pair_id=p%d (sim=%.2f)", "n", "sim"), part("a"), part("b"))
    batched = rows.select(F.floor(F.col("n") / size).alias("batch"), F.struct("n", text.alias("text")).alias("t"))
    got = batched.groupBy("batch").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return got.select("batch", F.transform("t.n", lambda n: F.concat(F.lit("p"), n.cast("string"))).alias("pair_ids"), F.array_join("t.text", "\n\n").alias("prompt"))


def judgments(responses: DataFrame) -> DataFrame:
    """(pair_id, verdict, confidence, reason) from (batch, response); broken answers and non-lists give none."""
    item = "array<struct<pair_id:string,verdict:string,confidence:string,reason:string>>"
    json = recovered_json(F.col("response"))
    rows = responses.select(json.alias("json")).filter(F.try_parse_json("json").isNotNull() & F.col("json").startswith("[")).select(F.explode(F.from_json("json", item)).alias("j"))
    return rows.select(
        F.trim(F.coalesce("j.pair_id", F.lit(""))).alias("pair_id"), F.lower(F.trim("j.verdict")).alias("verdict"), F.coalesce(F.expr("try_cast(j.confidence AS double)"), F.lit(0.0)).alias("confidence"), F.substring(F.coalesce("j.reason", F.lit("")), 1, 200).alias("reason")
    ).filter(F.col("verdict").isin(*VERDICTS))


def judged_same(pairs: DataFrame, verdicts: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Pairs (with pair_id) that a confident verdict calls the same; unknown ids are ignored."""
    same = verdicts.filter((F.col("verdict") == "same") & (F.col("confidence") >= confidence)).select("pair_id").distinct()
    return pairs.join(same, "pair_id", "left_semi")


def clusters(links: DataFrame) -> DataFrame:
    """(id, cluster_id) of everything linked; cluster_id is the smallest member."""
    return connected_components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).withColumnRenamed("component", "cluster_id")


def lexical_clusters(nodes: DataFrame) -> DataFrame:
    """(id, cluster_id): nodes of equal names without marks, of two letters or more, from two books or more."""
    keyed = nodes.select("id", "textbook_id", mark_free_key(F.col("name")).alias("key")).filter(F.length("key") >= 2)
    # min and max tell whether there are two books without gathering them
    groups = keyed.groupBy("key").agg(F.min("id").alias("cluster_id"), F.min("textbook_id").alias("a"), F.max("textbook_id").alias("b")).filter("a <> b")
    return keyed.join(groups, "key").select("id", "cluster_id")


def combined_clusters(nodes: DataFrame, semantic: DataFrame) -> DataFrame:
    """(id, cluster_id): closure of lexical clusters and semantic links (id_a, id_b) among nodes."""
    ids = nodes.select("id")
    known = semantic.select("id_a", "id_b").join(ids.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(ids.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    lexical = lexical_clusters(nodes).select(F.col("id").alias("id_a"), F.col("cluster_id").alias("id_b"))
    return clusters(known.select("id_a", "id_b").unionByName(lexical))


def alignment_summary(pairs: DataFrame, same: DataFrame, found: DataFrame) -> DataFrame:
    """One row: candidate_pairs, same_pairs, clusters."""
    return pairs.agg(F.count("*").alias("candidate_pairs")).crossJoin(same.agg(F.count("*").alias("same_pairs"))).crossJoin(found.agg(F.countDistinct("cluster_id").alias("clusters")))  # one row each
