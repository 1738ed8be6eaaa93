"""Queries whose plans did the same work more than once."""

import numpy as np

from corpusweave.jobs import queries_graph, queries_integrate
from corpusweave.operators import align, cells

SMALL = "/root/testdata/sf0.001"


def test_answers_are_made_once_for_their_edges(spark):
    found = queries_graph.model_edges(spark, SMALL)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert not found.isEmpty()


def test_pairs_are_found_once_for_their_verdicts(spark, monkeypatch):
    calls, real = [], queries_integrate.pairs
    monkeypatch.setattr(queries_integrate, "pairs", lambda *a: calls.append(a) or real(*a))
    assert queries_integrate.judged_pairs(spark, SMALL).count() > 0
    assert len(calls) == 1


def test_vectors_without_groups_are_copied_once_a_block(spark):
    v = cells.unit(np.random.default_rng(4).standard_normal((1200, 24)))
    rows = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, group_id int, embedding array<double>")
    assert cells.block_pairs(rows, "id", "embedding", 0.5, 100).count() <= 12 * 1200
    sims = np.round(v @ v.T, 6)
    want = {(i, j) for i, j in np.argwhere(sims >= 0.5).tolist() if i < j and i % 3 != j % 3}
    got = align.similarity_pairs(rows, 0.5, 100).select("id_a", "id_b").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_routes_of_null_and_repeated_chapters(spark, tmp_path):
    rows = [(20, None, "src1", 0), (21, "some words", "src1", 10), (23, "two words", "src1", 9), (23, "two words", "src1", 9), (30, "more", "src2", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["chapter_id"], r["route"]) for r in queries_graph.extraction_routes(spark, str(tmp_path)).collect())
    assert got == [("ch_020", "rules"), ("ch_021", "model"), ("ch_023", "model"), ("ch_023", "model"), ("ch_030", "rules")]
