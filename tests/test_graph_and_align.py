import random

import numpy as np
import pytest

from corpusweave.operators import align, graph
from corpusweave.operators.components import connected_components


def components_of(links):
    parent = {x: x for ab in links for x in ab}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)], [(1, 2), (2, 1), (4, 4), (7, 9), (9, 8)], []])
def test_components_shapes(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == components_of(links)


def test_components_random(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)]
    assert {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()} == components_of(links)


NODES = "id string, textbook_id string, chapter_id string, name string, definition string, category string"


def test_dedupe_and_rewrite(spark):
    nodes = spark.createDataFrame([("a1", "A", "c", "Cell wall", "short", "x"), ("a2", "A", "c", "cellwall", "much longer", "x"), ("a3", "A", "c", "other", "d", "y"), ("b1", "B", "c", "Cellwall", "z", "x")], NODES)
    edges = spark.createDataFrame([("a1", "a3", "contains", "one"), ("a2", "a3", "contains", "two"), ("a1", "a2", "parallel", "loop"), ("a3", "gone", "contains", "dangling")], "source string, target string, relation_type string, description string")
    kept, mapping = graph.dedupe_nodes(nodes)
    assert {r["id"] for r in kept.collect()} == {"a2", "a3", "b1"}
    assert dict(mapping.collect()) == {"a1": "a2", "a2": "a2", "a3": "a3", "b1": "b1"}
    new = graph.rewrite_edges(edges, kept, mapping)
    assert [tuple(r) for r in new.collect()] == [("a2", "a3", "contains", "one")]
    weights = {r["id"]: (r["degree"], r["frequency"], r["weight"]) for r in graph.node_weights(kept, new).collect()}
    assert weights == {"a2": (1, 2, 6), "a3": (1, 1, 3), "b1": (0, 2, 6)}
    assert {r["id"] for r in graph.dedupe_nodes(nodes, by_book=False)[0].collect()} == {"a2", "a3"}


def test_similarity_pairs_match_brute_force_for_any_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8))
    v[10], v[20] = v[3], v[3]
    rows = [(i, i % 3, v[i].tolist()) for i in range(60)] + [(90, 0, None), (91, 1, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, group_id int, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    reps = {}
    for i, g, e in rows[:60]:
        reps.setdefault((g, tuple(e)), i)
    want = {(a, b, sim[a, b]) for a in reps.values() for b in reps.values() if a < b and a % 3 != b % 3 and sim[a, b] >= 0.5}
    for block in (7, 1000):
        assert {tuple(r) for r in align.similarity_pairs(df, 0.5, block).collect()} == want


def test_judgments_and_merges(spark):
    answers = ['```json\n[{"pair_id": " p0 ", "verdict": "Same", "confidence": 0.9}, {"pair_id": "p1", "verdict": "same", "confidence": "high"}, {"pair_id": "p2", "verdict": "maybe"}]\n```', '{"pair_id": "p3"}', "nothing", None]
    got = align.judgments(spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "batch int, response string"))
    assert sorted((r["pair_id"], r["verdict"], r["confidence"]) for r in got.collect()) == [("p0", "same", 0.9), ("p1", "same", 0.0)]
    pairs = spark.createDataFrame([("p0", 1, 2), ("p1", 3, 4)], "pair_id string, id_a int, id_b int")
    assert [r["pair_id"] for r in align.judged_same(pairs, got).collect()] == ["p0"]


def test_lexical_and_combined_clusters(spark):
    n = spark.createDataFrame([("1", "A", "水 肿"), ("2", "B", "水-肿"), ("3", "B", "x"), ("4", "A", "x"), ("5", "A", "发热"), ("6", "A", "发热"), ("7", "B", "休克")], "id string, textbook_id string, name string")
    assert {r["id"]: r["cluster_id"] for r in align.lexical_clusters(n).collect()} == {"1": "1", "2": "1"}
    links = spark.createDataFrame([("2", "7"), ("5", "gone")], "id_a string, id_b string")
    assert {r["id"]: r["cluster_id"] for r in align.combined_clusters(n, links).collect()} == {"1": "1", "2": "1", "7": "1"}
