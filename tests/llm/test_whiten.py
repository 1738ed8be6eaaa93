"""Whitening of embeddings against numpy on the same rows."""

import math

import numpy as np
import pytest

from corpusweave.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, x string, whitened string, n int"


def rows_of(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "x", "w", 1) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def plain(vectors, components):
    """n, sums, covariance eigenvalues, whitened rows and exact deviations, from the list of usable vectors."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    own = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], e, own @ vec[:, :components] / np.sqrt(e[:components])


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_match_numpy_with_copies_that_count_once_in_the_fit(spark, parts):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(90, 20)) * np.linspace(3, 0.5, 20)).astype(np.float32)
    vectors = [*base.tolist(), *[base[0].tolist()] * 60]
    rows, fitted = whiten.whiten(rows_of(spark, vectors).repartition(parts))
    got = whiten.by_component(rows, fitted).collect()
    n, deviations, e, white = plain(vectors, 16)
    assert len(got) == 150 * 16 and {r["n"] for r in got} == {n} and n == 90
    signs = {}
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        assert r["deviation"] == deviations[i]
        assert abs(abs(r["whitened"]) - abs(white[i, k])) < 1e-7
        assert abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-9
        if abs(white[i, k]) > 1e-3:
            signs.setdefault(k, set()).add(r["whitened"] * white[i, k] > 0)
    assert all(len(s) == 1 for s in signs.values())
    assert {r["identity_error"] for r in got} == {fitted.identity_error} and fitted.identity_error < 1e-9


def test_odd_rows_have_a_stated_result(spark):
    good = [[1.0, 2.0, -3.0], [0.5, 0.25, 4.0], [-2.0, 1.0, 0.0], [3.0, -1.0, 2.5], [1.0, 2.0, -3.0]]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, -float("inf"), 0.0], [3.0e38, 1.0, 1.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    ids = [1, 1, None, 4, 5, *range(10, 19)]
    rows, fitted = whiten.whiten(rows_of(spark, good + odd, ids))
    got = whiten.by_component(rows, fitted).collect()
    assert len(got) == 5 * 3 and fitted.n == 4 and sorted({r["component"] for r in got}) == [1, 2, 3]
    assert {r["vec_id"] for r in got} == {1, None, 4, 5}
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_components_without_variance_are_null_and_tables_without_rows_are_empty(spark):
    one = [[1.0, 2.0, 3.0]] * 4
    rows, fitted = whiten.whiten(rows_of(spark, one))
    got = whiten.by_component(rows, fitted).collect()
    assert fitted.n == 1 and len(got) == 12 and all(r["whitened"] is None and r["deviation"] == 0 for r in got)
    flat = [[float(i), 2.0 * i, 7.0] for i in range(6)]
    rows, fitted = whiten.whiten(rows_of(spark, flat))
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten.by_component(rows, fitted).collect()}
    assert all((got[i, 1] is not None) and got[i, 2] is None and got[i, 3] is None for i in range(6))
    for vectors in ([], [None], [[]]):
        rows, fitted = whiten.whiten(rows_of(spark, vectors))
        assert whiten.by_component(rows, fitted).collect() == []


def test_deviations_beyond_64_bits_stay_exact(spark):
    vectors = [[2.0**39, 1.0], [-(2.0**39), 2.0], [0.0, 3.0]]
    rows, fitted = whiten.whiten(rows_of(spark, vectors))
    got = {r["vec_id"]: int(r["deviation"]) for r in rows.collect()}
    assert [got[i] for i in range(3)] == plain(vectors, 2)[1]
    assert {r["deviation"] for r in whiten.by_component(rows, fitted).collect() if r["vec_id"] != 2} == {None}
