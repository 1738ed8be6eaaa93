"""Tiered search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from corpusweave.llm import tiers

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, most):
    """{item: [(rank, doc_id, score)]}"""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n_docs // total if total else 50
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out[item] = [(k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: x[:3])[:most])]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


def corpus(n=400, seed=5):
    """Words of Zipf's frequencies, short and long documents, and some that hold rare words or an item as a whole."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 8, 20, 60])))) for i in range(n)]
    docs = [(i, t + (" Rare" * (1 + i % 3) if i % 20 == 0 else "")) for i, t in docs]
    passage = " ".join(rng.choices(words, weights, k=15))
    docs += [(n + k, f"{docs[k][1]} {passage}") for k in range(12)]
    items = [(1, "rare w250 w7"), (2, passage), (3, "w0 w1 w2 w3 w4"), (4, "W0, w0; w299!"), (5, "nothing known"), (6, docs[3][1]), (7, "rare"), (8, None)]
    return docs, items


@pytest.mark.parametrize("parts,segment,group", [(1, 4096, 256), (5, 16, 3)])
def test_every_item_has_the_ranks_and_scores_of_brute_force(spark, parts, segment, group):
    docs, items = corpus()
    index = tiers.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), first=8, growth=4, segment=segment)
    rows = tiers.search(index, spark.createDataFrame(items, "item_id long, text string"), most=5, group=group).collect()
    assert found(rows) == {i: r for i, r in plain(docs, items, 5).items() if r}
    # a tier is left as soon as the proof stands, and those without proof fall through
    by_item = {r["item_id"]: r["tier"] for r in rows}
    assert index.tiers >= 3
    assert by_item[1] < index.tiers - 1 and by_item[3] > 0 and len(set(by_item.values())) >= 2


def test_tiers_hold_best_postings_first_and_residuals_bound_the_rest(spark):
    docs, _ = corpus()
    index = tiers.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), first=8, growth=4)
    rows = [(r["term"], r["tier"], v) for r in index.postings.collect() for v in r["impacts"]]
    assert len(rows) == sum(len(set(terms(t))) for _, t in docs)
    residuals = {r["term"]: r["residuals"] for r in index.weights.collect()}
    levels = {}
    for term, tier, v in rows:
        levels.setdefault(term, {}).setdefault(tier, []).append(v)
    for term, own in levels.items():
        for j in range(index.tiers):
            rest = [v for tier, vs in own.items() if tier > j for v in vs]
            assert (residuals[term][j] if residuals[term] else 0) == max(rest, default=0)
            assert sum(len(vs) for tier, vs in own.items() if tier <= j) <= 8 * 4**j or j == index.tiers - 1
        got = sorted(own)
        assert all(min(own[a]) > max(own[b]) for a, b in zip(got, got[1:]))


def test_proved_items_are_completed_from_lower_tiers(spark):
    """Documents whose common words lie in low tiers still get their whole scores, and only those that may count are looked up."""
    docs = [(i, "common " * (1 + i % 4) + f"x{i} " * (5 + i % 9)) for i in range(200)] + [(300 + k, "needle pin " + "common filler " * (3 + k)) for k in range(9)]
    items = [(1, "needle pin common")]
    index = tiers.build(spark.createDataFrame(docs, "doc_id long, text string"), first=10, growth=4)
    rows = tiers.search(index, spark.createDataFrame(items, "item_id long, text string"), most=5).collect()
    assert found(rows) == plain(docs, items, 5) and {r["tier"] for r in rows} == {0} and index.tiers > 1


def test_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "The QUICK fox"), (1, "The QUICK fox"), (2, ""), (3, None), (None, "word 日本 été"), (4, "\x00 - \x7f"), (5, "ende word")]
    wanted = plain(docs, items, 50)
    asked = spark.createDataFrame([(i, t, "t", 1) for i, t in items], "item_id long, text string, term string, rank int")
    assert found(tiers.search(tiers.build(odd), asked).collect()) == {i: r for i, r in wanted.items() if r}
    assert tiers.search(tiers.build(none), asked).collect() == []
    assert tiers.search(tiers.build(odd), asked.limit(0)).collect() == []


def test_equal_scores_go_by_id_and_repeated_rows_rank_apart(spark):
    docs = [(9 - k % 5, "same words here") for k in range(12)] + [(None, "same words here"), (20, "other text altogether")]
    items = [(1, "words")]
    index = tiers.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), segment=2)
    got = found(tiers.search(index, spark.createDataFrame(items, "item_id long, text string"), most=7).collect())
    assert got == plain(docs, items, 7) and [r[0] for r in got[1]] == list(range(1, 8))
