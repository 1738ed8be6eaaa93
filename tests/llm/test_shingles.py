"""Near-dedup on word shingles against brute force."""

import random

import pyarrow as pa
import pytest

from corpusweave.llm import shingles


def five(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Places of the rows that stay."""
    sets, root = [five(t) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                root = [root[i] if r == root[j] else r for r in root]
    return {r: min(i for (i, _), q in zip(rows, root) if q == r) for r in root}.values()


@pytest.mark.parametrize("block, frequent, rounds", [(3, 50_000, 0), (2048, 0, 2)])
def test_near_copies_match_brute_force(spark, monkeypatch, block, frequent, rounds):
    monkeypatch.setattr(shingles, "FREQUENT", frequent)
    monkeypatch.setattr(shingles.links, "__defaults__", (block, rounds))
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    line = [rnd.choice(words) for _ in range(12)]
    texts = [[rnd.choice(words) for _ in range(rnd.randrange(1, 150))] + (line if i % 2 else []) for i in range(60)]
    for k in range(140):  # most around the similarity asked for; the second half of one text
        w = list(texts[rnd.randrange(60) if k < 70 else 7])
        for _ in range(rnd.randrange(1 + len(w) // 25)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(w[rnd.randrange(3) :])
    far = [f"v{i}" for i in range(200)]
    texts += [far, far[:180] + ["x"] * 12]  # alike, but no three bits tell
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, " \n"), (902, "one two"), (903, "One  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r["doc_id"] for r in shingles.keep_one(docs, block=block).collect()]
    assert sorted(kept) == sorted(brute(rows))


def test_odd_rows(odd, none):
    assert shingles.keep_one(none).count() == 0
    kept = shingles.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({five(r["text"]) for r in odd.collect()})


@pytest.mark.parametrize("block", [4, 2048])
def test_a_pair_is_given_out_in_one_of_its_cells(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "FREQUENT", 0)
    seen, verified = [], shingles._verified

    def watched(pairs, *rest):
        seen.append([tuple(r) for r in pairs.collect()])
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "_verified", watched)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(20):  # alike, and each cell has some of them
        w = list(base)
        for k in range(2):
            w[10 + 100 * k + rnd.randrange(80)] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(shingles.links, "__defaults__", (block, 0))
    kept = [r["doc_id"] for r in shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()]
    assert sorted(kept) == sorted(brute(rows))
    assert len(seen[-1]) > 20 and len(seen[-1]) == len(set(seen[-1]))


def test_large_sets_are_told_apart_by_their_counts():
    sets = [shingles.shingles(" ".join(f"{p}{i}" for i in range(6000))) for p in "ab"]
    near = list(shingles._plausible([pa.record_batch([pa.array([1]), pa.array([2]), *(pa.array([len(x)]) for x in sets), *(pa.array([shingles.counters(x)]) for x in sets)], names=["a", "b", "size", "other_size", "counts", "other_counts"])]))
    assert sum(b.num_rows for b in near) == 0
    for n, m in ((10, 11), (1100, 980), (9000, 8100), (300_000, 270_000)):  # never apart when alike, whatever the counters
        x, y = (shingles.shingles(" ".join(f"c{i}" for i in range(k))) for k in (n, m))
        assert shingles._near(shingles.counters(x), shingles.counters(y), len(x) + len(y))
