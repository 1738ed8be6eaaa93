"""The whole leak search against comparing every passage with every stretch of every document."""

import random

from corpusweave.llm import leaks


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def best(passage, words):
    """Largest share of the passage in order within a stretch of twice its length."""
    size = 2 * len(passage)
    return max(lcs(passage, words[i : i + size]) for i in range(max(1, len(words) - size + 1))) / len(passage)


def corpus(seed, n=40):
    """Passages of 12 to 60 words among words of Zipf's frequencies; documents hold them whole, edited, stretched, in halves or not at all."""
    rng = random.Random(seed)
    common, rare = [f"c{k}" for k in range(60)], [f"r{k}" for k in range(4000)]
    weights = [1 / (k + 1) for k in range(60)]
    word = lambda: rng.choices(common, weights)[0] if rng.random() < 0.6 else rng.choice(rare)
    passages = [[word() for _ in range(rng.randint(12, 60))] for _ in range(n)]
    docs, planted = [], {}
    for i in range(n):
        p = list(passages[i])
        kind = i % 5
        if kind == 1:  # a tenth of the words changed
            for k in rng.sample(range(len(p)), len(p) // 10):
                p[k] = word()
        elif kind == 2:  # other words between
            p = [x for w in p for x in ([w, word()] if rng.random() < 0.15 else [w])]
        elif kind == 3:
            p = p[: len(p) // 2]
        elif kind == 4:
            p = []
        before = [rng.choice(rare) for _ in range(rng.choice([0, 3, 40, 600]))]
        docs.append(before + p + [rng.choice(rare) for _ in range(rng.choice([0, 5, 70]))])
        if kind < 3:
            planted[i] = i
    return docs, passages, planted


def test_find_leaks_against_all_stretches(spark):
    docs, passages, planted = corpus(11)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(passages)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaks.find_leaks(d, b).collect()}
    assert {(i, j) for i, j in planted.items()} <= set(got)
    for (i, j), similarity in got.items():
        assert similarity == best(passages[j], docs[i])
    for i, words in enumerate(docs):
        for j, passage in enumerate(passages):
            share = best(passage, words) if i == j else 0
            assert share < leaks.SIMILAR or (i, j) in got


def test_a_window_holds_the_passage_and_little_else():
    """35 words verbatim amid heavy words, which once hid in a window of 64."""
    rng = random.Random(3)
    passage = [f"c{rng.randrange(20)}" for _ in range(35)]
    words = [f"h{k}" for k in range(200)]
    words = words[:90] + passage + words[90:]
    items = leaks.Items([(1, " ".join(passage), None), (2, " ".join(words[150:190]), None)])
    import numpy as np

    items.idf = np.array([8.0 if w.startswith(b"h") else 1.0 for w in items.vocab])
    items.space = np.eye(len(items.vocab), dtype=np.float32)
    items.fold()
    items.weigh()
    found = {f[0]: f for f in leaks.search([w.encode() for w in words], items)}
    assert found[1][1] == 1.0 and (found[1][3], found[1][4]) == (90, 124)


def test_closest_looks_at_every_stretch():
    rng = random.Random(6)
    for _ in range(60):
        passage = [b"%d" % rng.randrange(12) for _ in range(rng.randint(8, 20))]
        words = [b"%d" % rng.randrange(14) for _ in range(90)]
        places: dict[bytes, int] = {}
        for i, w in enumerate(passage):
            places[w] = places.get(w, 0) | 1 << i
        length, first, last = leaks.closest(places, len(passage), words)
        assert length == round(best(passage, words) * len(passage)) and last - first < 2 * len(passage)
