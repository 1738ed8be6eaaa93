"""Tokenizers, the segmenter, the stored index with block maxima, and loaded encoders."""

import math
import os
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import encode, postings, retrieve, words

LETTERS = "天地人日月山水火木金"


def chinese(seed, n=300, vocabulary=30):
    """Texts of two- and three-character words without blanks, and the words."""
    rng = random.Random(seed)
    own = sorted({"".join(rng.sample(LETTERS, rng.choice([2, 3]))) for _ in range(vocabulary)})
    return ["".join(rng.choice(own) for _ in range(rng.randint(3, 15))) + "。Abc 12" for _ in range(n)], own


def all_paths(run, weight, unknown):
    """The best of all cuts of a run: largest sum, then longer first words."""
    best = None
    for cuts in product((False, True), repeat=len(run) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(run[at:i])
                at = i
        parts.append(run[at:])
        if all(len(p) == 1 or p in weight for p in parts):
            score = sum(weight.get(p, unknown) for p in parts)
            key = (round(score, 9), [len(p) for p in parts])
            best = max(best, (key, parts)) if best else (key, parts)
    return best[1]


def test_segmenter_takes_the_most_probable_of_all_paths():
    rng = random.Random(4)
    for _ in range(60):
        known = {"".join(rng.choices(LETTERS[:4], k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
        s = words.Segmenter(known)
        run = "".join(rng.choices(LETTERS[:5], k=rng.randint(1, 10)))
        want = all_paths(run, s.weight, s.unknown)
        got = s.segment(run)
        assert "".join(got) == run
        assert math.isclose(sum(s.weight.get(p, s.unknown) for p in got), sum(s.weight.get(p, s.unknown) for p in want), abs_tol=1e-9)


def plain_dictionary(texts, longest, least, cohesion, neighbours):
    import re

    counts = Counter(run[i : i + k] for t in texts for run in re.findall("[一-龥]+", t or "") for i in range(len(run)) for k in range(1, longest + 2) if i + k <= len(run))
    total = sum(n for g, n in counts.items() if len(g) == 1)
    out = {g: n for g, n in counts.items() if len(g) == 1}
    for g, n in counts.items():
        if 2 <= len(g) <= longest and n >= least:
            after, ahead = sum(1 for x in counts if len(x) == len(g) + 1 and x[:-1] == g), sum(1 for x in counts if len(x) == len(g) + 1 and x[1:] == g)
            if after >= neighbours and ahead >= neighbours and all(n * total >= cohesion * counts[g[:k]] * counts[g[k:]] for k in range(1, len(g))):
                out[g] = n
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_learnt_dictionary_matches_plain_counts(spark, parts):
    texts, own = chinese(7)
    rows = spark.createDataFrame([(t,) for t in [*texts, None, "", "no such letters"]], "text string").repartition(parts)
    got = {r["word"]: r["n"] for r in words.learn_words(rows, cohesion=3, neighbours=3).collect()}
    assert got == plain_dictionary(texts, 4, 5, 3, 3)
    assert len(set(own) & set(got)) > len(own) / 2
    assert words.learn_words(rows.limit(0)).count() == 0
    few = words.learn_words(rows, cohesion=3, neighbours=3, most=3).collect()
    assert [r["n"] for r in few] == sorted(got.values(), reverse=True)[:3]


def test_segmenting_tokenizer_in_plans_and_encoders(spark):
    texts, own = chinese(8)
    dictionary = spark.createDataFrame([(w, 10) for w in own], "word string, n long")
    tokenizer = words.segmenting(dictionary)
    rows = spark.createDataFrame(list(enumerate([*texts[:20], None, ""])), "k int, t string").repartition(3)
    got = {r["k"]: r["y"] for r in rows.select("k", tokenizer.column(F.col("t")).alias("y")).collect()}
    plain = words.Segmenter({w: 10 for w in own})
    assert [got[k] for k in range(20)] == plain(texts[:20]) and got[20] == got[21] == []
    assert all(set(got[k]) <= {*own, "abc", "12"} for k in range(20))
    vectors = {r["k"]: r["embedding"] for r in encode.encode(rows, "t", tokenizer=tokenizer, kind="float").collect()}
    assert np.allclose([vectors[k] for k in range(20)], encode.hashing_encoder(texts[:20], words=plain), atol=1e-6) and vectors[20] == [0.0] * 512
    with pytest.raises(ValueError):
        words.segmenting(dictionary, most=2)


def test_english_tokens_are_the_same_with_a_segmenter(spark):
    texts = ["The Quick brown fox, x1 été", "a b cc", ""]
    assert words.Segmenter({"天地": 3})(texts) == words.pair_words(texts)


def test_bm25_with_another_tokenizer(spark):
    texts, own = chinese(9, 40)
    tokenizer = words.segmenting(spark.createDataFrame([(w, 10) for w in own], "word string, n long"))
    c = spark.createDataFrame([(f"c{i:02}", "", "", "", t) for i, t in enumerate(texts)], "chunk_id string, textbook_title string, chapter_title string, section_title string, text string")
    q = spark.createDataFrame([(1, own[0] + own[1]), (2, own[2] + "没有")], "question_id int, question string")
    found = retrieve.bm25_top(retrieve.chunk_words(c, tokenizer), q, 5, tokenizer).collect()
    cut = words.Segmenter({w: 10 for w in own})
    for r in found:
        assert set(cut([texts[int(r["chunk_id"][1:])]])[0]) & set(cut([own[0] + own[1] if r["question_id"] == 1 else own[2]])[0])


# ---- the stored index


def lexical_corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    weights = [1 / (k + 1) for k in range(200)]
    docs = [(f"c{i:04}", f"p{i // 6}", rng.choices(vocabulary, weights, k=rng.randint(0, 40)) + [f"rare{i // 90}"] * (i % 5 == 0)) for i in range(n)]
    ask = [(1, "rare2 w150"), (2, "w0 w1 w2"), (3, "rare1 rare1 w199 w0"), (4, "nothing here"), (5, "w180 w190 w170 w160"), (6, "")]
    return spark.createDataFrame(docs, "chunk_id string, place string, tokens array<string>"), spark.createDataFrame(ask, "question_id int, question string")


def rows_of(df):
    return sorted((r["question_id"], r["bm25_rank"], r["chunk_id"], r["bm25"]) for r in df.collect())


@pytest.mark.parametrize("place,block", [("place", 16), (None, 64)])
def test_stored_index_gives_the_top_of_scoring_everything(spark, tmp_path, place, block):
    tokens, ask = lexical_corpus(spark)
    index = postings.write_postings(tokens, str(tmp_path / "i"), place=place, block=block, buckets=4)
    want = rows_of(retrieve.bm25_top(tokens, ask, 7))
    assert rows_of(postings.postings_top(index, ask, 7)) == want
    assert rows_of(postings.postings_top(postings.read_postings(spark, str(tmp_path / "i")), ask, 7)) == want
    stats = {r["token"]: (r["df"], round(r["idf"], 9)) for r in index.tokens.collect()}
    assert stats == {r["token"]: (r["df"], round(r["idf"], 9)) for r in retrieve.bm25_statistics(tokens).collect()}


def test_blocks_are_skipped_and_bounds_hold(spark, tmp_path):
    tokens, ask = lexical_corpus(spark, 2000)
    index = postings.write_postings(tokens, str(tmp_path / "i"), place="place", block=16, buckets=4)
    asked = postings.asked_tokens(index, ask)
    _, judged = postings.read_blocks(index, asked, 5)
    counts = {r["question_id"]: (r["n"], r["read"]) for r in judged.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if("read").alias("read")).collect()}
    assert sum(n for n, _ in counts.values()) > 2 * sum(read for _, read in counts.values())
    assert counts[1][1] < counts[1][0] / 2
    best = retrieve.bm25_scores(tokens, ask).join(index.chunks, "chunk_id").groupBy("question_id", "block").agg(F.max("bm25").alias("best"))
    assert best.join(judged, ["question_id", "block"]).filter("best > bound + 1e-5").isEmpty()
    assert best.join(judged, ["question_id", "block"], "left_anti").filter("best > 0").isEmpty()


def test_scores_of_given_pairs_and_an_empty_index(spark, tmp_path):
    tokens, ask = lexical_corpus(spark, 120)
    index = postings.write_postings(tokens, str(tmp_path / "i"), buckets=2)
    asked = postings.asked_tokens(index, ask)
    every = {(r["question_id"], r["chunk_id"]): r["bm25"] for r in retrieve.bm25_scores(tokens, ask).collect()}
    pairs = spark.createDataFrame([(1, "c0000"), (2, "c0003"), (2, "c0003"), (3, "c0005"), (4, "c0001"), (2, "none")], "question_id int, chunk_id string")
    got = {(r["question_id"], r["chunk_id"]): r["bm25"] for r in postings.scores_of(index, asked, pairs).collect()}
    assert got == {k: every[k] for k in ((1, "c0000"), (2, "c0003"), (3, "c0005"), (4, "c0001")) if k in every}
    none = postings.write_postings(tokens.limit(0), str(tmp_path / "none"), buckets=2)
    assert postings.postings_top(none, ask).collect() == []


def test_a_bucketed_index_is_not_shuffled(spark, tmp_path):
    tokens, ask = lexical_corpus(spark, 100)
    index = postings.write_postings(tokens, str(tmp_path / "i"), buckets=4)
    plan = index.entries.groupBy("token").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# ---- encoders


def test_an_encoder_is_loaded_once_a_worker(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "k int, t string").repartition(20)
    folder = str(tmp_path)

    def load():
        with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
            f.write("x")
        return encode.hashing_encoder

    encoder = encode.Loaded(folder, load)
    assert encode.encode(rows, "t", encoder).count() == 400
    encode.encode(rows, "t", encoder).write.format("noop").mode("overwrite").save()
    loads = [len(open(os.path.join(tmp_path, f)).read()) for f in os.listdir(tmp_path)]
    assert loads and set(loads) == {1} and len(loads) <= 8


def test_settings_are_judged_in_one_plan(spark):
    from corpusweave.operators import evaluate

    cases = spark.createDataFrame([(1, "fact", ["alpha"], ["B"]), (2, "fact", ["beta"], ["C"])], "id int, type string, expected_keywords array<string>, expected_textbooks array<string>")
    hits = [("a", 1, 1, "an alpha", "Book B", "c"), ("a", 2, 1, "x", "Book C", "c"), ("b", 1, 2, "alpha", "A", "c"), ("b", 1, 1, "none", "A", "d"), ("other", 1, 1, "alpha", "B", "c")]
    got = evaluate.sweep(["a", "b", "empty"], spark.createDataFrame(hits, "setting string, question_id int, rank int, text string, textbook_title string, chapter_title string"), cases).collect()
    assert sorted(map(tuple, got)) == [("a", 2, 0.5, 1.0), ("b", 2, 0.5, 0.0), ("empty", 2, 0.0, 0.0)]


def test_an_index_is_no_larger_than_its_words(spark, tmp_path):
    rng = random.Random(5)
    docs = [(f"chunk_{i:012}", rng.choices([f"word{k}" for k in range(3000)], [1 / (k + 1) for k in range(3000)], k=100)) for i in range(4000)]
    tokens = spark.createDataFrame(docs, "chunk_id string, tokens array<string>")
    index = postings.write_postings(tokens, str(tmp_path / "i"), buckets=2)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "i") for f in names if f.endswith(".parquet"))
    assert size < sum(len(" ".join(t)) for _, t in docs)
    ask = spark.createDataFrame([(1, "word0 word1 word2"), (2, "word2999")], "question_id int, question string")
    # what leaves the tasks are the best of each segment, not a row a chunk
    found = postings.best_scores(index, postings.asked_tokens(index, ask), 5)
    assert found.filter("question_id = 1").count() <= 5 * index.chunks.select("segment").distinct().count()
    assert rows_of(postings.postings_top(index, ask, 5)) == rows_of(retrieve.bm25_top(tokens, ask, 5))
