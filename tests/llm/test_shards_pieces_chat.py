"""Sharding, SentencePiece and chat rendering, and the pipeline as a whole."""

import hashlib
import importlib.util
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusweave.llm import chat, pieces, shards

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("limit,step", [(50, 3), (400, 10), (10**6, 10)])
def test_shards_fit_and_no_split_was_needless(spark, limit, step):
    rnd = random.Random(limit)
    rows = [(i, "x" * rnd.randrange(30)) for i in range(400)] + [(None, "ab"), (900, None)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), limit, step_bits=step).collect()
    assert len(got) == len(rows)
    size = {}
    bits = {i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    for r in got:
        assert bits[r["doc_id"]].startswith(r["shard"]) and len(r["shard"]) == r["depth"]
        n = len(dict(rows)[r["doc_id"]] or "")
        size[r["shard"]] = size.get(r["shard"], 0) + n
        assert r["shard_bytes"] <= limit and not r["oversized"]
    assert all(size[r["shard"]] == r["shard_bytes"] for r in got)
    total = lambda p: sum(len(t or "") for i, t in rows if bits[i].startswith(p))
    assert all(not s or total(s[:-1]) > limit for s in size)


def test_shards_of_one_key_cannot_split(spark, odd, none):
    rows = spark.createDataFrame([(1, "x" * 90)] * 3 + [(2, "y")], "doc_id long, text string")
    got = shards.assign(rows, 100).collect()
    assert {(r["doc_id"], r["oversized"]) for r in got} == {(1, True), (2, False)}
    assert shards.assign(none, 10).count() == 0 and shards.assign(odd, 1000).count() == odd.count()


def test_write_shards(spark, odd, tmp_path):
    shards.write(odd, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_pieces_equal_the_library(spark, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(3)
    texts = ["", " ", "  ", "a ", " a", "a  b ", "▁", "▁a ▁▁", "</s><s>", "日本 語🙂", "x" * 5000, "\u0000 é\n\t"] + ["".join(rnd.choice(" ab▁é\n") for _ in range(rnd.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.encode(df, MODEL, decode=True, rows=7).collect()}
    for i, t in [*enumerate(texts), (999, "")]:
        ids = sp.encode(t) + [sp.eos_id()]
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids)
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(pieces.encode(df, MODEL), MODEL).collect()}
    assert back == {i: r["decoded"] for i, r in got.items()}
    d = {r["doc_id"]: r for r in pieces.digests(pieces.encode(df, MODEL, decode=True)).collect()}
    assert d[3]["ids_sha256"] == hashlib.sha256(" ".join(map(str, got[3]["ids"])).encode()).hexdigest() and d[3]["n_tokens"] == len(got[3]["ids"])
    assert pieces.encode(odd, MODEL).count() == odd.count() and pieces.encode(none, MODEL).count() == 0


def test_a_full_chunk_table_starts_anew():
    sp = pieces.processor(MODEL)
    table = pieces.ChunkTable(sp, most=5, longest=4)
    for _ in range(3):
        for text in ("one two three four five six seven", "one  two", "aaaa bbbbbbbb"):
            assert [x.tolist() for x in table.encode([text])] == [sp.encode(text)]
    assert len(table.ids) <= 12


def test_shards_are_written_whole_whatever_their_columns(spark, odd, none, tmp_path):
    docs = odd.withColumnRenamed("label", "shard")
    shards.write(docs, str(tmp_path / "a"), 1000)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(ValueError):
        shards.write(docs, str(tmp_path / "b"), 1000, name="shard")
    shards.write(none, str(tmp_path / "c"), 1000)


TURNS = "conv_id long, turn long, role string, text string, n string, part string, pos string"


def turns(spark, convs):
    return spark.createDataFrame([(c, t, r, x, "n", "p", "q") for c, rows in convs for t, r, x in rows], TURNS)


def joined(rows):
    return {c: "".join(r["rendered"] for r in sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["pos"])) for c in {r["conv_id"] for r in rows}}


def test_snapshots_collapse_to_the_longest(spark):
    a = [(0, "user", "hi"), (1, "assistant", "yo"), (2, "user", "more")]
    convs = [(1, a[:1]), (2, a[:2]), (3, a), (4, a), (5, a[1:]), (6, [(0, "user", "hi"), (1, "assistant", "no")]), (7, [(0, None, None)]), (8, [(5, "user", "hi"), (9, "assistant", "yo")])]
    rows = chat.render(turns(spark, convs)).collect()
    got = joined(rows)
    assert set(got) == {3, 5, 6, 7}
    assert got[3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[7] == "<|im_start|>\n<|im_end|>\n"
    assert sorted((r["pos"], r["n_turns"]) for r in rows if r["conv_id"] == 3) == [(1, 3), (2, 3), (3, 3)]


@pytest.mark.parametrize("part", [2, 3, 1024])
def test_snapshots_against_brute_force_in_any_parts(spark, part):
    rnd = random.Random(part)
    convs = [(i, [(t, rnd.choice(["u", "a"]), rnd.choice(["x", "y"])) for t in range(rnd.randrange(1, 6))]) for i in range(80)]
    lists = {c: [(r, x) for _, r, x in rows] for c, rows in convs}
    want = {c for c, a in lists.items() if not any((len(b) > len(a) and b[: len(a)] == a) or (b == a and d < c) for d, b in lists.items())}
    got = chat.render(turns(spark, convs), part=part).collect()
    assert {r["conv_id"] for r in got} == want
    assert joined(got) == {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in lists[c]) for c in want}


@pytest.mark.parametrize("part", [1, 2, 5])
def test_turn_numbers_that_repeat_are_spread(spark, part):
    rnd = random.Random(part)
    convs = [(i if i else None, [(t // 7, rnd.choice(["u", "a"]), rnd.choice(["x", "y"])) for t in range(rnd.randrange(1, 24))]) for i in range(20)]
    convs += [(50, convs[3][1] + [(9, "u", "x")] * 12), (51, convs[3][1])]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lists = {c: [(r, x) for _, r, x in sorted(rows, key=lambda q: (q[0], q[1], sha(q[2])))] for c, rows in convs}
    order = lambda c: -1 if c is None else c
    want = {c for c, a in lists.items() if not any((len(b) > len(a) and b[: len(a)] == a) or (b == a and c is not None and order(d) < order(c) and d is not None) for d, b in lists.items())}
    got = chat.render(turns(spark, convs), part=part).collect()
    assert all(r["rendered"].count("<|im_start|>") == 1 for r in got) and 51 not in want
    assert joined(got) == {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in lists[c]) for c in want}


def test_chat_ties_repeats_nulls_and_nothing(spark):
    convs = [(1, [(0, "user", "b"), (-3, "user", "b"), (None, "user", "a")]), (None, [(0, "user", "z")])]
    got = joined(chat.render(turns(spark, convs)).collect())
    assert re.findall(r"\n(.)<", got[1]) == ["a", "b", "b"] and "z" in got[None]
    assert chat.render(turns(spark, [])).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    rows = [(i, " ".join(rnd.choice(words) for _ in range(120)), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[0][1].upper(), "en", "s", 1), (101, "12 34", "en", "s", 1), (102, None, None, None, None), (103, rows[5][1] + " " + passage + " x", "en", "s", 1), (104, rows[7][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == ({i for i, *_ in rows} - {0, 7, 101, 102, 103})
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = dict((r[0], r[1]) for r in rows)
    assert all(r["n_tokens"] == len(sp.encode(text[i])) + 1 and r["decoded_sha256"] == hashlib.sha256(text[i].encode()).hexdigest() for i, r in got.items())


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, None), (2, ""), (3, "not there at all")], "item_id long, text string")
    for name, docs, items in (("odd", odd, bench), ("none", none, bench.limit(0))):
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.written(stage(spark, kept, str(tmp_path / name)))
            assert kept.columns == docs.columns
        got = corpus_pipeline.tokenize(spark, kept, str(tmp_path / name)).collect()
        texts = [r["text"].encode().lower() for r in kept.collect()]  # bytes: A-Z only
        assert len(texts) == len(set(texts)) == len(got) and (bool(got) == (name != "none"))
        assert all(any(c.isalpha() for c in t.decode()) for t in texts)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Exact and near copies, leaks and rows without letters: what the stages keep, by plain Python."""
    import corpus_pipeline

    rnd = random.Random(31)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    passages = [[rnd.choice(words) for _ in range(25)] for _ in range(3)]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randrange(20, 120))]) for i in range(60)]
    for i in range(60, 120):
        w = list(rows[rnd.randrange(60)][1])
        kind = i % 4
        if kind == 1:
            w[rnd.randrange(len(w))] = "changed"
        elif kind == 2:
            w[5:5] = rnd.choice(passages)
        elif kind == 3:
            w = [x.title() for x in w]
        rows.append((i, w))
    rows.append((200, ["1", "2"]))
    texts = {i: " ".join(w) for i, w in rows}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    first = corpus_pipeline.written(stage["language_id"](spark, docs, str(tmp_path)))
    assert ids(first) == set(texts) - {200}
    second = corpus_pipeline.written(stage["exact_dedup"](spark, first, str(tmp_path)))
    best = {}
    for i in sorted(ids(first)):
        best[texts[i].lower()] = i
    assert ids(second) == set(best.values())
    third = corpus_pipeline.written(stage["near_dedup"](spark, second, str(tmp_path)))
    left = sorted(best.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in left for w in [texts[i].lower().split()]}
    root = {i: i for i in left}
    for i in left:
        for j in left:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert ids(third) == {r for r in root.values()}
    fourth = stage["decontaminate"](spark, third, str(tmp_path))
    held = {i for i in ids(third) if any(" ".join(p) in texts[i].lower() for p in passages)}
    assert held and ids(fourth) == ids(third) - held
