"""Byte-wise substring dedup against looking at every window, and its suffix sorting against plain sorting."""

import hashlib
import os
import random
import uuid
from collections import Counter

import numpy as np
import pytest

from corpusweave.llm import suffixes


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_suffix_array_is_the_sorted_order(letters):
    rng = random.Random(letters)
    for _ in range(300):
        text = [*(rng.randint(1, letters) for _ in range(rng.randint(0, 60))), 0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repetitive_texts():
    for unit, times in (([1, 2], 50), ([2, 1, 1], 40), ([3, 1, 2, 1], 30), ([1], 99)):
        text = [*unit * times, 0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    fibonacci = [[2], [1]]
    while len(fibonacci[-1]) < 500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    text = [*fibonacci[-1], 0]
    assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain(texts, window):
    """(n_bytes, n_removed, n_spans, sha) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        out.append((len(r), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed, n=60):
    """Random texts, of few and many letters, that share passages, cut copies, runs of one letter and bytes of other scripts."""
    rng = random.Random(seed)
    make = lambda k, letters: "".join(rng.choices(letters, k=k))
    passages = [make(rng.randint(20, 120), "abcdefgh ") for _ in range(4)] + ["ab" * 40, "a" * 90, "日本語のテキスト" * 6]
    out = []
    for k in range(n):
        text = make(rng.randint(0, 120), "ab" if k % 7 == 0 else "abcdefghijklmnopqrst é\0")
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, len(text))
            text = text[:at] + p[rng.randint(0, 9) : len(p) - rng.randint(0, 9)] + text[at:]
        out.append(text)
    return out + [out[3], out[4] + "x", "y" + out[5], "", None]


@pytest.mark.parametrize("parts,window,gram,block,shard", [(1, 40, 6, 8, 4096), (5, 40, 8, 16, 8), (3, 25, 5, 5, 2), (2, 17, 17, 17, 3)])
def test_matches_brute_force(spark, parts, window, gram, block, shard):
    texts = texts_with_repeats(window)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_bytes(docs, window=window, gram=gram, block=block, shard_segments=shard).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, window)


def test_default_window_on_long_texts_that_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghij ", k=5000))
    texts = [long, long[1500:1900] + " and more", long[2000:2199], long[2000:2200], "z" * 450, long[:200] + "z" * 200, "q" * 199]
    assert len(list(suffixes._pieces([t.encode() for t in texts], 200))) > 5
    monkeypatch.undo()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_bytes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 200)


def test_segments_are_the_same_for_any_cut_into_pieces(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=6000)).encode()

    def windows(rows):
        return {(int(r[1]) + k, int(r[4])) for r in rows.T for k in range(int(r[2]))}

    whole = windows(suffixes.segments([text, b"", text[:199], text[100:900]]))
    monkeypatch.setattr(suffixes, "PIECE", 900)
    assert windows(suffixes.segments([text, b"", text[:199], text[100:900]])) == whole


def test_odd_rows(spark, odd, none):
    rows = odd.collect()
    got = suffixes.dedup_bytes(odd, window=50, gram=8).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((str(r["doc_id"]), *p) for r, p in zip(rows, plain([r["text"] for r in rows], 50)))
    assert suffixes.dedup_bytes(none).collect() == []


def test_windows_of_crowded_keys_are_cut_once_and_on_all_cores(spark, monkeypatch, tmp_path):
    texts, window = texts_with_repeats(5), 24
    folder, parts, whole = str(tmp_path), [], suffixes._windows_of

    def counted(rows, *rest):
        def run(batches):
            for b in batches:
                for r in b.column(0).to_pylist():
                    open(os.path.join(folder, f"{r}-{uuid.uuid4()}"), "w").close()
                yield b

        parts.append(rows.rdd.getNumPartitions())
        return whole(rows.mapInArrow(run, rows.schema), *rest)

    monkeypatch.setattr(suffixes, "_windows_of", counted)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    got = suffixes.dedup_bytes(docs, window=window, gram=6, block=4, shard_segments=2).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(plain(texts, window)))
    cut = Counter(name.split("-")[0] for name in os.listdir(folder))
    assert cut and set(cut.values()) == {1} and parts == [spark.sparkContext.defaultParallelism]
