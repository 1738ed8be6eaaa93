"""Windows of long texts, found in pieces, against windows found one after the other."""

import random

import numpy as np
import pytest

from corpusweave.operators import chunk


def long_text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choices("abcde。；\n #", [20, 20, 20, 20, 20, 2, 2, 3, 9, 2], k=n))


@pytest.mark.parametrize("piece,size,overlap", [(101, 60, 9), (61, 60, 59), (500, 40, 0), (75, 50, 60)])
def test_windows_are_the_same_for_any_pieces(spark, piece, size, overlap):
    texts = [long_text(i, n) for i, n in enumerate((piece + 1, 2 * piece, 2 * piece + 1, 3000, 977, 30, piece, piece + 3))] + ["x" * 1000, "\n" * 900 + "y" * 120, " " * (piece + 5), None, ""]
    texts += [f"lead {long_text(40, 150)}\n## One\n{long_text(41, 700)}\n### Two\nshort\n## Three\n{long_text(42, 300)}"]
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "chapter_id int, textbook_id string, content string").repartition(3)
    key = lambda df: sorted((r["chapter_id"], r["section_title"], r["start"], r["text"]) for r in df.collect())
    assert key(chunk.chunk_windows(rows, size, overlap, piece)) == key(chunk.chunk_windows(rows, size, overlap))


def test_ways_through_a_piece_are_those_of_single_steps():
    text = long_text(7, 2000)
    first, own, size = 400, 700, 60
    _, following = chunk._following(text[first : first + own + size + 3], first, own, len(text), size, 9)
    ways = chunk._ways_out(following, first, size)
    for enter in range(size):
        at = first + enter
        while 0 <= at < first + own:
            at = int(following[at - first])
        assert ways[enter] == at
    _, following = chunk._following(text[1900:], 1900, 100, 2000, size, 9)
    assert set(chunk._ways_out(following, 1900, size)) == {-1}


def test_a_piece_is_longer_than_a_window(spark):
    with pytest.raises(ValueError):
        chunk.chunk_windows(spark.createDataFrame([("x",)], "content string"), 60, 9, 60)
    # from the last places of a piece the windows go on behind it
    assert np.array_equal(chunk._ways_out(np.array([2, 3, 4, -1]), 0, 2), [4, -1])
