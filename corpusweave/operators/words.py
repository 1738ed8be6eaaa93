"""Tokenizers: the default rule, any function in its place, and a segmenter for text without blanks.

The segmenter looks for the most probable path through the graph of all dictionary words of a run.
Its dictionary is a table (word, n), given or learnt: runs of characters that hold together (they
stand together far more often than their parts would by chance) and stand freely (between many
different neighbours) are words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.shared import written

CJK = "一-龥"
RUNS = f"([A-Za-z0-9]+|[{CJK}]+)"
_RUN = re.compile(RUNS)
#: Characters of a word, times it must stand, times its parts must fall short of it, neighbours on either side.
LONGEST, LEAST, COHESION, NEIGHBOURS = 4, 5, 20, 5
#: The most words of a dictionary; it is sent to all tasks.
DICTIONARY = 1 << 19


@dataclass(frozen=True)
class Tokenizer:
    """One rule in two forms: column turns a text column into token arrays, words a list of texts into token lists."""

    column: Callable[[Column], Column]
    words: Callable[[list[str]], list[list[str]]]


def pair_tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs and CJK pairs, of more than one character. Accented letters part words."""
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    return F.filter(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(F.lower(r))).otherwise(pairs(r)))), lambda t: F.length(t) > 1)


def _cut(text: str, cjk: Callable[[str], list[str]]) -> list[str]:
    out: list[str] = []
    for run in _RUN.findall(text.encode().lower().decode()):  # bytes: lower() knows A-Z only
        if run[0] < "一":
            out.append(run)
        else:
            out += cjk(run)
    return [t for t in out if len(t) > 1]


def pair_words(texts: list[str]) -> list[list[str]]:
    """The rule of pair_tokens for a list of texts."""
    return [_cut(t, lambda run: list(map(str.__add__, run, run[1:]))) for t in texts]


PAIRS = Tokenizer(pair_tokens, pair_words)


def plugged(words: Callable[[list[str]], list[list[str]]]) -> Tokenizer:
    """A tokenizer from any function of a list of texts; null texts have no tokens. It runs on Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(words(texts.fillna("").tolist()), index=texts.index, dtype=object)

    return Tokenizer(lambda text: run(text), words)


def run_counts(texts: DataFrame, text: str, longest: int = LONGEST) -> DataFrame:
    """(gram, n): how often each run of up to `longest` + 1 CJK characters stands in all texts."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{CJK}]+)"), F.lit(1))).alias("run"))
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    tail = at.select(F.substring("run", F.col("at"), F.lit(longest + 1)).alias("tail"))
    # equal tails first: a gram is then counted once for each different tail that begins with it
    tails = tail.groupBy("tail").agg(F.count("*").alias("n"))
    grams = tails.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda k: F.substring("tail", F.lit(1), k))).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


def learn_words(texts: DataFrame, text: str = "text", *, longest: int = LONGEST, least: int = LEAST, cohesion: int = COHESION, neighbours: int = NEIGHBOURS, most: int = DICTIONARY) -> DataFrame:
    """(word, n): a dictionary learnt from all texts; every character that stands anywhere is in it too.

    A run of 2 to `longest` characters is a word if it stands `least` times, if for each cut in two it
    stands `cohesion` times as often as its parts would meet by chance, and if `neighbours` different
    characters precede it and follow it. The most frequent `most` stay, the smaller of equals.
    Null and empty texts teach nothing. All tests are on whole numbers.
    """
    counts = written(run_counts(texts, text, longest))
    size = F.length("gram")
    total = counts.filter(size == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    some = counts.filter((size > 1) & (size <= longest) & (F.col("n") >= least))
    # every gram that is longer by one tells of a neighbour
    longer = counts.filter(size > 2)
    after = longer.groupBy(F.expr("left(gram, length(gram) - 1)").alias("gram")).agg(F.count("*").alias("after"))
    ahead = longer.groupBy(F.expr("right(gram, length(gram) - 1)").alias("gram")).agg(F.count("*").alias("ahead"))
    free = some.join(after.filter(F.col("after") >= neighbours), "gram", "left_semi").join(ahead.filter(F.col("ahead") >= neighbours), "gram", "left_semi")
    cuts = free.select("gram", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("gram", "n", F.expr("left(gram, k)").alias("a"), F.expr("right(gram, length(gram) - k)").alias("b"))
    part = lambda c: counts.select(F.col("gram").alias(c), F.col("n").alias(f"n_{c}"))
    met = cuts.join(part("a"), "a").join(part("b"), "b").crossJoin(total)  # one row
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    holds = whole("n") * whole("total") >= F.lit(cohesion).cast("decimal(10,0)") * (whole("n_a") * whole("n_b")).cast("decimal(28,0)")
    words = met.groupBy("gram", "n").agg(F.every(holds).alias("ok")).filter("ok").select(F.col("gram").alias("word"), "n")
    found = words.unionByName(counts.filter(size == 1).select(F.col("gram").alias("word"), "n"))
    return found.orderBy(F.desc("n"), "word").limit(most)


class Segmenter:
    """A function of a list of texts: lower-cased letter and digit runs, CJK runs cut into words, of more than one character.

    words maps a word to how often it stands. A path's probability is the product of its words'; a
    character that is no word counts as if it stood once. Of equal paths the one with the longer
    first word is taken.
    """

    def __init__(self, words: dict[str, int]):
        total = max(1, sum(words.values()))
        self.unknown = -math.log(total)
        self.weight = {w: math.log(n / total) for w, n in words.items() if w and n > 0}
        # what begins a longer word, so that the graph's edges from a place end early
        self.begins = {w[:k] for w in self.weight for k in range(1, len(w))}
        self.segment = lru_cache(maxsize=1 << 16)(self._segment)

    def __reduce__(self):
        return _revived, (self.weight, self.unknown)

    def _segment(self, run: str) -> list[str]:
        n = len(run)
        best, ends = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            end, score = i + 1, self.weight.get(run[i], self.unknown) + best[i + 1]
            j = i + 1
            while j < n and run[i:j] in self.begins:
                j += 1
                w = self.weight.get(run[i:j])
                if w is not None and w + best[j] >= score:
                    end, score = j, w + best[j]
            best[i], ends[i] = score, end
        out, i = [], 0
        while i < n:
            out.append(run[i : ends[i]])
            i = ends[i]
        return out

    def __call__(self, texts: list[str]) -> list[list[str]]:
        return [_cut(t, self.segment) for t in texts]


def _revived(weight: dict[str, float], unknown: float) -> Segmenter:
    found = Segmenter({})
    found.weight, found.unknown = weight, unknown
    found.begins = {w[:k] for w in weight for k in range(1, len(w))}
    return found


class _Sent:
    """A segmenter that every worker gets once, by broadcast."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, texts: list[str]) -> list[list[str]]:
        return self.shared.value(texts)


def segmenting(dictionary: DataFrame, most: int = DICTIONARY) -> Tokenizer:
    """The tokenizer of a dictionary (word, n) of at most `most` words; more are refused."""
    rows = dictionary.select("word", F.col("n").cast("long")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary has at most {most} words")
    shared = dictionary.sparkSession.sparkContext.broadcast(Segmenter({r[0]: r[1] for r in rows if r[0] and r[1]}))
    return plugged(_Sent(shared))
