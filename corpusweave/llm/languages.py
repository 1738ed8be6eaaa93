"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (1 to 3, word-bounded) by rank. A
document's own ranking is compared to each profile by the out-of-place distance: how far each
n-gram stands from its place there, or the profile's length if it isn't there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.common import held_out, slices, texts_of

PROFILE = 300
TRAIN_ROWS = 20_000
UNKNOWN = "und"
#: Not 0, or a word's first letter with the space before it would be the letter alone.
SPACE = 1
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1- to 3-grams of the lower-cased words; 21 bits per character, SPACE between words."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(chars, 0xFFFF)]
    if (high := chars > 0xFFFF).any():
        letter[high] = [chr(c).isalpha() for c in chars[high]]
    c = np.full(len(chars) + 2, SPACE, np.int64)
    c[1:-1] = np.where(letter, chars, SPACE)
    c = c[np.concatenate(([True], (c[1:] != SPACE) | (c[:-1] != SPACE)))]  # one space between words
    two, inner = (c[:-1] << 21) | c[1:], c[1:-1] != SPACE
    if len(c) < 2:  # no letter at all
        two = two[:0]
    return np.unique(np.concatenate((c[c != SPACE], two, ((two[:-1] << 21) | c[2:])[inner])), return_counts=True)


def profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): each language's most frequent n-grams, from 0; ties by code.

    Rows of null text or lang teach nothing.
    """
    given = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            langs = np.array(part.column(0).to_pylist(), object)
            texts = texts_of(part)
            for one in dict.fromkeys(langs):
                codes, counts = grams(" ".join(texts[i] for i in np.flatnonzero(langs == one)))
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    counts = given.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # the row number itself in the filter lets Spark keep only the first rows of each task before the shuffle
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("rank"))


def training_rows(docs: DataFrame, *, key: str = "doc_id", lang: str = "lang", most: int = TRAIN_ROWS) -> DataFrame:
    """Rows to learn from: not held out, and of each language about `most` by a hash of the key."""
    rows = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull())
    shares = rows.groupBy(F.col(lang).alias("__lang")).agg(F.least(F.lit(1.0), most / F.count("*")).alias("__share"))
    picked = F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(1 << 20)) < F.col("__share") * (1 << 20)
    # one row per language
    return rows.join(F.broadcast(shares), F.col(lang) == F.col("__lang")).filter(picked).select(docs.columns)


class Ranks:
    """The profiles as a matrix of places, one row per n-gram and a last one for those in none."""

    def __init__(self, learned: DataFrame, size: int = PROFILE):
        table = learned.select("lang", "gram", "rank").toPandas()  # size rows per language
        self.size, self.names = size, sorted(table["lang"].unique())
        self.codes = np.unique(table["gram"].to_numpy(np.int64))
        self.places = np.full((len(self.codes) + 1, max(1, len(self.names))), size, np.int32)
        self.places[np.searchsorted(self.codes, table["gram"]), [self.names.index(x) for x in table["lang"]]] = table["rank"]

    def predict(self, text: str) -> tuple[str, float]:
        found, counts = grams(text)
        if not self.names or not len(found):
            return UNKNOWN, 0.0
        top = found[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        there = self.places[at]
        far = np.where(there == self.size, self.size, np.abs(there - np.arange(len(top))[:, None])).sum(0)
        best = int(far.argmin())
        return self.names[best], 1 - float(far[best]) / (self.size * len(top))


def predict(docs: DataFrame, learned: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = PROFILE) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    score is 1 minus the distance as a share of the largest possible one. A text that is null or
    has no letter is `und` with score 0, and so is every text when no language was learned. Equal
    distances go to the first language by name. Texts are read whole; repeated rows give repeated
    rows; other columns are ignored; an empty table gives an empty one. The profiles (size rows per
    language) are sent to the tasks.
    """
    ranks = Ranks(learned, size)
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([given.schema[0]]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [ranks.predict(t) for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema.names)

    return given.mapInArrow(run, schema)


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows of docs that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    learned = profiles(training_rows(docs, key=key, lang=lang), text=text, lang=lang)
    return predict(docs, learned, key=key, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose text has letters and a score of least or more, with all their columns.

    With no language learned, every text with a letter stays.
    """
    ranks = Ranks(profiles(training_rows(docs, key=key, lang=lang), text=text, lang=lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = texts_of(part, text)
            stays = [ranks.predict(t)[1] >= least if ranks.names else len(grams(t)[0]) > 0 for t in texts]
            yield part.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
