"""Quality scores by Bradley-Terry pairwise ranking.

Documents labelled 1 are preferred to documents labelled 0. Each preference pair says that the
better document's features outweigh the worse one's; a logistic loss on the difference of their
features, without intercept, gives one weight per feature. The score quantile at the share of
0 labels among the training rows is the threshold: the score there is CUT.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.functions.ranking import numbered
from corpusweave.llm.common import held_out, slices, texts_of, written

CUT = 0.3
PAIRS_PER_ROW = 3
#: ASCII marks whose shares are features of their own.
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]


def features(text: str) -> list[float]:
    """Shape of a text: marks, cases, digits, word and line lengths, repeats. Empty texts too."""
    raw = text.encode()
    n = max(1, len(raw))
    tally = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    share = lambda x, y: math.log1p(100 * x / y)
    upper, lower, digits, high = int(tally[65:91].sum()), int(tally[97:123].sum()), int(tally[48:58].sum()), int(tally[128:].sum())
    marks = int(tally[MARKS].sum())
    return [
        *(share(int(tally[c]), nw) for c in MARKS),
        share(upper, n), share(lower, n), share(digits, n), share(high, n), share(marks, n), share(int(tally[32]), n), share(int(tally[10]), n),
        math.log1p(len(words)), math.log1p(len(lines)), math.log1p(sum(map(len, words)) / nw), math.log1p(max(map(len, words), default=0)), math.log1p(nw / nl),
        len(set(words)) / nw, len(set(lines)) / nl, share(sum(w.isupper() for w in words), nw), share(sum(w.isalpha() for w in words), nw), share(sum(w[:1].isupper() for w in words), nw),
        share(sum(x.rstrip()[-1:] in b".!?" for x in lines), nl), float(len(words) < 5), float(len(words) < 20), float(not words),
    ]


WIDTH = len(features(""))


def featurize(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f): one row per row of docs."""
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = np.array([features(t) for t in texts_of(part)], np.float32).reshape(-1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * WIDTH, rows)], ["doc_id", "f"])

    return given.mapInArrow(run, T.StructType([given.schema[0], T.StructField("f", T.ArrayType(T.FloatType()))]))


def pairs(train: DataFrame, better: int, worse: int, per_row: int = PAIRS_PER_ROW) -> DataFrame:
    """(label, diff): differences of features within preference pairs, both ways round.

    Both classes are numbered in the order of a hash. Each row of the larger class meets per_row
    rows of the smaller one, by its number and shifts of it modulo their count, so every row has
    its pairs and those of the smaller class have as many as each other, but for one a shift.
    """
    many, few = (1, 0) if better >= worse else (0, 1)
    size = min(better, worse)
    shuffled = lambda y: numbered(train.filter(F.col("y") == y).select("f", F.xxhash64(F.lit("pair"), "doc_id").alias("h")), "place", F.col("h"), F.hash("f"))
    shifts = F.explode(F.array(*(F.lit(k * max(1, size // per_row)) for k in range(per_row)))).alias("shift")
    a = shuffled(many).select(F.col("f").alias("fa"), "place", shifts).select("fa", F.pmod(F.col("place") + F.col("shift"), F.lit(size)).alias("place"))
    b = shuffled(few).select(F.col("f").alias("fb"), "place")
    sign = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sign")
    met = a.join(b, "place").select("fa", "fb", sign)
    diff = F.zip_with("fa", "fb", lambda x, y: ((x - y) * F.col("sign")).cast("double"))
    label = F.when(F.col("sign") > 0, float(many)).otherwise(float(few))
    return met.select(label.alias("label"), array_to_vector(diff).alias("diff"))


def fit(train: DataFrame, *, per_row: int = PAIRS_PER_ROW) -> tuple[np.ndarray, float, float]:
    """(weights, threshold, slope) from rows (doc_id, f, y). All zero when a class is missing."""
    sizes = train.groupBy("y").count().collect()  # two rows
    n = {r["y"]: r["count"] for r in sizes}
    if not n.get(0) or not n.get(1):
        return np.zeros(WIDTH), 0.0, 0.0
    model = LogisticRegression(featuresCol="diff", labelCol="label", fitIntercept=False, regParam=1e-3, maxIter=60).fit(pairs(train, n[1], n[0], per_row))
    weights = model.coefficients.toArray()
    raw = written(train.select("y", _dot(weights).alias("s")))
    cut, low, high = raw.approxQuantile("s", [n[0] / (n[0] + n[1]), 0.05, 0.95], 0.001)
    return weights, cut, 4 / max(high - low, 1e-9)


def _dot(weights: np.ndarray):
    w = F.array(*map(F.lit, weights.tolist()))
    return F.aggregate(F.zip_with("f", w, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns from labelled rows that aren't held out (labels 0 or 1; others and null are ignored; a
    repeated label row counts once, and a document that has both labels is an example of each).
    score rises with the Bradley-Terry score and is `cut` at the threshold quantile; predicted is
    1 from there on. Null and empty texts have features like others. With one class only every
    score is 0.5. Repeated rows give repeated rows; other columns are ignored; an empty table
    gives an empty one.
    """
    rows = written(featurize(docs, key=key, text=text))
    marked = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)").distinct()
    train = written(rows.join(marked, "doc_id").filter(~held_out(F.col("doc_id"))))
    weights, at, slope = fit(train)
    score = F.lit(0.5) if not slope else 1 / (1 + F.exp(-F.lit(slope) * (_dot(weights) - F.lit(at)) - F.lit(math.log(cut / (1 - cut)))))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
