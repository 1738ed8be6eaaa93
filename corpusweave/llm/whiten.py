"""Whitening of embeddings.

Entries become integers on a grid of 1/64, so counts, sums and deviations are exact. The fit list
holds each distinct grid vector once. Its rows, centred exactly before any product, form an MLlib
RowMatrix whose Gramian, divided by their number, is the covariance. That is one small matrix: it is
decomposed on the driver, and mean and scaled eigenvectors are sent to the tasks, which whiten all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.common import written

GRID, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries from here on have no place on the grid and count as not finite.
LARGEST = 2.0**40
#: An eigenvalue under this share of the trace is rounding, not variance.
NOTHING = 1e-13


def grid(vector: Column, width: int | None = None) -> Column:
    """floor(64 c) + 1000000 of each entry as long; null if the vector or an entry is null, not finite or too large."""
    entries = F.transform(vector, lambda c: c.cast("double") * GRID)
    usable = F.forall(entries, lambda c: F.coalesce(F.abs(c) < GRID * LARGEST, F.lit(False)) & ~F.isnan(c))
    if width is not None:
        usable = usable & (F.size(vector) == width)
    return F.when(usable, F.transform(entries, lambda c: F.floor(c) + SHIFT))


@dataclass
class Whitening:
    """n fit rows with sums per dimension; columns of `project` are eigenvectors over the root of their eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    project: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def components(self) -> int:
        return self.project.shape[1]


def usual_width(rows: DataFrame, vector: str) -> int:
    """The commonest length of the usable vectors, the longer one of equals; 0 without any."""
    usable = rows.select(grid(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    most = usable.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return most[0] if most else 0


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension), added up in the tasks first."""
    if not width:
        return 0, []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * width
        for part in parts:
            n += len(part)
            # so many entries under 2^47 can't overflow
            for at in range(0, len(part), 1 << 15):
                got = np.stack(part["x"].iloc[at : at + (1 << 15)].to_numpy()).sum(0)
                total = [a + b for a, b in zip(total, got.tolist())]
        yield pd.DataFrame({"n": [n] * width, "dim": range(width), "total": [str(t) for t in total]})

    parts = fit.mapInPandas(run, "n bigint, dim int, total string")
    # as many rows as dimensions
    got = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (int(got[0]["n"]), [int(r["total"]) for r in got]) if got else (0, [0] * width)


def _gramian(rows: DataFrame, vector: str) -> np.ndarray:
    """Sum of the rows' outer products, by MLlib: partial sums in the tasks, added up in a tree."""
    own = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vector).alias("v")), "v")
    return RowMatrix(own).computeGramianMatrix().toArray()


def _parts_of(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole mean and rest of each dimension, so that n x - S = n (x - whole) - rest."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _centred(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """centred: (n x - S) / n of each row, the numerator in whole numbers while these are under 2^53."""
    whole, rest = _parts_of(sums, n)
    mean = fit.sparkSession.createDataFrame([(whole.tolist(), rest.tolist())], "whole array<bigint>, rest array<bigint>")
    size = F.lit(float(n))
    row = F.zip_with(F.zip_with("x", "whole", lambda x, m: (x - m).cast("double") * size), F.col("rest"), lambda y, r: (y - r.cast("double")) / size)
    return fit.crossJoin(F.broadcast(mean)).select(row.alias("centred"))  # one row


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """fit: (x), distinct grid vectors of one width, as a table. At most `components` eigenvectors, largest eigenvalue first."""
    n, sums = _sums(fit, width)
    most = min(components, width)
    if not n:
        return Whitening(0, sums, np.zeros(most), np.zeros((width, most)), np.full(most, np.nan))
    covariance = _gramian(_centred(fit, n, sums), "centred") / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors, trace = np.maximum(values[::-1], 0), vectors[:, ::-1], float(np.trace(covariance))
    real = values > trace * NOTHING
    project = vectors / np.sqrt(np.where(real, values, np.nan))
    explained = values / trace if trace > 0 else np.full(width, np.nan)
    found = Whitening(n, sums, values[:most], project[:, :most], explained[:most])
    found.identity_error = _measured_error(fit, found)
    return found


def _project(x: np.ndarray, w: Whitening) -> np.ndarray:
    whole, rest = _parts_of(w.sums, w.n)
    return ((x - whole) * float(w.n) - rest) / float(w.n) @ w.project


def _measured_error(fit: DataFrame, w: Whitening) -> float | None:
    """Largest entry of the whitened fit rows' covariance minus the identity, from a pass of its own."""
    real = np.flatnonzero(np.isfinite(w.project).all(0))
    if not len(real):
        return None
    some = Whitening(w.n, w.sums, w.values[real], w.project[:, real], w.explained[real])
    shared = fit.sparkSession.sparkContext.broadcast(some)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"v": list(_project(np.stack(part["x"].to_numpy()), shared.value))})

    gram = _gramian(fit.mapInPandas(run, "v array<double>"), "v")
    shared.unpersist()
    return float(np.abs(gram / w.n - np.eye(len(real))).max())


def apply_whitening(rows: DataFrame, w: Whitening) -> DataFrame:
    """rows (..., x) with deviation decimal(38,0) and whitened array<double> in place of x; the matrix is small and sent to the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    kept = [f for f in rows.schema if f.name != "x"]
    names = [f.name for f in kept]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        whole, rest = _parts_of(w.sums, w.n)
        for part in parts:
            if not len(part):
                continue
            x = np.stack(part["x"].to_numpy())
            # (n y - r)^2 = n^2 y^2 - 2 n y r + r^2, summed over the dimensions before n comes in
            y = x - whole
            small = max(float(np.abs(y).max(initial=0)) ** 2, float(np.abs(y).max(initial=0)) * float(rest.max(initial=0))) * max(1, y.shape[1]) < 2.0**62
            y, r = (y, rest) if small else (y.astype(object), rest.astype(object))
            squares, mixed, own = (y * y).sum(1), (y * r).sum(1), sum(int(v) ** 2 for v in rest)
            deviation = [str(w.n * w.n * int(a) - 2 * w.n * int(b) + own) for a, b in zip(squares, mixed)]
            yield part[names].assign(deviation=deviation, whitened=list(_project(x, w)))

    schema = T.StructType([*kept, T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(run, schema).withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """(key, deviation, whitened) of every usable row, and the fitted whitening.

    Rows whose vector is null or empty, holds null, NaN or infinite entries or ones of 2^40 and more,
    or is not of the commonest length (the longer of equals), have no place here and are left out. A
    component without variance (fewer distinct rows than dimensions, one distinct row) has NaN in
    whitened. Repeated rows each get their result; a null key is a key like others; other columns are
    ignored; an empty table gives an empty one.
    """
    width = usual_width(rows, vector)
    placed = rows.select(F.col(key).alias(key), grid(F.col(vector), width).alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    fit = written(placed.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    w = fit_whitening(fit, width, components)
    return apply_whitening(placed, w), w


def by_component(whitened: DataFrame, w: Whitening, key: str = "vec_id") -> DataFrame:
    """A row per row and component: key, component from 1, n, deviation, whitened, explained, identity_error. NaN becomes null."""
    number = lambda v: None if v is None or not np.isfinite(v) else float(v)
    explained = F.array(*[F.lit(number(v)).cast("double") for v in w.explained]) if w.components else F.array().cast("array<double>")
    each = whitened.select(key, "deviation", F.posexplode("whitened").alias("at", "v"))
    return each.select(
        key, (F.col("at") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.nanvl("v", F.lit(None).cast("double")).alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"), F.lit(w.identity_error).cast("double").alias("identity_error"),
    )
