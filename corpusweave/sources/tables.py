"""Keyed tables: upserts, slice replacement, cascades, JSON lists and vector blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both by key; of equal keys the largest version stays, delta before base."""
    rows = base.withColumn("__new", F.lit(0)).unionByName(delta.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return rows.withColumn("__k", last).filter("__k = 1").drop("__k", "__new")


def replace_slices(base: DataFrame, delta: DataFrame, slice_key: str) -> DataFrame:
    """base with every slice that delta has rows of replaced by delta's."""
    return base.join(delta.select(slice_key).distinct(), slice_key, "left_anti").select(base.columns).unionByName(delta)


def write_slices(delta: DataFrame, path: str, slice_key: str) -> None:
    """Overwrites only the partitions that delta has rows of; a slice has few files, a large one more."""
    delta.hint("rebalance", slice_key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slice_key).parquet(path)


def cascade_delete(parents: DataFrame, children: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    """parents and children without the rows of the keys in gone."""
    ids = gone.select(key).distinct()
    return [t.join(ids, key, "left_anti") for t in (parents, *children)]


def replace_parents(parents: DataFrame, delta: DataFrame, children: list[DataFrame], key: str, version: str, drop_children: bool = True) -> list[DataFrame]:
    """Upsert of parents; as replacing a row deletes it first, its children go too."""
    kids = [c.join(delta.select(key).distinct(), key, "left_anti") for c in children] if drop_children else children
    return [upsert(parents, delta, [key], version), *kids]


def to_json_list(c: Column) -> Column:
    return F.to_json(c)


def from_json_list(c: Column) -> Column:
    return F.from_json(F.coalesce(c, F.lit("[]")), "array<string>")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector; null stays null."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def vector_to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
