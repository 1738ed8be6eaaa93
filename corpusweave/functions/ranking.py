"""Ordinals and running totals over a whole table, without a window that one task would carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.shared import written

_ROW = (1 << 33) - 1


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, each row with its range (__p) and place in it (__m), as a table."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    m = F.monotonically_increasing_id()
    return written(ranged.withColumns({"__p": F.shiftright(m, 33).cast("int"), "__m": m.bitwiseAND(F.lit(_ROW))}))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with its rows' ordinals from 0 in the given order."""
    placed = _placed(df, list(order))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    skip = placed.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__skip"))
    # one row per range: at most as many as shuffle partitions
    return placed.join(F.broadcast(skip), "__p").withColumn(name, F.col("__skip") + F.col("__m")).drop("__p", "__m", "__skip")


def running_total(df: DataFrame, name: str, value: str, *order: Column) -> DataFrame:
    """df with the total of value up to and including each row in the given order."""
    placed = _placed(df, list(order))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    skip = placed.groupBy("__p").agg(F.sum(value).alias("s")).select("__p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__skip"))
    within = F.sum(value).over(Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__w", within).join(F.broadcast(skip), "__p").withColumn(name, F.col("__skip") + F.col("__w")).drop("__p", "__m", "__w", "__skip")
