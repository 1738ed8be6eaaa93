"""Keyed tables in buckets of their key, in numbered versions.

A merge reads the table bucket by bucket: only the new rows are shuffled, to the buckets that they
belong to. The next version lies beside the last one until it is whole; then its number is
published, and versions that no reader can be at any more are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.functions.shared import delete_folder
from corpusweave.sources.buckets import BUCKETS, read_bucketed, table_name

#: Versions that stay beside the current one, for readers that have begun.
KEPT = 1


def _published(spark: SparkSession, path: str) -> list[int]:
    return [r[0] for r in spark.read.schema("n long").parquet(f"{path}/published").select("n").distinct().orderBy("n").collect()]  # KEPT + 1 numbers


def _write(rows: DataFrame, path: str, n: int, keys: list[str], buckets: int) -> None:
    where = f"{path}/versions/{n}"
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", where).saveAsTable(table_name(where))


def _publish(spark: SparkSession, path: str, n: int) -> None:
    spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/published/at={n}")
    for old in _published(spark, path):
        if old < n - KEPT:
            delete_folder(spark, f"{path}/published/at={old}")
            spark.sql(f"DROP TABLE IF EXISTS {table_name(f'{path}/versions/{old}')}")
            delete_folder(spark, f"{path}/versions/{old}")


def create_table(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Makes the keyed table at path from rows, in which keys don't repeat, and gives it back."""
    spark = rows.sparkSession
    spark.createDataFrame([(keys, buckets)], "keys array<string>, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    _write(rows.repartition(buckets, *keys), path, 0, keys, buckets)
    _publish(spark, path, 0)
    return read_table_at(spark, path)


def read_table_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The keyed table at path in its last published version, or in one that is still there."""
    keys, buckets = spark.read.parquet(f"{path}/layout").first()
    where = f"{path}/versions/{_published(spark, path)[-1] if version is None else version}"
    return read_bucketed(spark, where, spark.read.parquet(where).schema, keys, buckets)


def last_of(delta: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return delta.withColumn("__k", order).filter("__k = 1").drop("__k")


def merged(base: DataFrame, delta: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base with delta put in: of equal keys the largest version stays, delta before base; keys are not null."""
    new = last_of(delta.select(base.columns), keys, version)
    b, d = F.struct(*base.columns), F.struct(*base.columns)
    both = base.select(*keys, b.alias("__b")).join(new.select(*keys, d.alias("__d")), keys, "full")
    older = F.col("__d").isNull() | (F.col("__b").isNotNull() & (F.col(f"__b.{version}") > F.col(f"__d.{version}")))
    return both.select(F.when(older, F.col("__b")).otherwise(F.col("__d")).alias("r")).select("r.*")


def merge_into(path: str, delta: DataFrame, version: str) -> DataFrame:
    """Puts delta into the keyed table at path as its next version and gives that back.

    Rows of delta with a null key are refused. A merge that failed leaves the table as it was, and
    may be done again: it writes the same version again.
    """
    spark = delta.sparkSession
    keys, buckets = spark.read.parquet(f"{path}/layout").first()
    if not delta.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).isEmpty():
        raise ValueError("keys can't be null")
    n = _published(spark, path)[-1]
    rows = merged(read_table_at(spark, path, n), delta, keys, version)
    _write(rows, path, n + 1, keys, buckets)
    _publish(spark, path, n + 1)
    return read_table_at(spark, path)
