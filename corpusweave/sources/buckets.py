"""Tables in buckets of a key: joins and groups on the key need no shuffle of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BUCKETS = 16


def table_name(path: str) -> str:
    """The name under which a session knows the bucketed table at path."""
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, compression: str = "snappy") -> DataFrame:
    """Replaces the table at path by df, in buckets of keys and sorted by them, one file a bucket, and gives it back."""
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).option("compression", compression).saveAsTable(table_name(path))
    return df.sparkSession.table(table_name(path))


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The table that write_bucketed has put at path, in this session or an earlier one."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        cluster = ", ".join(f"`{k}`" for k in keys)
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({cluster}) SORTED BY ({cluster}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)
