"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the open scopes, the innermost last.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode without one, a folder of its own, set once."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; one that isn't there is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are deleted at the end, but for those with keep=True."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    token = _SCOPES.set((*_SCOPES.get(), path))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        delete_folder(spark, path)


def written(df: DataFrame, *, keep: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    It belongs to the innermost scope, or with keep=True to the one around that; outside of all it
    stays. by names columns that get folders of their own.
    """
    spark = df.sparkSession
    scopes = _SCOPES.get()[:-1] if keep else _SCOPES.get()
    path = f"{scopes[-1] if scopes else f'{shared_dir(spark)}/tables'}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
