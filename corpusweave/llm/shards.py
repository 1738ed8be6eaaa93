"""Sharding by extendible hashing.

A directory is indexed by the first bits of a hash of the key. A bucket whose bytes exceed the
limit splits on the next bit; the others stay, so shards lie at different depths. The directory
is built a few bits at a time from sums, and only rows of buckets that are still too large
take part in the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import written

HASH_BITS = 60
STEP_BITS = 6


def key_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text; null as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("hash", HASH_BITS - bits)


def _directory(rows: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """(prefix, depth, bytes, docs, split) for each `bits`-bit prefix of rows: the shallowest bucket
    of more than base bits (or of none, for base 0) around it that fits, else itself with split."""
    cells = rows.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("size").alias("bytes"), F.count("*").alias("docs"))
    first = 0 if base == 0 else base + 1
    levels = cells.select("prefix", "bytes", "docs", F.explode(F.sequence(F.lit(first), F.lit(bits))).alias("depth")).withColumn("bucket", F.expr(f"shiftright(prefix, {bits} - depth)"))
    sums = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    around = levels.select("prefix", "depth", "bucket").join(sums, ["depth", "bucket"])
    best = around.groupBy("prefix").agg(F.min(F.when((F.col("bytes") <= limit) | (F.col("depth") == bits), F.struct("depth", "bytes", "docs"))).alias("b"))
    return best.select("prefix", "b.depth", "b.bytes", "b.docs", (F.col("b.bytes") > limit).alias("split"))


def assign(docs: DataFrame, limit_bytes: int, *, key: str = "doc_id", text: str = "text", step_bits: int = STEP_BITS) -> DataFrame:
    """One row per row of docs: doc_id, shard, depth, shard_bytes, shard_docs, oversized.

    shard is the bucket's bit prefix ("" when one shard holds all). Sizes are UTF-8 bytes, null
    text 0. Rows that share a key share a shard: where such rows, or one row alone, exceed the
    limit the bucket splits to the last bit and is marked oversized. Ties can't arise; other
    columns are ignored; an empty table gives an empty one.
    """
    rows = written(docs.select(F.col(key).alias("doc_id"), key_hash(F.col(key)).alias("hash"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("size")))
    todo, base, done = rows, 0, None
    while True:
        bits = min(HASH_BITS, base + step_bits)
        directory = written(_directory(todo, base, bits, limit_bytes))
        # the first directory has 2^step_bits rows at most; later ones are joined as Spark sees fit
        placed = todo.withColumn("prefix", _prefix(bits)).join(F.broadcast(directory) if base == 0 else directory, "prefix")
        last = bits == HASH_BITS or not directory.filter("split").limit(1).count()
        ends = placed if last else placed.filter("NOT split")
        part = ends.select("doc_id", F.expr(f"lpad(bin(shiftright(prefix, {bits} - depth)), depth, '0')").alias("shard"), "depth", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), F.col("split").alias("oversized"))
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        todo, base = written(placed.filter("split").select(todo.columns)), bits


def write(docs: DataFrame, path: str, limit_bytes: int, *, key: str = "doc_id", text: str = "text", name: str = "shard_folder", **options) -> None:
    """Writes docs as one folder of Parquet files per shard, named by the column `name` of the written table.

    All columns of docs are written, whatever their names; a column called `name` is refused. Rows
    of a null key share the shard of the empty key. An empty table writes an empty folder.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}: choose another name for the folders")
    shards = assign(docs, limit_bytes, key=key, text=text, **options).select(F.col("doc_id").alias("__id"), F.concat(F.lit("p"), "shard").alias(name)).distinct()
    placed = docs.join(shards, docs[key].eqNullSafe(shards["__id"])).drop("__id")
    placed.repartition(name).write.partitionBy(name).parquet(path)
