"""Exact dedup by deterministic block naming.

Each text is cut into blocks of fixed size. Distinct blocks get integer names, their ranks in the
order of their digests; then distinct pairs of adjacent names get their ranks as names, and so on
until one name is left of each text. Two texts of as many blocks have the same last name if and
only if they are equal: a digest names a block only where no two distinct blocks share it, which is
told from the blocks' whole content, and pairs of names are compared as they are. Names depend on
the texts alone, not on how they are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.ranking import numbered
from corpusweave.llm.common import ascii_lower, written

BLOCK_BYTES = 1024
#: Stands for the missing right neighbour of an odd last name; no name is negative.
NONE = -1


def _normal(docs: DataFrame, key: str, text: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.select(F.col(key).alias("doc_id"), norm.alias("norm")).select("doc_id", F.sha2("norm", 256).alias("sha"), F.col("norm").cast("binary").alias("bytes"))


def _blocks(size: int) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("bytes") / F.lit(size)) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))


def _block_names(norm: DataFrame, places: DataFrame, size: int, digest: Callable[[Column], Column]) -> DataFrame:
    """places (row, n_blocks, pos, digest) with `name` in place of digest.

    Distinct content is shuffled once. Blocks whose digest another one shares are named by their
    content, after all others.
    """
    content = norm.select(F.explode(_blocks(size)).alias("block")).distinct()
    known = written(content.select(digest("block").alias("digest")))
    names = numbered(known.groupBy("digest").agg(F.count("*").alias("n")), "name", F.col("digest"))
    names = written(names)
    found = places.join(names.filter("n = 1").select("digest", "name"), "digest")
    twins = names.filter("n > 1").select("digest")
    if not twins.isEmpty():
        top = names.agg(F.max("name")).first()[0] + 1
        cut = norm.select("doc_id", "sha", F.posexplode(_blocks(size)).alias("pos", "block")).withColumn("digest", digest("block")).join(twins, "digest", "left_semi").distinct()
        named = numbered(cut.select("block").distinct(), "name", F.col("block")).select("block", (F.col("name") + top).alias("name"))
        by_text = cut.join(named, "block").select("doc_id", "sha", "pos", "name")
        wanted = places.join(twins, "digest", "left_semi")
        same = wanted["doc_id"].eqNullSafe(by_text["doc_id"]) & (wanted["sha"] == by_text["sha"]) & (wanted["pos"] == by_text["pos"])
        found = found.unionByName(wanted.join(by_text, same).select("digest", *(wanted[c] for c in places.columns if c != "digest"), "name"))
    return found.select("row", "n_blocks", "pos", "name")


def identities(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row, doc_id, sha, n_blocks, name): equal texts share (n_blocks, name); row is a number of the row of docs."""
    norm = _normal(docs, key, text)
    digests = F.transform(_blocks(block_bytes), lambda b: digest(b))
    rows = written(norm.select("doc_id", "sha", digests.alias("digests")).withColumn("row", F.monotonically_increasing_id()))
    places = rows.select("row", "doc_id", "sha", F.size("digests").alias("n_blocks"), F.posexplode("digests").alias("pos", "digest"))
    level = written(_block_names(norm, places, block_bytes, digest))
    rounds = max(0, (level.agg(F.max("n_blocks")).first()[0] or 1) - 1).bit_length()
    done, todo = level.filter("n_blocks = 1"), level.filter("n_blocks > 1")
    for r in range(1, rounds + 1):
        left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
        pairs = todo.groupBy("row", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(left, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(NONE)).alias("right"))
        pairs = written(pairs)
        names = numbered(pairs.select("left", "right").distinct(), "name", F.col("left"), F.col("right"))
        level = written(pairs.join(names, ["left", "right"]).select(level.columns))
        one = F.col("n_blocks") <= F.lit(1 << r)
        done, todo = done.unionByName(level.filter(one)), level.filter(~one)
    return rows.select("row", "doc_id", "sha").join(done.select("row", "n_blocks", "name"), "row")


def _grouped(docs: DataFrame, **options) -> DataFrame:
    """identities() with keep_id, group_size and the row that stays of each group."""
    rows = written(identities(docs, **options))
    # a table of its own, so that a hot group's rows can be split in the join
    last = F.max(F.struct("doc_id", (-F.col("row")).alias("turned")))
    groups = written(rows.groupBy("n_blocks", "name").agg(last.alias("last"), F.count("*").alias("group_size")).select("n_blocks", "name", F.col("last.doc_id").alias("keep_id"), (-F.col("last.turned")).alias("keep_row"), "group_size"))
    return rows.join(groups, ["n_blocks", "name"])


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest doc_id stays. A null doc_id is smaller than any other; of rows that
    repeat both doc_id and text one is kept and all count in group_size. Texts of any length are
    compared whole; other columns are ignored; an empty table gives an empty one.
    """
    return _grouped(docs, **options).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns.

    A row is known again by its key and digest, so whole rows are shuffled once; only rows that
    repeat both are told apart by a second shuffle, of themselves. Edge cases as in exact_groups.
    """
    last = _grouped(docs, key=key, text=text, **options).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = written(last.groupBy("doc_id", "sha").agg(F.count("*").alias("__copies")))
    given = docs.withColumn("__sha", F.sha2(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), 256))
    stays = given.join(kept.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__kept_sha"), "__copies"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")))
    if kept.filter("__copies > 1").isEmpty():
        return stays.select(docs.columns)
    once = stays.filter("__copies > 1").dropDuplicates([key, "__sha"])
    return stays.filter("__copies = 1").unionByName(once).select(docs.columns)
