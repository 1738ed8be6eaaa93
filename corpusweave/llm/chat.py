"""Chat formatting after a cumulative-snapshot collapse.

Logs often hold a conversation again each time it grows. A hash of the first k turns is kept
for every k; a conversation whose last hash is an inner hash of another is a snapshot of it and
goes. What is left is rendered with role tags, a row a turn, so a conversation of any length is
spread over rows and tasks; read in order the rows are its training text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.ranking import numbered
from corpusweave.llm.common import written

TURNS_PER_PART = 1024


def _same(x: DataFrame, y: DataFrame, *cols: str) -> Column:
    return reduce(lambda a, b: a & b, (x[c].eqNullSafe(y[c]) for c in cols))


def _keyed(turns: DataFrame, part: int) -> DataFrame:
    """turns with their run of `part` turn numbers (null: the first), and sha, the digest of the text."""
    return turns.withColumns({"role": F.coalesce("role", F.lit("")), "sha": F.sha2(F.coalesce("text", F.lit("")), 256), "run": F.coalesce(F.floor(F.col("turn") / part), F.lit(-(1 << 62)))})


def _by_crowd(rows: DataFrame, part: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of runs with `part` rows or fewer, rows of the other runs with their place in the run, from 1).

    Places in a crowded run are ordinals of a range-partitioned table, so no task holds the run.
    """
    crowded = written(rows.groupBy("conv_id", "run").agg(F.count("*").alias("m")).filter(F.col("m") > part).select("conv_id", "run"))
    if crowded.isEmpty():
        return rows, None
    same = _same(rows, crowded, "conv_id", "run")
    ordered = numbered(rows.join(crowded, same, "left_semi"), "g", *map(F.col, ("conv_id", "run", "turn", "role", "sha")))
    first = written(ordered.groupBy("conv_id", "run").agg(F.min("g").alias("g0")))
    placed = ordered.join(first, _same(ordered, first, "conv_id", "run")).select(*(ordered[c] for c in rows.columns), (F.col("g") - F.col("g0") + 1).alias("place"))
    return rows.join(crowded, same, "left_anti"), placed


def _positions(rows: DataFrame, part: int) -> DataFrame:
    """rows (see _keyed) with pos, their place in their conversation from 1, n, its turns, and piece.

    Places are counted within pieces of at most `part` rows of a run of `part` turn numbers, and
    over the runs' sums, so that neither a conversation of any length nor a turn number that
    repeats is a single task's work.
    """
    usual, crowded = _by_crowd(rows, part)
    ranked = usual.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("turn", "role", "sha")).cast("long"))
    if crowded is not None:
        ranked = ranked.unionByName(crowded)
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "run").agg(F.count("*").alias("m")).select("conv_id", "run", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"), F.sum("m").over(conv).alias("n"))
    placed = ranked.join(counts, _same(ranked, counts, "conv_id", "run"))
    return placed.select(*(ranked[c] for c in rows.columns), F.floor((F.col("place") - 1) / part).alias("piece"), (F.col("place") + F.col("skip")).alias("pos"), "n")


def prefix_hashes(turns: DataFrame, part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, pos, n, a, b): two 64-bit hashes of the first pos of n turns, from 1, rolled within pieces and over their sums."""
    at = _positions(_keyed(turns, part).select("conv_id", "turn", "role", "sha", "run"), part)
    cell = ["conv_id", "run", "piece"]
    hashed = written(at.select(*cell, "pos", "n", F.xxhash64(F.lit("a"), "pos", "role", "sha").alias("a"), F.xxhash64(F.lit("b"), "pos", "role", "sha").alias("b")))
    sums = hashed.groupBy(*cell).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("run", "piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*cell, *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ab"))
    within = Window.partitionBy(*cell).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select(*cell, "pos", "n", *(F.bit_xor(c).over(within).alias(c) for c in "ab"))
    return rolled.join(carried, _same(rolled, carried, *cell)).select(rolled["conv_id"], "pos", "n", F.col("a").bitwiseXOR(F.col("a0")).alias("a"), F.col("b").bitwiseXOR(F.col("b0")).alias("b"))


def maximal(turns: DataFrame, part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, n): the conversations that are no snapshot of another; of equal ones the smallest id.

    Equality of prefixes is that of both 64-bit hashes and of the number of turns.
    """
    prefixes = written(prefix_hashes(turns, part))
    whole = prefixes.filter("pos = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.filter("pos < n").select(F.col("pos").alias("n"), "a", "b").distinct()
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", "n")


def render(turns: DataFrame, *, start: str = "<|im_start|>", end: str = "<|im_end|>", part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, pos, n_turns, rendered): a row for each turn of the maximal conversations, with its role tags.

    turns has conv_id, turn, role and text. Turns are ordered by turn (null first), role and the
    digest of the text; pos counts them from 1; null role or text is empty; a repeated row is a
    repeated turn; a null conv_id is a conversation like others, and goes before none of its
    equals. Other columns are ignored; an empty table gives an empty one.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = written(maximal(rows, part).select(F.col("conv_id").alias("kept_id")))
    stays = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id")
    line = F.concat(F.lit(start), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end + "\n"))
    return _positions(_keyed(stays, part), part).select("conv_id", "pos", F.col("n").alias("n_turns"), line.alias("rendered"))
