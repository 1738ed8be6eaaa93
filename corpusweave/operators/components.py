"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.shared import written


def _state(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum: equal when nothing changed."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"] or 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(id, component) for every id of links; component is the smallest id reachable.

    Alternates large-star and small-star steps until the edge table stops changing. A step takes
    the minimum over a node's neighbours, then sends it along the node's edges, so no task holds
    the neighbours of a hub; the joins are left to skew handling. Links of null ends are ignored.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    edges = written(ends.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: a node's larger neighbours move to the smallest of its neighbourhood
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: the node and its smaller neighbours move to the smallest of these
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    alone = ends.filter("x = y").select(F.col("x").alias("id"))
    roots = edges.select(F.col("v").alias("id")).unionByName(alone).distinct().join(edges.select(F.col("u").alias("id")), "id", "left_anti")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
