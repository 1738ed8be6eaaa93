import random
import re

import pytest

from corpusweave.functions.ranking import numbered, running_total
from corpusweave.operators import integrate
from pyspark.sql import functions as F


def greedy(lens, room):
    used, kept = 0, []
    for n in lens:
        kept.append(used + n <= room)
        used += n if kept[-1] else 0
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_greedy_budget_equals_the_plain_loop(spark, seed):
    rnd = random.Random(seed)
    runs = {f"r{k}": ([rnd.choice([0, 1, 5, 30, 649, 650, rnd.randrange(651)]) for _ in range(rnd.randrange(1, 60))], rnd.choice([-5, 0, 40, 2000, 9000, 10**6])) for k in range(12)}
    items = spark.createDataFrame([(r, i, n) for r, (lens, _) in runs.items() for i, n in enumerate(lens)], "run_id string, rank long, len int").repartition(5)
    rooms = spark.createDataFrame([(r, room) for r, (_, room) in runs.items()], "run_id string, room long")
    got = {(r["run_id"], r["rank"]): r["kept"] for r in integrate.greedy_budget(items, rooms).collect()}
    assert got == {(r, i): k for r, (lens, room) in runs.items() for i, k in enumerate(greedy(lens, room))}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_ordinals_and_totals_for_any_partitioning(spark, parts):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(parts)
    assert all(r["n"] == r["k"] for r in numbered(df, "n", F.col("k")).collect())
    assert all(r["t"] == r["k"] * (r["k"] + 1) // 2 for r in running_total(df, "t", "k", F.col("k")).collect())


def test_manual_override(spark):
    d = spark.createDataFrame([("d1", "merge", "old", 0.8), ("d2", "keep", "old", 0.8), ("d3", "keep", "old", 0.8)], "decision_id string, action string, reason string, confidence double")
    p = spark.createDataFrame([("d1", "keep", "new", None), ("d2", "remove", None, 0.3), ("d3", "burn", "x", 0.1)], "decision_id string, action string, reason string, confidence double")
    got = {r["decision_id"]: tuple(r)[1:] for r in integrate.manual_override(d, p).collect()}
    assert got == {"d1": ("keep", "new（教师手动覆盖，原理由：old）", 0.97), "d2": ("remove", "old", 0.3), "d3": ("keep", "old", 0.8)}


def test_eligible_needs_two_books(spark):
    b = spark.createDataFrame([("A", "done"), ("B", "failed")], "textbook_id string, parse_status string")
    n = spark.createDataFrame([("A",), ("B",)], "textbook_id string")
    with pytest.raises(ValueError):
        integrate.eligible(b, n)


def test_latest_run_and_flow(spark):
    runs = spark.createDataFrame([("r1", 2, "x"), ("r2", 1, "y")], "run_id string, updated_at int, note string")
    assert integrate.latest_run(runs).first()["run_id"] == "r1" and integrate.latest_run(runs, "r2").first()["note"] == "y"
    counts = spark.createDataFrame([("r", 0, 2, 0)], "run_id string, n_merge long, n_keep long, n_remove long")
    assert {(r["source"], r["target"]): r["value"] for r in integrate.flow_table(counts).collect()}[("all", "merge")] == 1


def test_edition_is_written_in_the_order_of_decisions(spark, tmp_path):
    rows = [(i, "remove" if i % 5 == 0 else "keep" if i % 2 else "merge", "" if i % 7 == 0 else f"excerpt {i:03d}", f"b:c:p{i}:n") for i in range(100)]
    listing = spark.createDataFrame(rows, "position int, action string, source_excerpt string, result_ref string").repartition(7)
    integrate.write_edition(listing, str(tmp_path / "e"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))
    assert [int(n) for n in re.findall(r"excerpt (\d+)", lines)] == [i for i in range(100) if i % 5 and i % 7]
    assert lines.count("> 来源：b:c:p") == len([i for i in range(100) if i % 5 and i % 7])
