"""Keyed tables in buckets: merges without a shuffle of the table, versions, readers between steps."""

import pytest
from pyspark.sql import functions as F

from corpusweave.sources import keyed, tables

SCHEMA = "id long, part string, v string, version int"


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def test_merges_give_the_rows_of_a_plain_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    base = rows(spark, [(i, f"p{i % 3}", f"old{i}", 1 + i % 2) for i in range(60)])
    keyed.create_table(base, path, ["id", "part"], buckets=4)
    want = base
    for delta in (
        [(i, f"p{i % 3}", "new", 2) for i in range(0, 60, 5)] + [(900, "p0", "a", 1), (900, "p0", "b", 3), (900, "p1", "c", 1)],
        [(5, "p2", "too old", 0), (1, "p1", "same version", 2), (900, "p0", "older", 2)],
        [],
    ):
        got = keyed.merge_into(path, rows(spark, delta), "version")
        want = tables.upsert(want, rows(spark, delta), ["id", "part"], "version")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert keyed._published(spark, path) == [2, 3]
    assert sorted(p.name for p in (tmp_path / "t/versions").iterdir()) == ["2", "3"]
    assert keyed.read_table_at(spark, path, 2).count() == got.count()


def exchanges(plan):
    """Lines of the plan with the table's scan, and whether an Exchange stands above each."""
    lines = plan.split("\n")
    out = []
    for at, line in enumerate(lines):
        if "FileScan" in line and "Bucketed: true" in line:
            depth, above = len(line) - len(line.lstrip(" +-:*()0123456789")), []
            for up in reversed(lines[:at]):
                own = len(up) - len(up.lstrip(" +-:*()0123456789"))
                if own < depth:
                    above.append(up)
                    depth = own
            out.append(any("Exchange" in a for a in above))
    return out


def test_a_merge_does_not_shuffle_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    base = keyed.create_table(rows(spark, [(i, "p", "x", 1) for i in range(200)]), path, ["id"], buckets=4)
    plan = keyed.merged(base, rows(spark, [(3, "p", "y", 2)]), ["id"], "version")
    found = exchanges(plan._jdf.queryExecution().executedPlan().toString())
    assert found == [False]


def test_readers_see_a_version_when_it_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.create_table(rows(spark, [(1, "p", "x", 1)]), path, ["id"], buckets=2)
    publish, seen = keyed._publish, []

    def look(spark_, path_, n):
        seen.append([r["v"] for r in keyed.read_table_at(spark, path).collect()])
        if len(seen) == 1:
            raise RuntimeError("lost")
        publish(spark_, path_, n)

    monkeypatch.setattr(keyed, "_publish", look)
    with pytest.raises(RuntimeError):
        keyed.merge_into(path, rows(spark, [(1, "p", "y", 2)]), "version")
    assert [r["v"] for r in keyed.read_table_at(spark, path).collect()] == ["x"]
    got = keyed.merge_into(path, rows(spark, [(1, "p", "y", 2)]), "version")
    assert seen == [["x"], ["x"]] and [r["v"] for r in got.collect()] == ["y"]
    with pytest.raises(ValueError):
        keyed.merge_into(path, rows(spark, [(None, "p", "y", 2)]), "version")


def test_a_bucketed_table_of_an_earlier_session_is_known_again(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create_table(rows(spark, [(i, "p", "x", 1) for i in range(50)]), path, ["id"], buckets=4)
    spark.sql(f"DROP TABLE {keyed.table_name(path + '/versions/0')}")
    again = keyed.read_table_at(spark, path)
    assert again.count() == 50
    assert "Exchange hashpartitioning" not in again.groupBy("id").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
