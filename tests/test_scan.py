"""Row numbers of long ordered tables."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.scan import carried, numbered
from riskloom.sources import trades


def expected(rows):
    seen, out = {}, []
    for key, at in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        out.append((key, at, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_of_a_task", [7, 1000])
def test_numbers_within_keys(spark, rows_of_a_task):
    rng = random.Random(2)
    # one key with most rows, null keys and orders, keys that end and begin at a task's edge
    rows = [("hot", rng.randrange(10**6)) for _ in range(300)] + [(rng.choice(["a", "b", None, "z", ""]), rng.choice([None, rng.randrange(50)])) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, at long").repartition(5)
    got = numbered(df, ["k"], ["at"], rows=rows_of_a_task).select("k", "at", "idx").collect()
    key = lambda t: (str(t[0]), t[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_numbers_of_equal_rows_and_of_all(spark):
    df = spark.range(500).select(F.lit("x").alias("k"), F.lit(1).alias("at"), (F.col("id") % 3).alias("v"))
    got = numbered(df, ["k"], ["at"], rows=20).collect()
    assert sorted(r["idx"] for r in got) == list(range(500)) and got[0].asDict().keys() == {"k", "at", "v", "idx"}
    tasks = numbered(df, ["k"], ["at"], rows=20).select(F.input_file_name()).distinct().count()
    assert tasks > 10  # equal rows are dealt to many tasks
    got = numbered(spark.range(100), [], [F.desc("id")], "n", rows=9).collect()
    assert all(r["n"] == 99 - r["id"] for r in got)
    assert numbered(spark.range(0), ["id"], ["id"]).count() == 0


def test_carried_counts():
    # tasks 0 to 4: a a | a | a b | (none) | b c
    assert carried([(0, "a", 2, "a", 2), (1, "a", 1, "a", 1), (2, "a", 1, "b", 1), (4, "b", 1, "c", 1)]) == [(1, 2), (2, 3), (4, 1)]
    assert carried([]) == []


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_csv_rows_in_file_order(spark, tmp_path, adaptive):
    """Fifty files of mixed sizes, one of many splits, and cells with line breaks."""
    rng, expected = random.Random(3), []
    for f in range(50):
        rows = [f"{f}-{i}" for i in range(20_000 if f == 17 else rng.choice([0, 1, 7, 300]))]
        said = [f'{x},"a ""b""\nc"' if f % 9 == 4 and i % 5 == 0 else f'{x},"q ""{i}"""' for i, x in enumerate(rows)]
        (tmp_path / f"part-{f:03}.csv").write_text("\n".join(["id,note", *said, ""]))
        expected += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
        got = sorted((r["_order"], r["id"], r["note"]) for r in trades.csv_scan(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[1] for r in got] == expected and [r[0] for r in got] == list(range(len(expected)))
    assert sum(r[2] == 'a "b"\nc' for r in got) == sum(int(x.split("-")[0]) % 9 == 4 and int(x.split("-")[1]) % 5 == 0 for x in expected)
