"""One key owning all rows: joins deal it over tasks, and waves and running values are worked out in parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from filetide.operators import migrate, skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(3_000)] + [(f"k{i % 30}", i) for i in range(300)] + [(None, 1), ("alone", 2)], "k string, v int")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), *[(f"k{i}", "c") for i in range(0, 60, 2)], (None, "d")], "k string, w string")
    got = skew.measured_join(left, right, ["k"], how, hot_rows=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_one_key_with_all_rows_takes_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left = spark.range(40_000).select(F.when(F.col("id") >= 0, "hot").otherwise("cold").alias("k"), "id").repartition(8)
        right = spark.createDataFrame([("hot", 1)], "k string, w int")
        joined = skew.measured_join(left, right, ["k"], hot_rows=500)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) <= 8_000
        assert len(left.join(right, ["k"]).groupBy(F.spark_partition_id()).count().collect()) == 1  # what a plain join does
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salts_follow_the_rows_of_each_key(spark, monkeypatch):
    counts = spark.createDataFrame([("a", 1_000), ("b", 250), ("c", 100), ("d", 99)], "k string, _rows long")
    assert {r["k"]: r["_salts"] for r in skew.hot_keys(counts, ["k"], 100).collect()} == {"a": 10, "b": 3, "c": 1}
    assert skew.hot_keys(counts, ["k"], 2_000) is None
    monkeypatch.setattr(skew, "HOT_LIST", 5)  # only keys with a fifth of the hot rows are listed
    assert {r["k"]: r["_salts"] for r in skew.hot_keys(counts, ["k"], 100).collect()} == {"a": 4}


def test_running_values_of_a_hot_key(spark):
    draw = random.Random(1)
    rows = [("hot", i, draw.randrange(-5, 50)) for i in range(2_000)] + [("b", 1, 7), ("c", 5, None), ("c", 6, 2)]
    frame = spark.createDataFrame(rows, "k string, i int, v int").repartition(6)
    sums = {(r["k"], r["i"]): r["out"] for r in skew.running_sum(frame, ["k"], ["i"], "v", "out").collect()}
    least = {(r["k"], r["i"]): r["out"] for r in skew.running_min(frame, ["k"], [F.desc("i")], "v", "out").collect()}
    total = 0
    for _, i, v in rows[:2_000]:
        assert sums["hot", i] == total
        total += v
    assert least["hot", 0] == min(v for _, _, v in rows[1:2_000]) and least["hot", 1_999] is None
    assert sums["b", 1] == 0 and least["b", 1] is None and sums["c", 6] == 0 and least["c", 5] == 2


def walk(sizes: list[int], budget: int) -> list[int]:
    wave, filled, count, out = 1, 0, 0, []
    for size in sizes:
        if count and filled + size > budget:
            wave, filled, count = wave + 1, 0, 0
        filled, count = filled + size, count + 1
        out.append(wave)
    return out


@pytest.mark.parametrize("budget", [0, 100])
def test_one_plan_with_all_pieces(spark, budget):
    """Zero sizes, oversize pieces at the start, in the middle and at the end."""
    draw = random.Random(budget)
    plans = {
        "large": [500, *[draw.choice([0, 0, 5, 40, 120, 300]) for _ in range(400)], 500], "zeros": [0] * 9, "one": [7], "big": [900],
        "tail": [1, 2, 900, 0, 0, 3],
    }
    rows = [(p, f"u{i}", i, "n", s, None) for p, sizes in plans.items() for i, s in enumerate(sizes)]
    draw.shuffle(rows)
    pieces = spark.createDataFrame(rows, "plan_id string, unit_id string, unit_ord int, name string, size bigint, files bigint")
    got = {(r[0], r[1]): r[2] for r in migrate.next_fit(pieces, budget).collect()}
    assert got == {(p, f"u{i}"): w for p, sizes in plans.items() for i, w in enumerate(walk(sizes, budget))}
