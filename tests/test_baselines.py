"""Running median and MAD in blocks, against sorting everything before each row."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from filetide.operators import baselines
from filetide.operators.skew import number_within


def plain(values):
    out = []
    for i in range(len(values)):
        past = values[:i]
        median = statistics.median(past) if past else None
        out.append((i, median, statistics.median(abs(v - median) for v in past) if past else None))
    return out


def series(kind: str, n: int, seed: int) -> list[float]:
    draw = random.Random(seed)
    if kind == "gap":  # the median hops over a gap, and the MAD's borders with it
        return [draw.choice([-30, -10, 0, 10, 30]) + draw.random() / 100 for _ in range(n)]
    if kind == "hop":
        return [(10.0 if i % 2 else -10.0) + i / 1000 for i in range(n)]
    if kind == "up":
        return [float(i * i) for i in range(n)]
    if kind == "down":
        return [float(-i) for i in range(n)]
    if kind == "equal":
        return [draw.choice([1.0, 2.0]) for _ in range(n)]
    return [draw.gauss(0, 1) * 10 ** draw.randrange(4) for _ in range(n)]


KINDS = ["gap", "hop", "up", "down", "equal", "noise"]


@pytest.mark.parametrize("kind", KINDS)
def test_walk_in_one_task(kind):
    values = series(kind, 400, 3)
    for before in (0, 5, 150):
        seen = baselines.Seen(np.array(values[:before]), np.ones(before))
        median, mad = baselines.walk(np.array(values[before:]), before, seen)
        for i, m, d in plain(values)[before:]:
            assert m is None or (median[i - before], mad[i - before]) == (m, d)


@pytest.mark.parametrize("block", [16, 64])
def test_blocks_equal_one_task(spark, block):
    """Every key larger than many blocks; one of a single row; rows arrive out of order."""
    data = {kind: series(kind, 330, i) for i, kind in enumerate(KINDS)} | {"single": [4.0]}
    rows = [(k, i, v, "kept") for k, vs in data.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, at int, v double, extra string")
    got = baselines.running_median_mad(frame, "k", ["at"], "v", block=block)
    assert got.columns == ["k", "at", "v", "extra", "earlier_count", "earlier_median", "earlier_mad"]
    found = {(r["k"], r["at"]): (r["earlier_count"], r["earlier_median"], r["earlier_mad"]) for r in got.collect()}
    assert found == {(k, i): row for k, vs in data.items() for i, row in enumerate(plain(vs))}


def test_tasks_hold_blocks_only(spark, monkeypatch):
    """With all rows in one key, a time block gets a few blocks of values, not the history."""
    n, block = 6_000, 128
    draw = random.Random(2)
    frame = spark.createDataFrame([("k", i, draw.gauss(0, 1)) for i in range(n)], "k string, at int, v double")
    sizes, original = [], baselines.context

    def measured(*arguments):
        sent = original(*arguments)
        sizes.append(sent.groupBy("_tb").count().agg(F.max("count")).first()[0])
        return sent

    monkeypatch.setattr(baselines, "context", measured)
    baselines.running_median_mad(frame, "k", ["at"], "v", block=block).count()
    assert len(sizes) == 2 and max(sizes) < 16 * block  # of 6,000 rows


def test_no_rows(spark):
    frame = spark.createDataFrame([], "k string, at int, v double")
    assert baselines.running_median_mad(frame, "k", ["at"], "v").collect() == []


def test_numbers_within_a_hot_key(spark):
    rows = [("hot", i, -i) for i in range(5_000)] + [(f"k{i % 40}", i, 0) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    got = number_within(frame, ["k"], ["v", "i"], "at").collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["at"], r["v"], r["i"]))
    for held in by.values():
        held.sort()
        assert [h[0] for h in held] == list(range(len(held))) and [h[1:] for h in held] == sorted(h[1:] for h in held)
