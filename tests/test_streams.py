"""Streams: history equal to its batch form whatever the order of arrival, alerts that load few blocks of state."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from filetide import schemas
from filetide.operators import history as H
from filetide.streaming import alerts, history

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.STATE_STORE)


def run(spark, folder, frame, out):
    query = frame.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{out}/rows")


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def test_history_out_of_order_and_late(spark, tmp_path):
    """Several arrivals, each out of order; what stays equals the batch form, what comes too late is counted."""
    draw = random.Random(4)
    rows = [(f"t{i % 3}", f"s{i:03d}", at(draw.randrange(0, 300) + draw.choice([0, 0.25, 0.5])), draw.randrange(10**9), None if i % 9 == 0 else i) for i in range(300)]
    rows += [(k, s + "b", ts, b, n) for k, s, ts, b, n in rows[:40]]  # equal times: the smaller id stays
    draw.shuffle(rows)
    folder = str(tmp_path / "in")
    out = str(tmp_path / "out")
    write = lambda part: spark.createDataFrame(part, schemas.SNAPSHOTS).write.mode("append").parquet(folder)
    for part in (rows[:100], rows[100:250], rows[250:]):
        write(part)
        stream = history.stream_history(history.read_snapshots(spark, folder), "10 minutes")
        written = run(spark, folder, stream, out)
    assert written.count() == 0  # no second has closed
    write([("closing", "x", at(10_000), 0, 0)])
    run(spark, folder, stream, out)
    late = [("t1", f"late{i}", at(i), 5, 5) for i in range(7)] + [("new", "late", at(3), 5, 5)]
    write(late)
    write([("closing", "y", at(10_001), 0, 0)])
    written = run(spark, folder, stream, out)
    batch = H.load_history([spark.createDataFrame(rows, schemas.SNAPSHOTS)])
    kept = written.where("not late").drop("late")
    assert sorted(kept.collect(), key=str) == sorted(batch.collect(), key=str)
    assert {r["target_key"]: r["late"] for r in history.late_counts(written.where("late")).collect()} == {"t1": 7, "new": 1}


def test_blocked_baseline_equals_numpy():
    """Small blocks that split, with equal rates; a verdict loads few of them."""
    draw = np.random.default_rng(3)
    stored: dict[int, list[float]] = {}
    index = ([], [], [])
    past: list[float] = []
    for step in range(60):
        base = alerts.Baseline(*(list(x) for x in index), lambda number: list(stored[number]), block=8)
        for rate in np.round(draw.normal(size=20) * 10, 1):
            if past:
                median = base.median()
                assert len(base) == len(past) and median == np.median(past)
                assert base.mad(median) == pytest.approx(np.median(np.abs(np.array(past) - median)), abs=1e-12)
            base.add(float(rate))
            past.append(float(rate))
        for number in base.changed:
            stored[number] = list(base.rates(number))
        index = (base.ids, base.counts, base.lows)
    assert sorted(x for held in stored.values() for x in held) == sorted(past) and max(map(len, stored.values())) < 16
    base = alerts.Baseline(*index, lambda number: list(stored[number]), block=8)
    base.mad(base.median())
    assert base.loaded() < len(stored) / 4


def test_alerts_equal_batch_over_several_triggers(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    total, rows = 10**12, []
    for i in range(160):
        total += draw.randrange(10**8) + (60 * 1024**3 if i in (40, 120) else 0)
        rows.append(("t", f"s{i:03d}", at(i * 86_400), total, i))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:60], rows[60:100], rows[100:]):
        spark.createDataFrame(part, schemas.SNAPSHOTS).write.mode("append").parquet(folder)
        stream = alerts.stream_growth_alerts(history.read_snapshots(spark, folder))
        written = run(spark, folder, stream, out)
    got = {r["snapshot_id"]: (r["baseline_count"], r["is_anomaly"], r["z_score"]) for r in written.collect()}
    want = {r["snapshot_id"]: (r["baseline_count"], r["is_anomaly"], r["z_score"]) for r in H.anomalies(spark.createDataFrame(rows, schemas.SNAPSHOTS)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and {k for k, v in got.items() if v[1]} == {"s040", "s120"}
    assert all(v[2] is None or v[2] == pytest.approx(want[k][2]) for k, v in got.items())


def test_history_keeps_many_seconds_in_one_state_row(spark, tmp_path):
    rows = [(f"t{i % 40}", f"s{i}", at(i), i, i) for i in range(2000)]
    spark.createDataFrame(rows, schemas.SNAPSHOTS).write.parquet(str(tmp_path / "in"))
    stream = history.stream_history(history.read_snapshots(spark, str(tmp_path / "in")), "10 minutes")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(stream.schema).parquet(str(tmp_path / "rows")).collect()
    assert sorted(r["snapshot_id"] for r in written) == sorted(f"s{i}" for i in range(2000 - 1 - 600))
    used = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    assert used < 2000  # 128 parts with a row of state and its timers, not a row a second


def test_hits_of_a_batch_are_found_without_keeping_it(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from filetide.operators.search import SearchSpec
    from filetide.streaming import hits

    rows = spark.range(40).select(F.concat(F.lit("/r/f"), "id").alias("path"), F.concat(F.lit("f"), "id", F.lit(".txt")).alias("name"), F.lit(".txt").alias("ext"),
                                  (F.col("id") % 4 == 3).alias("is_dir"), F.col("id").alias("size"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    kept = []
    monkeypatch.setattr(type(rows), "persist", lambda self, *a: kept.append(self) or self)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    hits.stream_hits(arriving, SearchSpec(extensions=["txt"], min_size=10), f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    wanted = [i for i in range(10, 40) if i % 4 != 3]
    assert hits.running_totals(spark, f"{tmp_path}/out").first()[:] == (len(wanted), sum(wanted)) and not kept
    assert sorted(r["size"] for r in spark.read.parquet(f"{tmp_path}/out/hits").collect()) == wanted
