"""Steps that many readers share are worked out once, and sorts work out their keys once per row."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from filetide import schemas
from filetide.operators import audit, baselines, hygiene, migrate
from filetide.plans import audit as audit_plan
from filetide.plans import forecast as forecast_plan
from filetide.session import cut_lineage, small_scans
from filetide.sources import snapshots as store
from verification.tables import Tables

from .helpers import NOW, ago, history, listing

SMALL = "/root/testdata/sf0.001"


def versions(spark):
    return listing(spark, [(f"C:\\Data\\f{i % 9}_v{i}.txt", i, ago(i), ago(i)) for i in range(400)]).coalesce(1)


def test_audit_deals_its_entries_and_reads_them_once(spark, monkeypatch):
    seen = {}
    real = hygiene.discover
    monkeypatch.setattr(audit_plan.hygiene, "discover", lambda files, *a, **k: (seen.update(plan=files._jdf.queryExecution().optimizedPlan().toString()), real(files, *a, **k))[1])
    entries = versions(spark)
    none = spark.createDataFrame([], "path_key string, size bigint, modified_at timestamp")
    found = audit_plan.collect_reasons(entries, None, none, NOW, audit_plan.AuditOptions(path_limits=False, dormant=False))
    assert found.where("issue_type = 'VersionFamily'").count() == 391
    assert "LocalRelation" not in seen["plan"] and "LogicalRDD" not in seen["plan"] and "parquet" in seen["plan"]


@pytest.mark.parametrize("name", ["Default", "IssueType", "FileName"])
def test_named_orders_work_out_their_keys_once(spark, name):
    none = spark.createDataFrame([], "path_key string, size bigint, modified_at timestamp")
    found = audit_plan.collect_reasons(versions(spark), None, none, NOW, audit_plan.AuditOptions(path_limits=False))
    plan = audit.sort(audit.combine(found), name)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "Sort [" in x)
    assert "(" not in line.split("Sort [")[1].split("]")[0]


def test_lines_are_joined_once(spark):
    plan = Tables(spark, SMALL).entries._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "o_orderdate" in plan


def test_tree_json_is_packed(spark, tmp_path):
    entries = versions(spark)
    store.export_tree_json(entries, str(tmp_path / "json"))
    parts = [f for f in os.listdir(tmp_path / "json") if f.startswith("part-")]
    assert parts and all(f.endswith(".json.gz") for f in parts)
    back = store.import_tree_json(spark, str(tmp_path / "json"))
    assert sorted(map(str, back.collect())) == sorted(map(str, entries.select(*schemas.ENTRIES.names).collect()))


def test_block_counts_grow_no_faster_than_the_values(spark, monkeypatch):
    n, made = 3000, {}
    real = baselines._later_blocks
    monkeypatch.setattr(baselines, "_later_blocks", lambda narrow, key, kind, done, block: (made.update(block=block), real(narrow, key, kind, done, block))[1])
    rows = spark.range(n).select(F.lit("k").alias("k"), "id", (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    out = {r["id"]: r for r in baselines.running_median_mad(rows, "k", ["id"], "v", block=8).collect()}
    assert made["block"] ** 2 >= n
    values = [i * 7919 % 1009 for i in range(n)]
    for i in (1, 2, 500, 2999):
        past = sorted(values[:i])
        median = (past[(i - 1) // 2] + past[i // 2]) / 2
        assert out[i]["earlier_median"] == median
        far = sorted(abs(v - median) for v in past)
        assert out[i]["earlier_mad"] == (far[(i - 1) // 2] + far[i // 2]) / 2


def test_a_task_scans_a_bounded_part_of_a_table(spark):
    key = "spark.sql.files.maxPartitionBytes"
    default = spark.conf.get(key)
    try:
        written = cut_lineage(spark.range(1_000_000).select("id", F.md5(F.col("id").cast("string")).alias("s")).coalesce(1), 1 << 20)
        small_scans(spark, 4 << 20)
        sizes = [r["count"] for r in written.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1_000_000 and max(sizes) < 250_000
        spark.conf.set(key, "1m")
        small_scans(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, default)


def test_entries_are_not_joined_again_to_count_a_place(spark, monkeypatch):
    entries = listing(spark, [("C:\\Data\\a", 0, NOW, NOW, True), ("C:\\Data\\a\\b", 0, NOW, NOW, True), *[(f"C:\\Data\\a\\b\\f{i}.txt", i, NOW, NOW) for i in range(20)],
                              *[(f"C:\\Data\\a\\g{i}.txt", i, NOW, NOW) for i in range(5)], ("C:\\Data\\h.txt", 1, NOW, NOW)])
    units = spark.createDataFrame([("p", 1, "c:/data/a", "d:/one"), ("p", 2, "c:/data/a/b", "d:/two"), ("q", 1, "c:/data/a", "d:/three")], "plan_id string, wave int, source_key string, destination_key string")
    joins = []
    real = migrate.measured_join
    monkeypatch.setattr(migrate, "measured_join", lambda *a, **k: (joins.append(k.get("counts")), real(*a, **k))[1])
    got = migrate.expected_items(entries, units)
    assert len(joins) == 2 and all(counts is not None for counts in joins)
    paths = sorted((r["plan_id"], r["target_key"]) for r in got.where("not is_dir").collect())
    expected = [("p", f"d:/one/g{i}.txt") for i in range(5)] + [("p", f"d:/two/f{i}.txt") for i in range(20)] + [("q", f"d:/three/g{i}.txt") for i in range(5)]
    assert paths == sorted(expected)
    monkeypatch.setattr(migrate, "cut_lineage", lambda df: df)
    plan = migrate._covered(entries, units.select(F.col("source_key").alias("place_key")))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_forecast_builds_what_is_asked_for(spark, monkeypatch):
    asked = []
    for name in ("rate_baseline", "holt", "anomalies"):
        real = getattr(forecast_plan.history, name)
        monkeypatch.setattr(forecast_plan.history, name, lambda *a, n=name, f=real, **k: (asked.append(n), f(*a, **k))[1])
    gb = 1024**3
    totals = history(spark, [(day, day * gb + (400 * gb if day == 11 else 0)) for day in range(12)])
    below = totals.select("target_key", "snapshot_id", F.lit("a").alias("name"), F.col("total_bytes").alias("size"))
    parts = forecast_plan.forecast(totals, below)
    assert list(parts) == ["trend", "baseline", "anomalies", "history", "contributors"]
    rows = parts["contributors"].collect()
    assert [(r["snapshot_id"], r["name"], r["delta_bytes"], r["rank"]) for r in rows] == [("s011", "a", 401 * gb, 1)]
    assert asked == ["anomalies"]


def moved(spark):
    entries = listing(spark, [("C:\\Data\\a", 0, NOW, NOW, True), ("C:\\Data\\a\\b", 0, NOW, NOW, True), *[(f"C:\\Data\\a\\b\\f{i}.txt", i, NOW, NOW) for i in range(6)],
                              *[(f"C:\\Data\\a\\g{i}.txt", i, NOW, NOW) for i in range(4)], ("C:\\Data\\h.txt", 1, NOW, NOW)])
    units = spark.createDataFrame([("p", 1, "c:/data/a", "d:/one"), ("p", 2, "c:/data/a/b", "d:/two")], "plan_id string, wave int, source_key string, destination_key string")
    return entries, units


def exchanged(df):
    """The exchanges of a plan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_entries_are_exchanged_once_to_find_their_unit(spark):
    entries, units = moved(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = migrate.expected_items(entries, units)
        assert len([x for x in exchanged(items) if "head_key" in x]) == 2  # the entries and the units of their heads
        assert not [x for x in exchanged(items) if "parent_key" in x or "hashpartitioning(path_key" in x or "place_key" in x.split("ENSURE")[0] and "path_key" in x.split("ENSURE")[0]]
        got = sorted((r["target_key"], r["wave"]) for r in items.where("not is_dir").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([(f"d:/two/f{i}.txt", 2) for i in range(6)] + [(f"d:/one/g{i}.txt", 1) for i in range(4)])


def test_expected_paths_and_what_is_there_meet_in_one_exchange(spark, monkeypatch):
    entries, units = moved(spark)
    written = []
    real = migrate.cut_lineage
    monkeypatch.setattr(migrate, "cut_lineage", lambda df: (written.append(df), real(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = migrate.expected_once(real(migrate.expected_items(entries, units).drop("sha256")))
        there = real(entries.withColumn("path_key", F.translate(F.replace("path_key", F.lit("c:/data/a/b/"), F.lit("d:/two/")), "5", "9")))
        now = entries.withColumn("size", F.when(F.col("name") == "f2.txt", 99).otherwise(F.col("size")))
        written.clear()
        result = migrate.verify(once, there, now, columns=["target_key", "wave"])
        assert len(written) == 1 and set(written[0].columns) == {"target_key", "wave", "source_key", "is_dir", "size", "modified_at", "_dir", "_size"}
        assert len(exchanged(written[0])) == 2  # one for either side, none between grouping and join
        got = {r["target_key"]: r["problem"] for r in result.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = {f"d:/two/f{i}.txt": None for i in range(5)} | {"d:/two/f2.txt": "SourceChanged", "d:/two/f5.txt": "Missing", "d:/one": "Missing", "d:/two": "Missing"}
    assert got == expected | {f"d:/one/g{i}.txt": "Missing" for i in range(4)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    ids = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = ids()
    table = cut_lineage(spark.range(1000).repartition(7, "id"))
    assert table.count() == 1000 and ids() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
