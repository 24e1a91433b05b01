"""Answers must not depend on a size: long histories, deep designs, long chains of groups."""

import json

import numpy as np

from filetide.functions import paths
from filetide.operators import access, history, text, tree
from filetide.sources import inventory

from .helpers import GB, ago, history as make_history, listing


def long_history(n):
    draw = np.random.default_rng(n)
    totals = np.cumsum(draw.integers(0, 2 * 10**8, n))
    totals[700:] += 40 * GB  # one surge far behind the first 500
    return [(float(i), int(x)) for i, x in enumerate(totals)]


def test_whole_history_counts(spark):
    rows = long_history(1200)
    out = history.anomalies(make_history(spark, rows)).orderBy("ts").collect()
    totals = np.array([x for _, x in rows])
    rates = np.diff(totals).astype(float)
    assert len(out) == 1199 and [r["baseline_count"] for r in out] == list(range(1199))
    for i in range(5, 1199, 29):
        median = np.median(rates[:i])
        mad = max(np.median(np.abs(rates[:i] - median)), history.MAD_FLOOR)
        assert out[i]["baseline_median"] == median and abs(out[i]["baseline_mad"] - mad) < 1e-6
    assert [i for i, r in enumerate(out) if r["is_anomaly"]] == [699]


def test_smoothing_over_the_whole_history(spark):
    rows = long_history(1100)
    level, trend = float(rows[0][1]), float(rows[1][1] - rows[0][1])
    for _, y in rows[1:]:
        new = history.ALPHA * y + (1 - history.ALPHA) * (level + trend)
        trend, level = history.BETA * (new - level) + (1 - history.BETA) * trend, new
    got = history.holt(make_history(spark, rows)).first()
    assert abs(got["level"] - level) < 1e-6 * abs(level) and abs(got["trend"] - trend) < 1e-6 * abs(trend)


def test_chain_of_groups_with_a_cycle(spark, monkeypatch):
    """A thousand groups deep, closed in about ten rounds; each writes one table."""
    n = 1_000
    edges = [("user", "g0"), *[(f"g{i}", f"g{i + 1}") for i in range(n)], (f"g{n}", "g900")]
    written, original = [], access.cut_lineage
    monkeypatch.setattr(access, "cut_lineage", lambda df: written.append(1) or original(df))
    closure = access.group_closure(spark.createDataFrame(edges, "member_sid string, group_sid string"))
    assert {r["group_sid"]: r["depth"] for r in closure.where("member_sid = 'user'").collect()} == {f"g{i}": i + 1 for i in range(n + 1)}
    assert {r["group_sid"]: r["depth"] for r in closure.where("member_sid = 'g950'").collect()} == {f"g{900 + i}": i - 50 if i > 50 else i + 51 for i in range(101)}
    assert len(written) <= 12


def test_design_of_twenty_levels(spark, tmp_path):
    node = {"Name": "leaf", "EstimatedSizeBytes": 1, "MappedSourcePaths": ["C:\\x"], "AclEntries": [{"AccountName": "a", "Rights": 7, "AccessType": "Allow"}], "Children": []}
    for i in range(19):
        node = {"Name": f"n{i}", "EstimatedSizeBytes": i, "InheritAcl": False, "Children": [node, {"Name": "side"}]}
    (tmp_path / "d.json").write_text(json.dumps({"ProjectName": "p", "RootFolders": [node]}))
    made = inventory.load_design(spark, str(tmp_path / "d.json"))
    nodes = made["plan_nodes"]
    assert nodes.count() == 39 and nodes.agg({"level": "max"}).first()[0] == 19
    assert {r["level"] for r in nodes.where("name = 'leaf'").collect()} == {19}
    assert made["plan_sources"].count() == 1 and made["plan_aces"].first()["rights"] == 7


def test_drive_letters_in_many_spellings(spark):
    drives = spark.createDataFrame([*[(f"junk{i}", "x") for i in range(40)], ("z:\\", "\\\\srv\\share"), ("", "y"), (None, "w")], "drive string, remote string")
    out = paths.map_drives(spark.createDataFrame([("Z:\\a",), ("C:\\b",)], "path string"), drives)
    assert sorted(r["path"] for r in out.collect()) == ["C:\\b", "\\\\srv\\share\\a"]


def test_whole_content_decides_the_encoding(spark):
    late = ("x" * 9000 + "é").encode("utf-8")
    wide = ("日本" * 3000 + "plain ascii text " * 4000).encode("utf-16-le")  # its first 4 KiB hold few zero bytes
    shift = "日本語".encode("cp932")
    out = {r["path_key"]: r["text"] for r in text.decode_text(spark.createDataFrame([("a", late), ("b", wide), ("c", shift)], "path_key string, content binary")).collect()}
    assert out["a"].endswith("é") and out["b"].endswith("plain ascii text ") and out["c"] == "日本語"


def test_preorder_works_out_its_key_once_per_row(spark):
    entries = listing(spark, [("C:\\Data", 0, ago(1), ago(1), True), ("C:\\Data\\b", 0, ago(1), ago(1), True), ("C:\\Data\\b!", 1, ago(1), ago(1)), ("C:\\Data\\b\\a", 1, ago(1), ago(1))])
    ordered = tree.preorder(entries)
    assert [r["path_key"] for r in ordered.collect()] == ["c:/data", "c:/data/b", "c:/data/b/a", "c:/data/b!"]
    assert ordered.columns == entries.columns
    plan = ordered._jdf.queryExecution().optimizedPlan().toString()
    assert not any("translate(" in line for line in plan.splitlines() if "Sort [" in line)
