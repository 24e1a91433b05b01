"""Expected-value cases: small inputs whose answers are known."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from filetide import schemas
from filetide.functions import formats, linktext, markup, rights, snippets, terms
from filetide.functions.naming import with_family
from filetide.operators import access, acl_diff, audit, dedupe, history, hygiene, media, migrate, skew, text, tree
from filetide.plans.audit import AuditOptions, hygiene_audit
from filetide.plans.migration import plan_waves

from .helpers import GB, NOW, ago, history as make_history, listing


def column(df, name, key="path_key"):
    return {r[key]: r[name] for r in df.collect()}


def test_roll_up_equals_plain_sums(spark):
    rows = [("C:\\Data", 0, ago(1), ago(1), True)]
    rows += [(f"C:\\Data\\b{i % 16}", 0, ago(1), ago(1), True) for i in range(16)]
    rows += [("C:\\Data\\empty", 0, ago(1), ago(1), True)]
    for i in range(800):
        folder = "C:\\Data" if i < 600 else f"C:\\Data\\b{i % 16}"
        rows.append((f"{folder}\\f{i}{['.LOG', '.tmp', '.txt'][i % 3]}", i + 1, ago(1), ago(1)))
    entries = listing(spark, rows)
    rolled = {r["folder_key"]: r for r in tree.root_share(tree.rollup(entries)).collect()}
    assert (rolled["c:/data"]["bytes"], rolled["c:/data"]["files"], rolled["c:/data"]["folders"]) == (320_400, 800, 17)
    assert rolled["c:/data/empty"]["files"] == 0 and rolled["c:/data"]["percentage"] == 100.0
    assert [r["size"] for r in tree.largest_files(entries).collect()] == list(range(800, 790, -1))
    by_ext = column(tree.extension_totals(entries), "bytes", "extension")
    assert by_ext == {e: sum(i + 1 for i in range(800) if i % 3 == k) for k, e in enumerate([".log", ".tmp", ".txt"])}


def test_salted_attach_equals_plain_join(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count("*").alias("_n"), F.max("v").alias("top"))
    salted = skew.attach(rows, groups, ["k"], group_rows="_n", hot_rows=100)
    plain = rows.join(groups.drop("_n"), "k")
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_numbers_do_not_depend_on_cut_points(spark):
    df = spark.range(5000).select((F.col("id") % 97).alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    df = df.withColumn("root_key", F.lit("r")).withColumn("snapshot_id", F.lit("s"))
    numbered = dedupe.number_groups(df).collect()
    expected = sorted(numbered, key=lambda r: (-r["size"], r["sha256"]))
    assert [r["group_index"] for r in expected] == list(range(1, 5001))


def test_lag_in_slices_equals_window(spark):
    from pyspark.sql import Window

    df = make_history(spark, [(i * 11.0, i * i) for i in range(60)])
    sliced = skew.lag_in_slices(df, ["target_key"], ["ts", "snapshot_id"], ["total_bytes"], F.date_trunc("month", "ts"))
    plain = df.withColumn("p", F.lag("total_bytes").over(Window.partitionBy("target_key").orderBy("ts")))
    assert column(sliced, "prev_total_bytes", "snapshot_id") == column(plain, "p", "snapshot_id")


def test_family_keys(spark):
    names = ["見積書_最終_本当.xlsx", "見積書_修正版.xlsx", "report - コピー (2).txt", "report_20240105.txt", "v1.txt", "plan_v2 _.txt"]
    got = {r["name"]: (r["family_key"], r["suffix"]) for r in with_family(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got[names[0]][0] == got[names[1]][0] == "見積書.xlsx"
    assert got[names[2]] == ("report.txt", "コピー (2)") and got[names[3]] == ("report.txt", "20240105")
    assert got["v1.txt"] == ("v1.txt", "") and got["plan_v2 _.txt"] == ("plan_v2.txt", "")


def test_hygiene_and_combined_reasons(spark):
    big, small = b"x" * 262_144, b"y" * 131_072
    rows, content = [], []
    for name, data in (("original_large", big), ("copy_large", big), ("original_small", small), ("copy_small", small)):
        path = f"C:\\Data\\{name}.bin"
        rows.append((path, len(data), ago(4 * 365.25), ago(4 * 365.25)))
        content.append((path.lower().replace("\\", "/"), data))
    entries = listing(spark, rows)
    ignores = spark.createDataFrame([], schemas.IGNORES)
    errors = spark.createDataFrame([], schemas.SCAN_ERRORS)
    result = hygiene_audit(entries, spark.createDataFrame(content, schemas.FILE_CONTENT), ignores, errors, NOW,
                           AuditOptions(versions=False, archives=False, graveyards=False))
    ordered = audit.sort(result["candidates"]).collect()
    assert [(r["name"], r["score"], r["is_cleanable"]) for r in ordered] == [
        ("copy_large.bin", 165, True), ("copy_small.bin", 165, True), ("original_large.bin", 70, False), ("original_small.bin", 70, False)]
    assert result["summary"].first()["ready_bytes"] == 393_216


def test_versions_archives_graveyards(spark):
    kb = 1024
    rows = [
        ("C:\\Data\\Docs\\見積書_最終_本当.xlsx", 10, ago(2), ago(2)), ("C:\\Data\\Docs\\見積書_修正版.xlsx", 10, ago(30), ago(30)),
        ("C:\\Data\\ProjectLogs_2025.zip", 10, ago(5), ago(5)), ("C:\\Data\\ProjectLogs_2025\\a.log", 10, ago(5), ago(5)),
    ]
    rows += [(f"C:\\Data\\Old\\{i}.pdf", size * kb, ago((4 + i / 3) * 365.25), ago((4 + i / 3) * 365.25)) for i, size in enumerate([500, 500, 200])]
    found = hygiene.discover(listing(spark, rows), NOW).collect()
    kinds = {r["issue_type"]: r for r in found}
    assert len(found) == 3
    assert kinds["VersionFamily"]["name"] == "見積書_修正版.xlsx"
    assert kinds["ExtractedArchive"]["name"] == "ProjectLogs_2025.zip"
    assert (kinds["GraveyardTree"]["path_key"], kinds["GraveyardTree"]["size"]) == ("c:/data/old", 1_228_800)


def test_original_pick(spark):
    data = b"z" * 122_880
    names = ["report - コピー.txt", "sub\\report.txt", "report (1).txt", "report.txt"]
    entries = listing(spark, [(f"C:\\Data\\{n}", len(data), ago(1), ago(1)) for n in names])
    content = spark.createDataFrame([(f"c:/data/{n.lower()}".replace("\\", "/"), data) for n in names], schemas.FILE_CONTENT)
    rows = dedupe.grouped(dedupe.confirmed(dedupe.size_groups(entries), content)).collect()
    assert [r["name"] for r in rows if r["is_original"]] == ["report.txt"] and len(rows) == 4
    assert {r["sha256"] for r in rows} == {hashlib.sha256(data).hexdigest()} and {r["group_id"] for r in rows} == {"DUP-0001"}


def test_forecast(spark):
    points = make_history(spark, [(0, 100 * GB), (2, 120 * GB), (7, 170 * GB), (14, 240 * GB)])
    row = history.threshold_status(history.regression(points), F.lit(300 * GB)).first()
    assert row["slope"] == pytest.approx(10 * GB) and row["r_squared"] > 0.99
    assert row["status"] == "Reachable" and row["days_to_target"] == pytest.approx(6)
    assert history.threshold_status(history.regression(points), F.lit(200 * GB)).first()["status"] == "AlreadyExceeded"
    assert history.threshold_status(history.regression(points.limit(2))).first()["status"] == "NotEnoughData"
    level = history.holt(points).first()
    assert level["level"] == pytest.approx(240 * GB) and level["trend"] == pytest.approx(10 * GB)


def test_later_snapshots_never_change_a_verdict(spark):
    mb = 1024 * 1024
    totals = [(d, 1000 * mb + d * 5 * mb) for d in range(6)] + [(6, 1000 * mb + 25 * mb + 2048 * mb)]
    later = totals + [(6 + i, totals[-1][1] + i * 900 * mb) for i in range(1, 6)]
    first = column(history.anomalies(make_history(spark, totals)), "is_anomaly", "snapshot_id")
    second = column(history.anomalies(make_history(spark, later)), "is_anomaly", "snapshot_id")
    assert first["s006"] and sum(first.values()) == 1
    assert {k: second[k] for k in first} == first


def test_bit_rule_equals_ordered_walk(spark):
    rng = random.Random(7)
    rows = [("t", f"/f{f}", o, rng.getrandbits(31), rng.choice(["Allow", "Deny"]), rng.random() < 0.3, 3, rng.choice([0, 0, 2]), 0, "x", f"a{o}")
            for f in range(300) for o in range(rng.randint(1, 9))]
    aces = spark.createDataFrame(rows, "target string, path_key string, ace_order int, rights int, access_type string, is_inherited boolean, "
                                       "inherit_flags int, prop_flags int, rank int, label string, account string")
    by_bit = {r["path_key"]: (r["allowed"], r["denied"]) for r in access.effective_rights(aces).collect()}
    by_walk = {r["path_key"]: (r["allowed"], r["denied"]) for r in access.rights_by_fold(aces).collect() if r["allowed"]}
    assert {k: v for k, v in by_walk.items() if k in by_bit} == by_bit and len(by_bit) > 200


def test_group_cycle_and_depth(spark):
    edges = [("user", "team"), ("team", "section"), ("section", "all"), ("all", "team")]
    closure = {(r[0], r[1]): r[2] for r in access.group_closure(spark.createDataFrame(edges, schemas.MEMBER_OF)).collect()}
    assert closure[("user", "team")] == 1 and closure[("user", "all")] == 3 and closure[("team", "team")] == 3


def test_acl_multiset_diff(spark):
    key = "path_key string, ace_order int, sid string, account string, rights int, access_type string, is_inherited boolean, inherit_flags int, prop_flags int"
    before = spark.createDataFrame([("/f", 0, "S1", "A", rights.READ, "Allow", False, 3, 0), ("/f", 1, "S1", "A", rights.MODIFY, "Allow", False, 1, 0)], key)
    after = spark.createDataFrame([("/f", 0, "S1", "A", rights.FULL, "Allow", False, 3, 0), ("/f", 1, "S1", "A", rights.MODIFY | rights.SYNCHRONIZE, "Allow", False, 1, 0)], key)
    folders = spark.createDataFrame([("/f", True, True)], "path_key string, inherit_before boolean, inherit_after boolean")
    names = spark.createDataFrame([], schemas.PRINCIPALS)
    plan = acl_diff.change_plan(acl_diff.with_account_key(before, names), acl_diff.with_account_key(after, names), folders).collect()
    assert sorted(r["diff_type"] for r in plan) == ["Modified", "Untouched"]


def test_waves(spark):
    nodes = spark.createDataFrame([
        ("p", "s", None, 0, "Sales", 0, 120 * GB, None, True), ("p", "sc", "s", 0, "East", 1, 30 * GB, None, True),
        ("p", "d", None, 1, "Dev", 0, 20 * 1024 * GB, 150_000, True)], schemas.PLAN_NODES)
    sources = spark.createDataFrame([("p", "s", "C:\\Sales"), ("p", "sc", "C:\\Sales\\East"), ("p", "d", "C:\\Dev")], schemas.PLAN_SOURCES)
    plan = plan_waves(nodes, sources, "D:\\New")
    waves = {r["wave"]: r for r in plan["waves"].collect()}
    assert len(waves) == 2 and waves[1]["bytes"] == 120 * GB and waves[1]["files"] is None
    assert waves[2]["many_files"] and waves[2]["over_48h"]
    assert [(r["source_key"], r["excluded_key"]) for r in plan["exclusions"].collect()] == [("c:/sales", "c:/sales/east")]
    assert plan["overlaps"].isEmpty()
    one = plan_waves(nodes, sources, "D:\\New", migrate.BUDGET, 25_000 * GB)["waves"].collect()
    assert [r["wave"] for r in one] == [1]


def test_next_fit_streams_every_plan(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", f"u{i}", i, "n", rng.choice([0, 5, 40, 120]), None) for p in range(5) for i in range(200)]
    pieces = spark.createDataFrame(rows, "plan_id string, unit_id string, unit_ord int, name string, size bigint, files bigint")
    got = {(r[0], r[1]): r[2] for r in migrate.next_fit(pieces, 100).collect()}
    for p in range(5):
        wave, filled, count = 1, 0, 0
        for _, unit, _, _, size, _ in (r for r in rows if r[0] == f"p{p}"):
            if count and filled + size > 100:
                wave, filled, count = wave + 1, 0, 0
            filled, count = filled + size, count + 1
            assert got[(f"p{p}", unit)] == wave


def test_search_arguments():
    assert terms.size_bounds(">1KB") == (1024, None) and terms.size_bounds("1KB..2KB") == (1024, 2048) and terms.size_bounds("7") == (7, 7)
    assert terms.years_before(NOW.replace(month=2, day=29), 1).day == 28
    assert terms.dormant_bound(">=3y", NOW) == NOW.replace(year=2021) and terms.dormant_bound("x", NOW) is None
    with pytest.raises(Exception):
        terms.pattern("(")


def test_formulas_and_rewriting(spark):
    rows = [("SUM(Table1[Amount])", False), ("'C:\\x\\[Book.xlsx]S'!A1", True), ("[1]!A1", True), ("[Book.xlsx]S!A1", True), ("A1", False)]
    df = spark.createDataFrame(rows, "f string, want boolean").withColumn("got", linktext.is_external_formula("f"))
    assert all(r["got"] == r["want"] for r in df.collect())
    one = spark.createDataFrame([("'C:\\O''Brien\\[B.xlsx]S'!A1", "c:\\o'brien", "D:\\O'Neil$")], "f string, o string, n string")
    assert one.select(linktext.replace_in_formula(F.col("f"), F.col("o"), F.col("n"))).first()[0] == "'D:\\O''Neil$\\[B.xlsx]S'!A1"
    raw = spark.createDataFrame([("X:\\E'd\\a + 'X:\\E'", "x:\\e'd", "Y:\\q")], "f string, o string, n string")
    assert raw.select(linktext.replace_in_formula(F.col("f"), F.col("o"), F.col("n"))).first()[0] == "Y:\\q\\a + 'X:\\E'"


def test_texts(spark):
    one = spark.range(1)
    assert one.select(markup.markup_to_text(F.lit("<w:p><w:t>契約</w:t><w:t>書</w:t></w:p><w:p>a &amp;&#12354; &eacute;</w:p>"))).first()[0] == "契約書 a &あ é"
    assert one.select(snippets.snippet(F.lit("l1\nl2\nhit here\nl4\nl5"), "HIT")).first()[0] == "...l2 hit here l4..."
    assert one.select(formats.format_bytes(F.lit(1536)), formats.format_duration(F.lit(90061))).first()[:] == ("1.5 KB", "1d 1h 1m")
    docs = spark.createDataFrame([("a", "has ABC then BCD"), ("b", "has ABCD")], schemas.FILE_TEXT)
    index = text.trigram_index(docs)
    assert text.trigram_candidates(index, "ABCD").count() == 2
    assert [r[0] for r in text.trigram_search(index, docs, "abcd").collect()] == ["b"]
    raw = [("cp932", "日本語テスト".encode("cp932")), ("u8", "日本語".encode()), ("u16", "plain text here".encode("utf-16-le")), ("bom", b"\xff\xfe" + "é".encode("utf-16-le"))]
    decoded = column(text.decode_text(spark.createDataFrame(raw, schemas.FILE_CONTENT)), "text")
    assert decoded == {"cp932": "日本語テスト", "u8": "日本語", "u16": "plain text here", "bom": "é"}


def test_media(spark):
    mb = 1024 * 1024
    rows = [("C:\\Data\\a.jpg", mb, ago(1), ago(1)), ("C:\\Data\\_Master\\b.jpg", mb, ago(1), ago(1)), ("C:\\Data\\c.mov", mb, ago(1), ago(1)), ("C:\\Data\\d.psd", 1, ago(1), ago(1))]
    got = column(media.classify(listing(spark, rows)), "status", "name")
    assert got == {"b.jpg": "Protected (Protected folder name)", "c.mov": "Large video", "d.psd": "Protected (Master extension)"}
