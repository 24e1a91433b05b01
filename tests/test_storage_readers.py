"""Reading storage Spark can reach: listing without contents, contents by key, and an order that has no query."""

from __future__ import annotations

from pyspark.sql import functions as F

from filetide.functions import paths
from filetide.operators import audit, dedupe
from filetide.sources import inventory


def test_storage_is_listed_and_read(spark, tmp_path):
    root = tmp_path / "Store"
    files = {"a.txt": b"alpha", "Sub/b.BIN": b"\x00\x01" * 50, "Sub/deep er/c": b"", "Sub/deep er/d": b"d", "Sub/skip.tmp": b"no"}
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    del files["Sub/deep er/c"]  # the reader leaves empty files out, as its docstring says
    entries = inventory.read_storage(spark, str(root), "s1")
    key = lambda name: f"{root}/{name}".lower()
    found = {r["path_key"]: (r["name"], r["size"], r["ext"], r["is_dir"], r["root_key"]) for r in entries.where("not is_dir").collect()}
    assert found == {key(n): (n.split("/")[-1], len(b), "." + n.split(".")[-1].lower() if "." in n else "", False, str(root).lower()) for n, b in files.items()}
    assert {r["name"] for r in inventory.read_storage(spark, str(root), "s1", "*.txt").where("not is_dir").collect()} == {"a.txt"}
    content = {r["path_key"]: bytes(r["content"]) for r in inventory.read_content(spark, str(root)).collect()}
    assert content == {key(n): b for n, b in files.items()}
    hashed = dedupe.hashed(entries.where("not is_dir"), inventory.read_content(spark, str(root)), F.sha2("content", 256))
    assert hashed.where("hash is null").count() == 0
    assert spark.range(1).select(paths.path_key(F.lit(str(root)))).first()[0] == str(root).lower()


def test_order_by_detail(spark):
    rows = [("k1", "Beta", 1, True), ("k2", "alpha", 2, False), ("k3", "beta", 1, False), ("k4", None, 3, True), ("k5", "alpha", 2, True)]
    frame = spark.createDataFrame(rows, "path_key string, detail string, group_index int, is_original boolean").withColumn("name", F.col("path_key")).withColumn("size", F.lit(1).cast("long"))
    order = lambda descending: [r["path_key"] for r in audit.sort(frame, "Detail", descending).collect()]
    assert order(False) == ["k4", "k5", "k2", "k1", "k3"] and order(True) == ["k1", "k3", "k5", "k2", "k4"]
