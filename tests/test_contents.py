"""Duplicate stages over bucketed contents: same result, contents neither moved nor read more than twice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from filetide import schemas
from filetide.operators import dedupe

from .helpers import ago, listing
from .test_text_layout import exchanged


def estate(spark):
    """Files that share their size: equal, different in the middle, at the end, in the first bytes, and unreadable."""
    draw = random.Random(5)
    base = bytes(draw.randrange(256) for _ in range(20_000))
    bodies = [base] * 4 + [base[:9_000] + b"x" + base[9_001:]] * 2 + [base[:-1] + b"\x00"] * 3 + [b"y" + base[1:]] + [base[:500]] * 5 + [base[1:501]] + [b"z" * 1_500_000] * 2 + [b"z" * 1_200_000 + b"q" * 300_000]
    rows = [(f"C:\\Data\\f{i:02d}.bin", len(b), ago(i), ago(i)) for i, b in enumerate(bodies)] + [("C:\\Data\\gone.bin", 20_000, ago(1), ago(1))]
    content = spark.createDataFrame([(f"c:/data/f{i:02d}.bin", b) for i, b in enumerate(bodies)], schemas.FILE_CONTENT)
    return listing(spark, rows), content


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    entries, content = estate(spark)
    return entries, content, dedupe.BucketedContents(spark, "contents_test").write(content, str(tmp_path_factory.mktemp("contents") / "c"), 8)


def test_bucketed_equals_plain(bucketed):
    entries, content, table = bucketed
    candidates = dedupe.size_groups(entries, 1)
    for options in ({"sample_from": 512, "prefix_from": 10_000}, {"sample_from": 512, "prefix_from": 1_000_000}, {"network": True}, {}):
        results = [sorted(dedupe.confirmed(candidates, c, **options).select("path_key", "size", "sha256").collect()) for c in (content, table)]
        assert results[0] == results[1] and len(results[0]) == 4 + 2 + 3 + 5 + 2
    left = dedupe.sampled(candidates, table, sample_from=512, prefix_from=10_000)
    assert left.where("size = 1500000").count() == 2  # the one with another tail is out
    assert left.where("size = 20000").count() == 11  # one of them cannot be read, so all stay


def test_contents_stay_in_their_buckets(spark, bucketed):
    entries, _, table = bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = entries.select("path_key").distinct()
        sums = table.of(keys).select("path_key", F.sha2("content", 256).alias("h"))
        assert exchanged(sums) and "content" not in exchanged(sums)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_contents_are_read_twice(bucketed, monkeypatch):
    entries, content, _ = bucketed
    reads, original = [], dedupe.hashes
    monkeypatch.setattr(dedupe, "hashes", lambda wanted, source, hows: reads.append(sorted(hows)) or original(wanted, source, hows))
    dedupe.confirmed(dedupe.size_groups(entries, 1), content, sample_from=512, prefix_from=10_000).count()
    assert reads == [["hash", "start"], ["hash"]]
