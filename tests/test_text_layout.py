"""Texts in buckets, postings and keyword automata: only candidate files are read, no text enters an exchange."""

from __future__ import annotations

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from filetide import schemas
from filetide.operators import search, text
from filetide.operators.search import SearchSpec
from filetide.sources.textstore import TextStore, bucket_of

from .helpers import ago, listing

GB = 1024**3


def corpus(n: int) -> list[tuple[str, str]]:
    draw = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(f"c:/data/d{i % 7}/f{i:03d}.txt", " ".join(draw.choice(words) for _ in range(30))) for i in range(n)]
    rows[17] = (rows[17][0], rows[17][1] + "\nan Unmistakable line\nend")
    rows[23] = (rows[23][0], "unmist akable " + rows[23][1])  # shares trigrams, not the word
    return rows


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    texts = spark.createDataFrame(corpus(120), schemas.FILE_TEXT)
    store = TextStore(spark, f"{folder}/texts", 32).write(texts)
    text.write_trigram_index(text.trigram_index(texts), f"{folder}/index", partitions=4)
    return texts, store, spark.read.schema("path_key string, trigram string").parquet(f"{folder}/index")


def files_read(df, store) -> int:
    """Text files the scans of ``df`` opened, by the metric of the executed plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        leaves = again._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return sum(s.metrics().apply("numFiles").value() for s in scans if store.folder in s.toString() and s.metrics().contains("numFiles"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def exchanged(df) -> list[str]:
    """Columns that enter an exchange of the plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    blocks = re.split(r"\n\n+", out.getvalue())
    return [c.split("#")[0].strip() for b in blocks if re.match(r"\(\d+\) \w*Exchange", b) for line in b.split("\n") if line.startswith("Input") for c in line.split(": [")[1].rstrip("]").split(",")]


def test_store_keeps_all_rows(placed):
    texts, store, _ = placed
    assert sorted(store.all().collect()) == sorted(texts.collect())
    some = texts.where(F.col("path_key").endswith("005.txt"))
    assert files_read(store.of(some), store) == 1 and files_read(store.all(), store) > 16


def test_indexed_search_reads_candidate_files_only(placed):
    texts, store, index = placed
    found = text.trigram_search(index, store, "UNMISTAKABLE")
    assert files_read(found, store) == 1 and [r[0] for r in found.collect()] == [corpus(120)[17][0]]
    assert "text" not in exchanged(found)
    assert sorted(text.trigram_search(index, store, "alpha").collect()) == sorted(texts.where(F.contains("text", F.lit("alpha"))).select("path_key").collect())
    assert text.trigram_search(index, store, "al").count() == texts.where(F.contains("text", F.lit("al"))).count() and text.trigram_search(index, store, "nowhere to be").collect() == []


def entries(spark):
    return listing(spark, [("C:" + k[2:].replace("/", "\\").replace("data", "Data"), 2_000 if i < 60 else 10, ago(i), ago(i)) for i, (k, _) in enumerate(corpus(120))])


def test_content_search_looks_at_metadata_first(spark, placed):
    texts, store, index = placed
    spec = SearchSpec(keyword_groups=[["unmistakable", "nosuchword"]], content_mode=True)
    whole = search.content_hits(entries(spark), texts, spec).select("path_key", "reason", "snippet").collect()
    assert len(whole) == 1 and "an Unmistakable line" in whole[0]["snippet"]
    indexed = search.content_hits(entries(spark), store, spec, index)
    assert indexed.select("path_key", "reason", "snippet").collect() == whole
    assert files_read(indexed, store) == 1 and "text" not in exchanged(indexed)
    one = SearchSpec(keyword_groups=[["alpha"]], path_contains=["f003"], content_mode=True)
    filtered = search.content_hits(entries(spark), store, one)
    assert files_read(filtered, store) == 1 and filtered.count() == 1
    mixed = SearchSpec(keyword_groups=[["f01", "alpha"], ["omega"]], content_mode=True, min_size=100)
    rows = [sorted(map(str, search.content_hits(entries(spark), t, mixed, i).select("path_key", "reason", "snippet").collect())) for t, i in ((texts, None), (store, None), (store, index))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 20


@pytest.mark.parametrize("shard", [3, 50_000])
def test_keyword_automata_in_shards(spark, shard):
    docs = spark.createDataFrame([*corpus(40), ("empty", ""), ("none", None), ("odd", "İSTANBUL straße ÉTÉ aaa")], schemas.FILE_TEXT)
    words = ["alpha", "lph", "a", "ta o", "UNMISTAKABLE", "straße", "été", "aa", "absent", "", "mega", "omega", "i̇stanbul"]
    keywords = spark.createDataFrame([(i % 4, w) for i, w in enumerate(words)] + [(9, "Alpha"), (2, "alpha"), (2, "alpha")], "group_id int, keyword string")
    found = text.match_keyword_table(docs, keywords, shard=shard)
    plain = docs.join(keywords.select("group_id", F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct(), F.contains(F.lower("text"), F.col("keyword"))).select("path_key", "group_id", "keyword")
    assert sorted(found.collect()) == sorted(plain.collect())
    assert not {"text", "_text"} & set(exchanged(found))
    assert text.match_keyword_table(docs, keywords.limit(0)).collect() == []


def test_decoding_by_expressions(spark):
    """Only what is not plain UTF-8 reaches Python; broken and empty contents have defined texts."""
    raw = [
        ("u8", "zß水🍌".encode()), ("u8bom", b"\xef\xbb\xbf" + "é".encode()), ("ascii", b"plain"), ("empty", b""), ("null", None), ("bom only", b"\xef\xbb\xbf"),
        ("le", b"\xff\xfe" + "é水".encode("utf-16-le")), ("be", b"\xfe\xff" + "é水".encode("utf-16-be")), ("unmarked", "plain text".encode("utf-16-le")),
        ("cp932", "日本語".encode("cp932")), ("one null", b"a" * 40 + b"\x00"), ("odd", b"\xff\xfea"), ("lone", b"\xff\xfe\x00\xd8"), ("broken bom", b"\xef\xbb\xbf\xff"),
    ]
    got = {r["path_key"]: r["text"] for r in text.decode_text(spark.createDataFrame(raw, schemas.FILE_CONTENT)).collect()}
    assert got == {k: None if v is None else text._decode(v) for k, v in raw}
    assert got["unmarked"] == "plain text" and got["cp932"] == "日本語" and got["one null"] == "a" * 40 + "\x00"


def test_buckets_do_not_depend_on_the_folder(spark):
    keys = spark.range(4_000).select(F.concat(F.lit("c:/one/folder/"), F.col("id").cast("string")).alias("k"))
    sizes = [r["count"] for r in keys.groupBy(bucket_of("k", 16)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes)
    with pytest.raises(ValueError):
        TextStore(spark, "x", 0)
