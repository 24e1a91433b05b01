"""Benchmark decontamination by MinHash containment search (operator 3).

An item's set is its distinct shingles of ``WIDTH`` words. Items are partitioned
by the size of their set (powers of two). An item keeps, as its MinHash sketch,
the shingles with the smallest hashes; a partition whose largest set has ``u``
shingles keeps ``floor((1 - t) u) + 1`` of them. A document that contains the
share ``t`` of an item misses at most ``floor((1 - t) n)`` of its ``n`` shingles,
so it holds at least the rest of the sketch: no contained item is missed, however
long the document. Pairs that pass are verified on the exact shingles, as texts.

Items with equal words are searched once. Defined results: an item without words
is in no document; an item with fewer than ``WIDTH`` words is one shingle of that
many words; a null or empty text contains nothing; documents equal in ``doc_id``
and text give the same pairs once; a null ``doc_id`` or ``item_id`` is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, stored, table, word_array

WIDTH = 5
CONTAINMENT = 0.75
BROADCAST_ROWS = 2_000_000  # sketch rows of 40 bytes: at most 80 MB in a broadcast, beyond that a shuffled join


def _starts(words: Column, width: int) -> Column:
    """Places at which a shingle begins; none in fewer words than it has."""
    n = F.size(words) - width + 1
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, width: int) -> Column:
    def windows(hashed: Column) -> Column:
        return F.transform(_starts(hashed, width), lambda i: F.xxhash64(F.slice(hashed, i, width)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def shingle_texts(words: Column, width: int) -> Column:
    def windows(read: Column) -> Column:
        return F.transform(_starts(read, width), lambda i: F.concat_ws(" ", F.slice(read, i, width)))

    return let(words, windows)


def item_classes(items: DataFrame) -> DataFrame:
    """Items with equal words as one class: ``(class, words, width, members)``."""
    worded = items.select("item_id", word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    return worded.groupBy("words").agg(F.collect_set(F.struct("item_id")).alias("members")).select(
        F.xxhash64("words").alias("class"), "words", F.least(F.lit(WIDTH), F.size("words")).alias("width"), "members"
    )


def containments(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, body, class, n_shingles, n_shared)`` of all documents that contain a class of items, and the classes."""
    classes = stored(item_classes(items), "items")
    widths = [r["width"] for r in classes.select("width").distinct().orderBy("width").collect()]  # at most WIDTH values
    bodies = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("body"), word_array(F.col("text")).alias("words"))
    found = [_contained(bodies, classes.where(F.col("width") == w), w, threshold) for w in widths]
    pairs = found[0] if found else None
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    if pairs is None:
        empty = "doc_id bigint, body bigint, class bigint, n_shingles int, n_shared bigint"
        return docs.sparkSession.createDataFrame([], empty), classes
    return pairs, classes


def _contained(bodies: DataFrame, classes: DataFrame, width: int, t: float) -> DataFrame:
    hashed = classes.select("class", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), width))).alias("all"))
    n = F.size("all")
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1  # of the item's size partition
    kept = F.least(n, F.floor(F.lit(1 - t) * largest + F.lit(1e-9)).cast("int") + 1)
    need = F.greatest(F.lit(1), kept - F.floor(F.lit(1 - t) * n + F.lit(1e-9)).cast("int"))
    sketch = stored(hashed.select("class", need.alias("need"), F.explode(F.slice("all", F.lit(1), kept)).alias("shingle")), "sketch")
    probe = F.broadcast(sketch) if sketch.count() <= BROADCAST_ROWS else sketch
    long_enough = bodies.where(F.size("words") >= width)
    shingles = long_enough.select("doc_id", "body", F.explode(shingle_hashes(F.col("words"), width)).alias("shingle"))
    candidates = stored(
        shingles.join(probe, "shingle").groupBy("doc_id", "body", "class", "need").agg(F.count_distinct("shingle").alias("hits"))
        .where(F.col("hits") >= F.col("need")).select("doc_id", "body", "class"), "candidates",
    )
    exact = classes.select("class", F.array_distinct(shingle_texts(F.col("words"), width)).alias("all"))
    exact = exact.select("class", F.size("all").alias("n_shingles"), F.explode("all").alias("shingle"))
    ids = candidates.select(F.col("doc_id").alias("_d"), F.col("body").alias("_b")).distinct()
    read = long_enough.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body") == F.col("_b")), "left_semi")
    texts = read.select("doc_id", "body", F.explode(F.array_distinct(shingle_texts(F.col("words"), width))).alias("shingle"))
    shared = texts.join(exact, "shingle").groupBy("doc_id", "body", "class", "n_shingles").agg(F.count_distinct("shingle").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.lit(t) * F.col("n_shingles"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, classes = containments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    members = classes.select("class", F.explode("members.item_id").alias("item_id"))
    return pairs.join(members, "class").select(
        "doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, with the columns they came with."""
    key, body = fresh("key"), fresh("body")
    pairs, _ = containments(docs, table(spark, sf_dir, "benchmark"))
    leaked = stored(pairs.select(F.col("doc_id").alias(key), F.col("body").alias(body)).distinct(), "leaked")
    return docs.join(leaked, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(body)), "left_anti")


_SHINGLES = """
  SELECT {key}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM (SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w
        FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 5"""
# Given items all have five words or more.
ORACLE = f"""
WITH d AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key="doc_id", table="documents")})),
     b AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key="item_id", table="benchmark")})),
     n AS (SELECT item_id, COUNT(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, COUNT(*) AS n_shared, COUNT(*) / n_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING COUNT(*) >= 0.75 * n_shingles
"""
