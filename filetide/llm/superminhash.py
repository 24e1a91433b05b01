"""Near-duplicate groups by SuperMinHash (operator 7).

Documents with equal shingle sets form one class; everything below works on
classes, so a text copied a thousand times costs one signature.

1. ``SuperMinHash``: each shingle walks a random permutation of the ``SLOTS``
   signature places; at step ``j`` it offers ``j + r`` to the place it has
   reached, and a place keeps the least offer. Steps are taken by all shingles
   of a text together and end as soon as no place can still get less.
2. Banding: ``BANDS`` bands of ``ROWS`` places; classes that agree on a band
   share a bucket.
3. Verification on full sets, so that a bucket of thousands emits no square of
   pairs: first each member with the bucket's centre (the class with most
   copies). Where a bucket still spans several components, its members meet in
   tasks of two blocks each. A pair of different components, in the first band it
   shares, whose signatures agree on at least ``LIKELY`` of the places, is
   verified there on the full sets, and a task reports only links that join
   components. Links inside a component change nothing, so none is lost for the
   groups.
4. Union-find: the smallest class number spreads along verified links.

A pair at the threshold shares a band with probability 1 - (1 - 0.75^4)^32, that
is all but 5 in a million, and ``LIKELY`` lies over four standard errors below it.

Defined results: a null, empty or blank text has no shingle, links with nothing
and is kept; a text of fewer than five words is one shingle; rows equal in
``doc_id`` and text are one document, so both or neither stay; different texts
under one ``doc_id`` are grouped each by its own text; a row with a null
``doc_id`` is its own component (null) and kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, mixed, shingle_hashes, slices, stored, table, utf8

WIDTH = 5
SLOTS = 128
ROWS = 4
BANDS = SLOTS // ROWS
LIKELY = 0.60
BLOCK = 1024  # members of a bucket compared in one task at a time
BYTES = 16 << 20  # of their sets
_STEP = np.uint64(0x9E3779B97F4A7C15)


def similar_enough(shared: np.ndarray, union: np.ndarray) -> np.ndarray:
    return 100 * shared >= 75 * union


def signatures(hashes: np.ndarray, borders: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values of sets laid end to end: one row of ``slots`` 32-bit values per set."""
    n = len(borders) - 1
    least = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(borders)
    owner = np.repeat(np.arange(n), sizes)
    walking = np.arange(len(hashes))
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(hashes), 1))
    for j in range(slots):
        if not len(walking):
            break
        seed = mixed(hashes[walking] + np.uint64(int(_STEP) * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        reach = (j + (seed >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        rows = np.arange(len(walking)) if len(walking) == len(order) else walking
        place = order[rows, reach]
        order[rows, reach] = order[rows, j]
        order[rows, j] = place
        offer = (np.uint64(j) << np.uint64(32)) | (seed & np.uint64(0xFFFFFFFF))
        np.minimum.at(least.ravel(), owner[walking] * slots + place, offer)
        # A set is done once every place holds an offer of this step or an earlier one.
        open_sets = (least[:, :] >> np.uint64(32)).max(axis=1) > j
        walking = walking[open_sets[owner[walking]]]
    return (mixed(least) >> np.uint64(32)).astype(np.uint32)


def _sets(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    sizes = np.diff(utf8(batch.column(column))[1])
    for part in slices(batch, sizes, limit):
        data, offsets = utf8(part.column(column))
        yield part, *shingle_hashes(data, offsets, WIDTH)


def _digests(hashes: np.ndarray, borders: np.ndarray) -> list[bytes | None]:
    """128 bits that name a set; null for an empty one."""
    one, two = mixed(hashes), mixed(hashes ^ _STEP)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (one, two)]
    parts = [mixed((s[borders[1:]] - s[borders[:-1]]) + np.diff(borders).astype(np.uint64)) for s in sums]
    return [a.tobytes() + b.tobytes() if k else None for a, b, k in zip(*parts, np.diff(borders))]


def set_names(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, n_shingles, name)``: a hash of the text, the size of its set and a 128-bit name of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, borders in _sets(batch, "text"):
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("body"), pa.array(np.diff(borders)), pa.array(_digests(hashes, borders), pa.binary())],
                    ["doc_id", "body", "n_shingles", "name"],
                )

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("body"), "text")
    return keyed.mapInArrow(work, "doc_id long, body long, n_shingles long, name binary")


def sketched(texts: DataFrame) -> DataFrame:
    """``(c, bands array<long>, signature binary, size)`` of the texts of ``(c, text)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, borders in _sets(batch, "text", 1 << 19):
                values = signatures(hashes, borders)
                bands = _bands(values)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                low = pa.array([v.tobytes() for v in values.astype(np.uint16)], pa.binary())
                yield pa.record_batch([part.column("c"), flat, low, pa.array(np.diff(borders))], ["c", "bands", "signature", "size"])

    return texts.select("c", "text").mapInArrow(work, "c long, bands array<long>, signature binary, size long")


def _bands(values: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS)).copy()
    for k in range(ROWS):
        h = mixed(h * _STEP + values[:, k::ROWS].astype(np.uint64))
    return h.astype(np.int64)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(c, comp)``: the smallest ``c`` reachable over ``links`` (columns ``a``, ``b``), by hooking and pointer jumping.

    Each round every root that has a link to a smaller root hooks onto it, then
    paths are halved; the tables in between are written to the shared folder.
    """
    parent = stored(nodes.select("c", F.col("c").alias("comp")), "parents")
    edges = links.select("a", "b").distinct()
    while True:
        left = parent.select(F.col("c").alias("a"), F.col("comp").alias("ra"))
        right = parent.select(F.col("c").alias("b"), F.col("comp").alias("rb"))
        edges = stored(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return parent
        hook = edges.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "comp")
        while True:  # shorten paths of hooks until each ends at a root
            onward = hook.select(F.col("comp").alias("to"), F.col("to").alias("next"))
            hook = stored(hook.join(onward, "to", "left").select("comp", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        parent = stored(parent.join(hook.drop("moved"), "comp", "left").select("c", F.coalesce("to", "comp").alias("comp")), "parents")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets are similar enough; sets are computed anew from ``(c, text)``.

    Pairs that share their first side travel together, so a centre's text is
    read once for up to ``BLOCK`` partners.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(1 << 30)))
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    pairs = pairs.join(per, "a").withColumn("part", F.col("part") % F.col("parts"))
    one = texts.select(F.col("c").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("c").alias("b"), F.col("text").alias("text_b"))
    heads = pairs.select("a", "part").distinct().join(one, "a").select("a", "part", F.lit(None).cast("long").alias("b"), F.col("text_a").alias("text"))
    rest = pairs.select("a", "part", "b").join(two, "b").select("a", "part", "b", F.col("text_b").alias("text"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        data, offsets = utf8(pa.array(frame["text"], pa.large_string()))
        hashes, borders = shingle_hashes(data, offsets, WIDTH)
        head = int(np.flatnonzero(frame["b"].isna().to_numpy())[0])
        sizes = np.diff(borders)
        inside = np.isin(hashes, hashes[borders[head] : borders[head + 1]])
        running = np.concatenate([[0], np.cumsum(inside)])
        shared = running[borders[1:]] - running[borders[:-1]]
        good = similar_enough(shared, sizes + sizes[head] - shared)
        good[head] = False
        return pd.DataFrame({"a": frame["a"][good], "b": frame["b"][good].astype("int64")})

    both = heads.unionByName(rest)
    return stored(both.groupBy("a", "part").applyInPandas(work, "a long, b long"), "verified")


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows of buckets that span several components, dealt into tasks.

    A bucket is cut into blocks of at most about ``BLOCK`` members and ``BYTES``
    of sets; every two blocks meet in one task, so each member is repeated once
    per block.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") * 8 / BYTES)).cast("int").alias("blocks")
    spans = rows.groupBy("bucket").agg(blocks, F.count_distinct("comp").alias("k")).where("k > 1").drop("k")
    rows = rows.join(spans, "bucket").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")


def _likely(frame: pd.DataFrame, joined: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Members of a task with their likely partners in other components, each pair in the first band it shares."""
    c, block, band = frame["c"].to_numpy(), frame["block"].to_numpy(), int(frame["band"].iloc[0])
    values = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(len(frame), SLOTS)
    split = frame["low"].iloc[0] != frame["high"].iloc[0]
    for i in range(len(frame)):
        apart = ~joined(i, c) & (c > c[i])
        if split:
            apart &= block != block[i]
        at = np.flatnonzero(apart)
        same = values[at] == values[i]
        take = same.sum(axis=1) >= LIKELY * SLOTS
        if band:
            take &= ~same[:, : band * ROWS].reshape(len(at), band, ROWS).all(axis=2).any(axis=1)
        if take.any():
            yield i, at[take]


def _with_partners(rows: DataFrame) -> DataFrame:
    """The rows of ``_blocked`` that have a likely partner in their task, as keys."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        comp, found = frame["comp"].to_numpy(), np.zeros(len(frame), bool)
        for i, at in _likely(frame, lambda i, c: comp == comp[i]):
            found[i] = True
            found[at] = True
        return frame.loc[found, ["bucket", "low", "high", "c"]]

    return rows.groupBy("bucket", "low", "high").applyInPandas(work, "bucket long, low int, high int, c long")


def _links(rows: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join components, found on the full sets in ``set``; in a task no two join the same ones."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        _, comp = np.unique(frame["comp"].to_numpy(), return_inverse=True)
        c, links = frame["c"].to_numpy(), []
        sets = [np.frombuffer(x, np.uint64) for x in frame["set"]]
        sizes = np.array([len(x) for x in sets])
        for i, at in _likely(frame, lambda i, _: comp == comp[i]):
            for a in range(0, len(at), 256):
                part = at[a : a + 256]
                part = part[comp[part] != comp[i]]
                if not len(part):
                    continue
                inside = np.isin(np.concatenate([sets[j] for j in part]), sets[i])
                borders = np.concatenate([[0], np.cumsum(sizes[part])])
                running = np.concatenate([[0], np.cumsum(inside)])
                shared = running[borders[1:]] - running[borders[:-1]]
                for j in part[similar_enough(shared, sizes[part] + sizes[i] - shared)]:
                    if comp[j] != comp[i]:
                        comp[comp == comp[j]] = comp[i]
                        links.append((c[i], c[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return rows.groupBy("bucket", "low", "high").applyInPandas(work, "a long, b long")


def full_sets(texts: DataFrame) -> DataFrame:
    """``(c, set binary)``: the sorted 64-bit shingle hashes of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, borders in _sets(batch, "text"):
                yield pa.record_batch([part.column("c"), pa.array([hashes[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])], pa.binary())], ["c", "set"])

    return texts.select("c", "text").mapInArrow(work, "c long, set binary")


def grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, n_shingles, component_id, kept)`` for every row of ``docs`` (``doc_id``, ``text``)."""
    names = stored(set_names(docs), "names")
    found = names.where(F.col("name").isNotNull() & F.col("doc_id").isNotNull())
    classes = found.groupBy("name").agg(F.min(F.struct("doc_id", "body")).alias("least"), F.count("*").alias("copies"))
    # A class is called by its smallest doc_id; where one doc_id names several texts, by a hash of its set.
    alone = F.count("*").over(Window.partitionBy("least.doc_id")) == 1
    classes = stored(classes.select("name", "copies", F.col("least.doc_id").alias("doc"), F.col("least.body").alias("body"), F.when(alone, F.col("least.doc_id")).otherwise(F.xxhash64("name")).alias("c")), "classes")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), "text")
    texts = keyed.join(classes.select("doc", "body", "c"), ["doc", "body"]).select("c", "text")
    sketches = stored(sketched(texts).dropDuplicates(["c"]), "sketches")
    banded = sketches.select("c", F.posexplode("bands").alias("band", "bucket"))
    centre = F.max(F.struct("copies", (-F.col("c")).alias("minus")))
    buckets = banded.join(classes.select("c", "copies"), "c").groupBy("bucket").agg((-centre["minus"]).alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(buckets, "bucket"), "members")
    nodes = members.select("c").distinct()
    near_texts = stored(texts.join(nodes, "c", "left_semi").dropDuplicates(["c"]), "near-texts")
    star = members.where("c <> centre").select(F.col("centre").alias("a"), F.col("c").alias("b")).distinct()
    comps = components(nodes, verified(star, near_texts))
    # A bucket of two is settled by its star.
    crowded = members.where("n > 2").select("bucket", "band", "c").join(sketches.select("c", "signature", "size"), "c")
    rows = stored(_blocked(crowded.join(comps, "c")), "open")
    keys = ["bucket", "low", "high", "c"]
    paired = stored(_with_partners(rows), "paired")
    sets = full_sets(near_texts.join(paired.select("c").distinct(), "c", "left_semi"))
    links = _between(stored(_links(rows.join(paired, keys, "left_semi").join(sets, "c")), "links"), comps)
    roots = components(comps.select(F.col("comp").alias("c")).distinct(), links).select(F.col("c").alias("comp"), F.col("comp").alias("root"))
    comps = comps.join(roots, "comp").select("c", F.col("root").alias("comp"))
    placed = classes.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = placed.groupBy("comp").agg(F.min("doc").alias("component_id"))
    placed = placed.join(least, "comp").select("name", "component_id")
    rows = names.withColumn("named", F.when(F.col("doc_id").isNotNull(), F.col("name")))
    out = rows.join(placed.withColumnRenamed("name", "named"), "named", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "body", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def _between(links: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between classes as links between their components."""
    a, b = comps.select(F.col("c").alias("a"), F.col("comp").alias("ra")), comps.select(F.col("c").alias("b"), F.col("comp").alias("rb"))
    return links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("body")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest ``doc_id``, with the columns it came with."""
    key, body = fresh("key"), fresh("body")
    gone = stored(grouped(docs.select("doc_id", "text")).where("NOT kept").select(F.col("doc_id").alias(key), F.col("body").alias(body)).distinct(), "copies")
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(key)) & (F.xxhash64(docs["text"]) == F.col(body)), "left_anti")
