"""Approximate nearest neighbours by inner product with an adaptive dimension scan (operator 8).

Index: centroids are fitted by k-means on a bounded sample of unit vectors
(``SAMPLE``); every vector is then assigned to its nearest list. Vectors are
turned by one random rotation and kept in column blocks of ``STEP`` dimensions.
A query probes the lists whose centroids score highest, as many as find
``RECALL`` of the sample's own neighbours.

Scan: within a list candidates are scored block by block. After ``d`` of ``D``
dimensions the partial product, scaled by ``D / d``, estimates the whole one,
with a standard error of ``|q| |x| sqrt((1 / d) (1 - d / D))`` under a random
rotation. A candidate whose estimate plus ``Z`` errors stays below the query's
bar is abandoned; the bar is the 21st best score among the sample, which the
20th best of all candidates reaches for certain. Survivors are scored in double precision on the
original vectors.

A list is cut into parts of at most ``PART`` vectors, so one vector repeated in a
third of the table makes many tasks. Each part returns a query's best ``k``.

Defined results: vectors that are null, zero or hold null or non-finite values
(or another number of dimensions than most have) take no part; ties go to the
smaller ``vec_id``; rows with a null ``vec_id`` take no part; with fewer
candidates than ``k`` all are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SAMPLE = 20_000  # vectors the centroids are fitted on
LISTS = 256  # at most; fewer for small tables
RECALL = 0.97  # aimed at when the number of probed lists is set on the sample
DENSE = 0.1  # below this share of pairs alive, pairs are scored one by one
PART = 4_096
QUERIES = 1_024  # queries that meet a part in one task
STEP = 16
Z = 2.6
K = 20
SEED = 11


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, v array<double>)`` of the vectors that take part, and their dimension."""
    rows = cleaned(vectors)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 0
    return rows.where(F.size("v") == d), d


def cleaned(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def fit(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Spherical k-means centroids."""
    draw = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = unit[draw.choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """Lists a query must probe so that the sample's own nearest neighbours are found as often as asked."""
    unit_lists = (sample @ centroids.T).argmax(axis=1)
    asked = sample[:: max(1, len(sample) // 512)]
    scores = asked @ sample.T
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    near = np.argpartition(-scores, k, axis=1)[:, : k + 1]  # the query itself is among them and costs one probe
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(np.take_along_axis(rank, unit_lists[near], axis=1), axis=None)
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1


def scan(queries: np.ndarray, bars: np.ndarray, ids_q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, z: float = Z):
    """Best ``k`` of a part for each query as arrays (query, candidate, score); ``bars`` are scores the 20th best reaches for certain."""
    d = vectors.shape[1]
    q_turned, turned = queries @ turn, vectors @ turn
    scale = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
    alive = ids_q[:, None] != ids[None, :]
    partial = np.zeros(alive.shape)
    rows = columns = None  # set once few pairs are left: from then on only those are scored
    for a in range(0, d, STEP):
        b = min(d, a + STEP)
        spread = z * np.sqrt((d - b) / (d * b))
        if rows is None:
            partial += q_turned[:, a:b] @ turned[:, a:b].T
            alive &= partial * (d / b) + spread * scale >= bars[:, None]
            if alive.mean() < DENSE:
                rows, columns = np.nonzero(alive)
                partial, scale = partial[rows, columns], scale[rows, columns]
        else:
            partial = partial + np.einsum("ij,ij->i", q_turned[rows, a:b], turned[columns, a:b])
            keep = partial * (d / b) + spread * scale >= bars[rows]
            rows, columns, partial, scale = rows[keep], columns[keep], partial[keep], scale[keep]
    if rows is None:
        rows, columns = np.nonzero(alive)
    exact = np.einsum("ij,ij->i", queries[rows], vectors[columns])
    order = np.lexsort((ids[columns], -exact, rows))
    rows, columns, exact = rows[order], columns[order], exact[order]
    start = np.searchsorted(rows, rows, "left")
    first = np.arange(len(rows)) - start < k
    return ids_q[rows[first]], ids[columns[first]], exact[first]


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL, sample_rows: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``queries`` has rows of the same kind as ``vectors``."""
    spark = vectors.sparkSession
    rows, d = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], schema)
    asked = cleaned(queries).where(F.size("v") == d).dropDuplicates(["vec_id"])
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, sample_rows / n) * (1 << 20)) + 1).select("v").limit(2 * sample_rows)
    sample = np.array([r["v"] for r in chosen.collect()], float).reshape(-1, d)  # the documented sample
    if not len(sample):
        sample = np.array([r["v"] for r in rows.select("v").limit(1).collect()], float)
    lists = max(1, min(LISTS, int(len(sample) ** 0.5), len(np.unique(sample, axis=0))))
    centroids, turn = fit(sample, lists), rotation(d)
    probes = probes_needed(sample, centroids, k, recall)

    def assign(batches):
        for batch in batches:
            v = np.array(batch["v"].tolist()).reshape(-1, d)
            yield batch.assign(list=(v @ centroids.T).argmax(axis=1))

    def probe(batches):
        for batch in batches:
            v = np.array(batch["v"].tolist()).reshape(-1, d)
            order = np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :probes]
            scores = np.sort(v @ sample.T, axis=1)
            bar = scores[:, -(k + 1)] - 1e-9 if len(sample) > k else np.full(len(v), -np.inf)
            yield batch.assign(list=order.tolist(), bar=bar)

    index = stored(rows.mapInPandas(assign, "vec_id long, v array<double>, list int"), "lists")
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # at most LISTS rows
    index = index.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    index = stored(index.select("vec_id", "v", "list", "part"), "parts")
    wanted = stored(asked.mapInPandas(probe, "vec_id long, v array<double>, list array<int>, bar double"), "probes")
    keys = ["list", "part", "turn"]

    def search(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        q, v = (np.array(x["v"].tolist(), float).reshape(-1, d) for x in (one, two))
        found = scan(q, one["bar"].to_numpy(float), one["vec_id"].to_numpy("int64"), v, two["vec_id"].to_numpy("int64"), turn, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    def nearest(wanted: DataFrame) -> DataFrame:
        groups = max(1, -(-wanted.count() // QUERIES))
        asks = wanted.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("list", F.explode("list"))
        asks = asks.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        pairs = asks.select(*keys, "vec_id", "v", "bar").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return stored(ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")

    found = nearest(wanted)
    # Queries that found fewer than k look through every list, without a bar.
    served = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k).select("vec_id")
    short = wanted.join(served, "vec_id", "left_anti").withColumns({"list": F.array(*[F.lit(i) for i in range(lists)]), "bar": F.lit(float("-inf"))})
    if short.isEmpty():
        return found
    again = nearest(stored(short, "short"))
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))
