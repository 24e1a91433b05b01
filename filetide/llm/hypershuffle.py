"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix (operator 6).

1. The rows are written once, each with the partition that wrote it and its
   place there, so everything later is a function of files, whoever is lost.
2. Shard sizes are fixed: counts at most one apart (law ``rows``).
3. How many rows of each partition go to each shard is drawn exactly: the matrix
   has the partition sizes as row sums and the shard sizes as column sums and is
   multivariate hypergeometric, row by row. It has partitions times shards
   entries and is the only thing on the driver.
4. Each partition is permuted (rows in order of a keyed hash) and cut by its row
   of the matrix; rows move to their shards; each shard is permuted again by a
   second keyed hash. A shard is cut into ranges of that hash so that no task
   holds a whole shard; range sizes, summed, give gapless slots.

The result is a uniform shuffle up to the quality of the hash. Defined results:
null texts count no bytes; equal rows take part one by one; an empty table gives
an empty result; extra columns are carried through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 24
SEED = 20_240_601
RANGE_ROWS = 50_000  # rows of a shard permuted in one task
SUBPARTS = 64  # a partition is permuted in so many ranges of its keyed hash at most


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts from each partition (row) to each shard (column), drawn exactly."""
    total = sum(sizes)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    draw = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(sizes), shards), np.int64)
    for p, size in enumerate(sizes):
        for s in range(shards):  # conditional draws: works beyond the limit of the joint sampler
            rest = int(left[s + 1 :].sum())
            if size == 0:
                break
            out[p, s] = size if rest == 0 else _hypergeometric(draw, int(left[s]), rest, size)
            size -= int(out[p, s])
        left -= out[p]
    return out


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """numpy's sampler below its limit of 10^9; above, inversion of the distribution around its mean.

    The probabilities follow from their ratios, over 12 standard deviations to
    either side; what lies beyond weighs less than 10^-30.
    """
    whole = good + bad
    if whole < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, sample)) if good else 0
    mean = sample * (good / whole)
    wide = 12 * (mean * (bad / whole) * ((whole - sample) / (whole - 1))) ** 0.5 + 2
    low, high = max(0, sample - bad, int(mean - wide)), min(good, sample, int(mean + wide))
    k = np.arange(low, high, dtype=float)
    ratios = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(ratios)])
    total = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(total, draw.random() * total[-1]))


def _order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _numbered(rows: DataFrame, keys: list[str], order: Column, ranges: Column, most: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within ``keys`` in the order of a uniform 64-bit hash, cut into ``ranges`` ranges of it."""
    rows = rows.withColumn("_h", order)
    # Upper 32 bits as a fraction of the whole: the range is monotone in the hash.
    rows = rows.withColumn("_r", F.floor((F.shiftright("_h", 32) + (1 << 31)) * ranges / (1 << 32)).cast("int"))
    counts = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_r").orderBy("_h", "_part", "_at")
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*keys, "_r"]).withColumn(out, F.col("_o") + F.col("_i")).drop("_h", "_r", "_i", "_o")


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long)."""
    names = rows.columns
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")) if names else rows
    base = stored(packed.select("row", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "rows")
    sizes = {r["_part"]: r["n"] for r in base.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one number per partition
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    ends = np.cumsum(matrix, axis=1)
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(p, sizes[p], [int(x) for x in e]) for p, e in zip(parts, ends)], "_part int, _size long, _ends array<long>")
    per_range = F.greatest(F.lit(1), F.least(F.lit(SUBPARTS), F.ceil(F.col("_size") / RANGE_ROWS)))
    # One row of the matrix per partition: partitions times shards numbers, however many rows there are.
    local = _numbered(base.join(F.broadcast(cuts), "_part"), ["_part"], _order(seed + 1, "_part", "_at"), per_range, RANGE_ROWS, "_rank")
    dealt = local.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int")).select("row", "_part", "_at", "shard")
    total = sum(sizes.values())
    ranges = F.lit(max(1, -(-total // (shards * RANGE_ROWS)), min(16, total // (shards * 64) + 1)))
    placed = _numbered(dealt, ["shard"], _order(seed + 2, "_part", "_at"), ranges, RANGE_ROWS, "slot")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in names if c not in ("shard", "slot")], "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the rows of each shard below ``shard=<n>``, files and rows in slot order."""
    placed = shuffled(rows, shards, seed)
    piece = F.floor(F.col("slot") / RANGE_ROWS)
    placed.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shuffled(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
