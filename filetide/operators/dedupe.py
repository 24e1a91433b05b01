"""Exact duplicates: size, then samples, then full hashes, each stage reading less than the last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import paths as P
from ..session import cut_lineage
from .hygiene import factors, reason_rows
from .skew import attach, number_rows
from .tree import TREE

# Fixed values.
MIN_SIZE = 100 * 1024
CHUNK = 4096
LOCAL_SAMPLE, NETWORK_SAMPLE = 64 * 1024, 1024 * 1024
PREFIX_FROM, PREFIX = 32 * 1024 * 1024, 1024 * 1024
SCORE_DUPLICATE = 95


def size_groups(entries: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Files of at least ``min_size`` bytes that share their size with another file."""
    files = entries.where(~F.col("is_dir") & (F.col("size") >= min_size))
    sizes = files.groupBy(*TREE, "size").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return attach(files, sizes, [*TREE, "size"], group_rows="_n")


def head_tail(content: Column) -> Column:
    """Hash of the first and last 4 KiB, overlapping nothing."""
    tail = F.least(F.octet_length(content) - CHUNK, F.lit(CHUNK))
    sample = F.when(tail > 0, F.concat(F.substring(content, F.lit(1), F.lit(CHUNK)), F.substring(content, -tail, tail)))
    return F.sha2(F.coalesce(sample, content), 256)


def prefix(content: Column) -> Column:
    """Hash of the first MiB; null when the file is shorter than that."""
    return F.when(F.octet_length(content) >= PREFIX, F.sha2(F.substring(content, F.lit(1), F.lit(PREFIX)), 256))


@dataclass(frozen=True)
class BucketedContents:
    """``(path_key, content)`` as a table bucketed and sorted by ``path_key``.

    A join on the key meets it bucket by bucket: the narrow side is dealt to the
    buckets, contents stay where they lie.
    """

    spark: SparkSession
    table: str

    def write(self, content: DataFrame, folder: str, buckets: int) -> BucketedContents:
        placed = content.select("path_key", "content").repartition(buckets, "path_key")
        placed.write.bucketBy(buckets, "path_key").sortBy("path_key").mode("overwrite").option("path", folder).saveAsTable(self.table)
        return self

    def of(self, keys: DataFrame) -> DataFrame:
        return self.spark.table(self.table).join(keys, "path_key")


def hashes(wanted: DataFrame, content: DataFrame | BucketedContents, hows: dict[str, Column]) -> DataFrame:
    """``wanted`` rows with hashes of their content, one column for each of ``hows``; null when missing or of another length.

    Contents are never shuffled, and read once whatever the number of hashes. Of
    ``BucketedContents`` those of the wanted keys are hashed; a plain table is hashed
    where it is read, and only hashes travel. The result is written to the shared
    folder, so no later stage hashes again.
    """
    source = content.of(wanted.select("path_key").distinct()) if isinstance(content, BucketedContents) else content
    sums = source.select("path_key", *[how.alias(f"_{name}") for name, how in hows.items()], F.octet_length("content").cast("long").alias("_read"))
    joined = wanted.join(sums, "path_key", "left")
    same = F.col("_read") == F.col("size")
    return cut_lineage(joined.select(*[c for c in wanted.columns if c not in hows], *[F.when(same, F.col(f"_{name}")).alias(name) for name in hows]))


def hashed(wanted: DataFrame, content: DataFrame | BucketedContents, how: Column) -> DataFrame:
    return hashes(wanted, content, {"hash": how})


def narrow(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keep rows whose hash recurs in their group; a group with a failed hash is kept whole.

    Rows of a kept-whole group get the hash ``unknown`` like their failed member.
    """
    marked = rows.withColumn("hash", F.coalesce("hash", F.lit("unknown")))
    per_hash = marked.groupBy(*keys, "hash").agg(F.count("*").alias("_n"))
    failed = per_hash.where(F.col("hash") == "unknown").select(*keys, F.lit(True).alias("_failed"))
    kept = per_hash.join(failed, keys, "left").where((F.col("_n") > 1) | F.col("_failed"))
    joined = attach(marked, kept, [*keys, "hash"], group_rows="_n")
    return joined.withColumn("hash", F.when(F.col("_failed"), "unknown").otherwise(F.col("hash"))).drop("_failed")


def sampled(
    candidates: DataFrame, content: DataFrame | BucketedContents, *, network: bool = False,
    sample_from: int | None = None, prefix_from: int = PREFIX_FROM,
) -> DataFrame:
    """Candidates left after the head-and-tail sample and, on local disks, the prefix sample.

    Both samples come from one read. A stage without files of its size is skipped
    after one early-ending test.
    """
    limit = sample_from if sample_from is not None else (NETWORK_SAMPLE if network else LOCAL_SAMPLE)
    keys, columns = [*TREE, "size"], candidates.columns
    small, large = candidates.where(F.col("size") < limit), candidates.where(F.col("size") >= limit)
    if large.isEmpty():
        return candidates
    hows = {"hash": head_tail(F.col("content"))}
    if not network:
        hows["start"] = F.when(F.octet_length("content") >= prefix_from, prefix(F.col("content")))
    first = narrow(hashes(large, content, hows), keys)
    if network:
        return small.unionByName(first.select(*columns))
    first = cut_lineage(first.withColumnRenamed("hash", "sample"))
    short, long = first.where(F.col("size") < prefix_from), first.where(F.col("size") >= prefix_from)
    if long.isEmpty():
        return small.unionByName(short.select(*columns))
    second = narrow(long.withColumnRenamed("start", "hash"), [*keys, "sample"])
    return small.unionByName(short.select(*columns)).unionByName(second.select(*columns))


def confirmed(candidates: DataFrame, content: DataFrame | BucketedContents, **sampling: object) -> DataFrame:
    """Files whose full SHA-256 recurs among files of the same size; unreadable files drop out."""
    left = sampled(cut_lineage(candidates), content, **sampling).drop("sha256")
    full = hashed(left, content, F.sha2(F.col("content"), 256)).withColumnRenamed("hash", "sha256")
    keys = [*TREE, "size", "sha256"]
    groups = full.where(F.col("sha256").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    return cut_lineage(attach(full, groups.where(F.col("_n") > 1), keys, group_rows="_n"))


def pick_order() -> Column:
    """Smallest first: no copy word, shallower, shorter, created earlier, written earlier, path."""
    return F.struct(
        N.has_copy_word("name").cast("int").alias("copy"), (P.components("path_key") - 1).alias("depth"),
        F.length("path").alias("length"), F.col("created_at").alias("created"),
        F.col("modified_at").alias("modified"), F.col("path_key").alias("key"),
    )


def number_groups(groups: DataFrame) -> DataFrame:
    """``DUP-0001`` upwards by size, then hash, over the table of groups."""
    fraction = F.conv(F.substring("sha256", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    numbered = number_rows(
        groups, fraction - F.col("size").cast("double"), [F.desc("size"), F.col("sha256"), *TREE], "group_index"
    )
    return numbered.withColumn("group_index", F.col("group_index").cast("int")).withColumn(
        "group_id", F.format_string("DUP-%04d", F.col("group_index"))
    )


def grouped(duplicates: DataFrame) -> DataFrame:
    """Number the groups, pick the original of each and mark hard-link aliases.

    All three come from partial aggregations on the group table and are joined
    back salted. An alias shares its physical file with the original or with an
    earlier copy; a file without physical id is never one.
    """
    keys = [*TREE, "size", "sha256"]
    ranked = duplicates.withColumn("_pick", pick_order())
    groups = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_pick").alias("_original"))
    rows = attach(ranked, number_groups(groups), keys, group_rows="_n")
    physical = ranked.where(F.col("physical_id").isNotNull()).groupBy(*keys, "physical_id").agg(
        F.count("*").alias("_m"), F.min("_pick").alias("_first")
    )
    rows = attach(rows, physical, [*keys, "physical_id"], group_rows="_m", how="left")
    return (
        rows.withColumn("is_original", F.col("_pick") == F.col("_original"))
        .withColumn("is_alias", F.coalesce(F.col("_pick") != F.col("_first"), F.lit(False)) & ~F.col("is_original"))
        .withColumn("original_key", F.col("_original.key"))
        .drop("_pick", "_original", "_first")
    )


def totals(rows: DataFrame) -> DataFrame:
    """Copies and wasted bytes of each root; a physical file is counted once."""
    copy = ~F.col("is_original")
    return rows.groupBy(*TREE).agg(
        F.count_if(copy).alias("duplicate_count"),
        F.coalesce(F.sum(F.when(copy & ~F.col("is_alias"), F.col("size"))), F.lit(0)).alias("wasted_bytes"),
    )


EXTRA = ["sha256", "group_id", "group_index", "is_original", "is_alias", "physical_id"]


def reasons(rows: DataFrame) -> DataFrame:
    """Duplicate rows as reasons, with the columns only they have."""
    kind = F.when(F.col("is_original"), "[Original] ").when(F.col("is_alias"), "[Hard link] ").otherwise("[Duplicate] ")
    detail = F.concat(kind, F.lit("hash: "), F.substring("sha256", 1, 12), F.lit("..."))
    points = F.when(F.col("is_original") | F.col("is_alias"), 0).otherwise(SCORE_DUPLICATE)
    return reason_rows(rows, "Duplicate", detail, factors(("Exact duplicate", points)), extra=EXTRA)
