"""Cleanup plan and its revalidation against a newer inventory. Nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit
from .skew import attach
from .tree import TREE

TOLERANCE_SECONDS = 2


def plan(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected cleanable paths, each once, with the original of their duplicate group.

    A path chosen for another reason still gets its original, so that the last
    copy of a content can never be planned away. ``selected(path_key)``.
    """
    chosen = candidates.where(audit.cleanable()).join(selected.select("path_key").distinct(), "path_key", "left_semi")
    originals = candidates.where(F.col("is_original") & F.col("group_id").isNotNull()).select(
        *TREE, "group_id", F.col("path_key").alias("original_key"), F.col("size").alias("original_size"),
        F.col("modified_at").alias("original_modified_at"),
    )
    members = candidates.where(F.col("group_id").isNotNull()).groupBy(*TREE, "group_id").agg(F.count("*").alias("_n"))
    sized = originals.join(members, [*TREE, "group_id"])
    columns = [*TREE, "path_key", "name", "size", "modified_at", "group_id", "sha256", "score"]
    return attach(chosen.select(*columns), sized, [*TREE, "group_id"], group_rows="_n", how="left")


def within_stamp(size: Column, modified: Column, expected_size: Column, expected_modified: Column) -> Column:
    """Same length and a modified time at most two seconds away; an unknown stamp matches."""
    drift = F.abs(F.unix_micros(modified) - F.unix_micros(expected_modified)) <= TOLERANCE_SECONDS * 1_000_000
    same_size = (F.coalesce(expected_size, F.lit(0)) <= 0) | (size == expected_size)
    return same_size & F.coalesce(drift, F.lit(True))


def revalidate(planned: DataFrame, newer: DataFrame) -> DataFrame:
    """Why each planned path may not be cleaned any more, judged on a newer inventory.

    ``reject_reason`` is null for a path that is still safe. Hashes are compared
    where the newer inventory has them; a missing one counts as unproven.
    """
    now = newer.select(
        *[F.col(c) for c in TREE[:1]], "path_key", F.col("is_dir").alias("t_dir"), F.col("size").alias("t_size"),
        F.col("modified_at").alias("t_modified"), F.col("sha256").alias("t_sha"), F.col("physical_id").alias("t_physical"),
    )
    original = newer.where(~F.col("is_dir")).select(
        *[F.col(c) for c in TREE[:1]], F.col("path_key").alias("original_key"), F.col("size").alias("o_size"),
        F.col("modified_at").alias("o_modified"), F.col("sha256").alias("o_sha"), F.col("physical_id").alias("o_physical"),
    )
    joined = planned.join(now, ["root_key", "path_key"], "left").join(original, ["root_key", "original_key"], "left")
    has_original = F.col("original_key").isNotNull()
    micros = lambda a, b: F.abs(F.unix_micros(a) - F.unix_micros(b)) > TOLERANCE_SECONDS * 1_000_000
    same_physical = F.coalesce(F.col("t_physical") == F.col("o_physical"), F.lit(False))
    hashes_equal = F.coalesce(F.col("t_sha") == F.col("o_sha"), F.lit(False))
    reason = (
        F.when(F.col("t_dir"), "TargetIsFolder")
        .when(F.col("t_size").isNull(), "TargetMissing")
        .when(has_original & F.col("o_size").isNull(), "OriginalMissing")
        .when(has_original & (F.col("o_size") != F.col("original_size")), "OriginalSizeChanged")
        .when(has_original & micros("o_modified", "original_modified_at"), "OriginalTimeChanged")
        .when(has_original & same_physical, "SamePhysicalFile")
        .when(has_original & ~hashes_equal, "HashMismatch")
        .when((F.col("t_size") != F.col("size")) | F.coalesce(micros("t_modified", "modified_at"), F.lit(False)), "TargetChanged")
    )
    return joined.select(*planned.columns, reason.alias("reject_reason"))


def revalidation_totals(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("reject_reason", F.lit("Accepted")).alias("outcome")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )
