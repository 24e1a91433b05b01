"""Differences between access lists: change plan, verification, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rights as R
from .skew import measured_join

KEY = ["account_key", "access_type", "inherit_flags", "prop_flags"]


def with_account_key(aces: DataFrame, principals: DataFrame) -> DataFrame:
    """Identity to compare by: the SID, else the SID behind the name, else the name."""
    known = principals.groupBy(F.lower("account").alias("_name")).agg(F.min("sid").alias("_sid"))
    blank = lambda c: F.when(F.trim(c) != "", F.lower(c))
    joined = measured_join(aces.withColumn("_name", F.lower("account")), known, ["_name"], "left")
    return joined.withColumn(
        "account_key", F.coalesce(blank(F.col("sid")), F.lower("_sid"), F.col("_name"))
    ).drop("_name", "_sid")


def _comparable(aces: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries to compare: explicit ones, or all when inheritance is being switched off."""
    off = folders.select("path_key", (F.col("inherit_before") & ~F.col("inherit_after")).alias("_off"))
    joined = aces.join(off, "path_key")
    kept = joined.where(F.col("_off") | ~F.col("is_inherited"))
    return kept.withColumn("plain_rights", R.without_synchronize("rights")).drop("_off")


def _numbered(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    # Windows below are per folder and identity, so they hold at most one access list.
    return df.withColumn("_no", F.row_number().over(Window.partitionBy("path_key", *keys).orderBy(order)))


def change_plan(before: DataFrame, after: DataFrame, folders: DataFrame) -> DataFrame:
    """Multiset difference of two access lists per folder.

    Equal entries pair off as Untouched; leftovers with the same identity, type
    and scope pair as Modified (last new one with first old one); the rest is
    Removed or Added. ``folders(path_key, inherit_before, inherit_after)``.
    """
    exact = [*KEY, "plain_rights"]
    b = _numbered(_comparable(before, folders), exact, F.asc("ace_order"))
    a = _numbered(_comparable(after, folders), exact, F.asc("ace_order"))
    old = b.select("path_key", *exact, "_no", F.col("rights").alias("before_rights"), F.col("ace_order").alias("before_order"),
                   F.col("account").alias("before_account"))
    new = a.select("path_key", *exact, "_no", F.col("rights").alias("after_rights"), F.col("ace_order").alias("after_order"),
                   F.col("account").alias("after_account"))
    paired = old.join(new, ["path_key", *exact, "_no"], "full_outer")
    untouched = paired.where(F.col("before_order").isNotNull() & F.col("after_order").isNotNull())
    old_left = _numbered(paired.where(F.col("after_order").isNull()).drop("_no"), KEY, F.asc("before_order"))
    new_left = _numbered(paired.where(F.col("before_order").isNull()).drop("_no"), KEY, F.desc("after_order"))
    keep = ["path_key", *KEY, "_no"]
    rest = old_left.select(*keep, "before_rights", "before_order", "before_account").join(
        new_left.select(*keep, "after_rights", "after_order", "after_account"), keep, "full_outer"
    )
    kind = (
        F.when(F.col("before_order").isNull(), "Added").when(F.col("after_order").isNull(), "Removed").otherwise("Modified")
    )
    columns = ["path_key", *KEY, "before_rights", "before_order", "before_account", "after_rights", "after_order", "after_account"]
    both = untouched.select(*columns, F.lit("Untouched").alias("diff_type")).unionByName(
        rest.select(*columns, kind.alias("diff_type"))
    )
    detail = (
        F.when(F.col("diff_type") == "Modified", R.delta("before_rights", "after_rights"))
        .when(F.col("diff_type") == "Removed", F.concat(F.lit("-"), R.basic("before_rights")))
        .when(F.col("diff_type") == "Added", F.concat(F.lit("+"), R.basic("after_rights")))
        .otherwise("")
    )
    return both.withColumn("detail", detail).withColumn(
        "account", F.coalesce("after_account", "before_account")
    ).drop("before_account", "after_account")


def promoted_counts(before: DataFrame, folders: DataFrame) -> DataFrame:
    """Inherited entries that become explicit where inheritance is switched off."""
    inherited = before.groupBy("path_key").agg(F.count_if("is_inherited").alias("_n"))
    off = F.col("inherit_before") & ~F.col("inherit_after")
    return folders.join(inherited, "path_key", "left").select(
        "path_key", F.when(off, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).alias("promoted")
    )


def expected_after(planned: DataFrame) -> DataFrame:
    """Entries a folder should have once the plan is applied."""
    return planned.where(F.col("diff_type") != "Removed").select(
        "path_key", *KEY, R.without_synchronize("after_rights").alias("plain_rights")
    )


def verify(expected: DataFrame, actual: DataFrame, expected_folders: DataFrame, actual_folders: DataFrame) -> DataFrame:
    """Discrepancies: missing and unexpected entries (as multisets) and inheritance mismatches.

    Folder tables are ``(path_key, inherit)``; ``actual`` needs ``account_key``.
    """
    columns = ["path_key", *KEY, "plain_rights"]
    explicit = actual.where(~F.col("is_inherited")).withColumn("plain_rights", R.without_synchronize("rights"))
    want, have = expected.select(*columns), explicit.select(*columns)
    missing = want.exceptAll(have).withColumn("problem", F.lit("Missing"))
    extra = have.exceptAll(want).withColumn("problem", F.lit("Unexpected"))
    flags = expected_folders.withColumnRenamed("inherit", "_want").join(
        actual_folders.withColumnRenamed("inherit", "_have"), "path_key"
    ).where(F.col("_want") != F.col("_have"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in zip(columns[1:], ("string", "string", "int", "int", "int"))]
    switched = flags.select("path_key", *none, F.lit("InheritanceMismatch").alias("problem"))
    return missing.unionByName(extra).unionByName(switched)


def conflicts(expected: DataFrame, current: DataFrame) -> DataFrame:
    """Folders whose descriptor changed since it was read. Both are ``(path_key, sddl)``; a blank is unchecked."""
    now = current.select("path_key", F.col("sddl").alias("current_sddl"))
    changed = F.lower("current_sddl") != F.lower("sddl")
    return expected.where(F.coalesce(F.trim("sddl"), F.lit("")) != "").join(now, "path_key").where(changed)
