"""Links in files: which are external, where they should point, what can be repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linktext as L
from ..functions import paths as P
from .skew import measured_join

# Bits of what was found in a file.
WORKBOOK, FORMULA, MACRO = 1, 2, 4
MODERN = [".xlsx", ".xlsm", ".docx", ".pptx"]
LEGACY = [".xls"]


def external(links: DataFrame) -> DataFrame:
    return links.where(L.is_external("kind", "target"))


def category(part: Column | str) -> Column:
    """Bit of one package part."""
    p = F.lower(P.col(part))
    return (
        F.when(F.contains(p, F.lit("vbaproject")), MACRO).when(F.contains(p, F.lit("externallink")), WORKBOOK)
        .when(F.contains(p, F.lit("worksheets")) | F.contains(p, F.lit("_rels")) | F.endswith(p, F.lit(".rels")), FORMULA)
        .otherwise(FORMULA)
    )


def lock_siblings(entries: DataFrame) -> DataFrame:
    """Files with whether a ``~$name`` lock file lies beside them; lock files themselves drop out."""
    files = entries.where(~F.col("is_dir"))
    is_lock = F.startswith("name", F.lit("~$"))
    locks = files.where(is_lock).select("path_key").distinct().withColumn("is_locked", F.lit(True))
    wanted = F.concat("parent_key", F.lit(P.SEP + "~$"), F.lower("name"))
    joined = files.where(~is_lock).withColumn("_lock", wanted).join(locks.withColumnRenamed("path_key", "_lock"), "_lock", "left")
    return joined.withColumn("is_locked", F.coalesce("is_locked", F.lit(False))).drop("_lock")


def file_part(kind: Column | str, target: Column | str) -> Column:
    """The path a link names: inside a formula its address, drive or share path, else the whole target."""
    t = P.col(target)
    address = r"((?:[A-Za-z][A-Za-z0-9+.-]*://|[A-Za-z]:|\\\\)(?:[^\"<>|*?\[\]!']|'')*)"
    inner = F.regexp_extract(t, address, 1)
    return F.when(P.col(kind).isin("formula", "definedName") & (inner != ""), inner).otherwise(t)


def rewrite(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links with their repaired target under ``mapping(old_prefix, new_prefix)``; the longest prefix wins.

    The prefix is found by equality on the ancestors of the target, so neither
    side is compared with all of the other.
    """
    key = F.regexp_replace(F.translate(F.lower(file_part("kind", "target")), "\\", P.SEP), "(?<=[^/])/+$", "")
    keyed = links.withColumn("_key", F.replace(key, F.lit("''"), F.lit("'")))
    targets = keyed.select("_key").distinct()
    prefixes = mapping.select(
        P.path_key("old_prefix").alias("prefix_key"), "old_prefix", "new_prefix"
    ).groupBy("prefix_key").agg(F.min(F.struct("old_prefix", "new_prefix")).alias("m"))
    best = (
        P.explode_all_ancestors(targets, "_key", "prefix_key", include_self=True)
        .join(prefixes, "prefix_key")
        .groupBy("_key").agg(F.max(F.struct(F.length("prefix_key").alias("n"), "m")).alias("b"))
        .select("_key", F.col("b.m.old_prefix").alias("old_prefix"), F.col("b.m.new_prefix").alias("new_prefix"))
    )
    joined = measured_join(keyed, best, ["_key"], "left").drop("_key")
    formula = F.col("kind").isin("formula", "definedName")
    old, new = F.col("old_prefix"), F.col("new_prefix")
    replaced = F.when(formula, L.replace_in_formula(F.col("target"), old, new)).otherwise(
        L.replace_ignoring_case(F.col("target"), old, new)
    )
    out = joined.withColumn("new_target", F.when(old.isNull(), F.col("target")).otherwise(replaced))
    needs = (F.coalesce("new_target", F.lit("")) != "") & (F.lower("new_target") != F.lower("target"))
    return out.withColumn("needs_fix", needs)


def changes_per_file(rewritten: DataFrame) -> DataFrame:
    return rewritten.groupBy("file_path").agg(
        F.count("*").alias("links"), F.count_if(F.col("new_target") != F.col("target")).alias("changed")
    )


def item_status(rewritten: DataFrame, locks: DataFrame) -> DataFrame:
    """One row per file: what was found, whether it is locked, what a repair could reach."""
    per_file = rewritten.withColumn("_category", category("part")).groupBy("file_path").agg(
        F.bit_or("_category").alias("categories"), F.count_if("needs_fix").alias("fixable")
    )
    known = locks.select(F.col("path_key").alias("file_path"), "ext", "is_locked")
    joined = per_file.join(known, "file_path", "left").withColumn("is_locked", F.coalesce("is_locked", F.lit(False)))
    status = F.when(F.col("is_locked"), "Locked").when(F.col("ext").isin(LEGACY), "Detected (manual)").otherwise("Candidate")
    macro = F.col("categories").bitwiseAND(MACRO) != 0
    reach = (
        F.when(F.col("is_locked") | F.col("ext").isin(LEGACY) | (F.col("categories") == MACRO), "Skipped")
        .when(F.col("fixable") == 0, "NothingToDo").when(macro, "PartiallyFixed").otherwise("FullyFixed")
    )
    return joined.withColumn("status", status).withColumn("repair", reach)
