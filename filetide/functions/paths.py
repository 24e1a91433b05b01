"""Path functions.

A *canonical* path is the display form with backslashes. A *key* is the join
form: canonical, lower case, forward slashes, no trailing separator. Folding
case once at the edge keeps ``lower()`` out of every join condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "/"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def canonical_path(path: Column | str) -> Column:
    """Backslashes, long-path prefixes removed, no trailing separator below a root."""
    p = F.regexp_replace(F.trim(col(path)), "/", r"\\")
    p = F.regexp_replace(p, r"(?i)^\\\\\?\\unc\\", r"\\\\")
    p = F.regexp_replace(p, r"^\\\\\?\\", "")
    p = F.when(F.length(p) > 3, F.regexp_replace(p, r"\\+$", "")).otherwise(p)
    return F.coalesce(p, F.lit(""))


def path_key(path: Column | str) -> Column:
    key = F.translate(F.lower(canonical_path(path)), "\\", SEP)
    return F.when(F.length(key) > 1, F.regexp_replace(key, "(?<=.)/+$", "")).otherwise(key)


def map_drives(df: DataFrame, drives: DataFrame, path: str = "path") -> DataFrame:
    """Replace a mapped drive letter by its share.

    ``drives(drive, remote)`` may spell a letter in several ways; rows without a
    letter map nothing. One row per letter is left, at most 26: that is the size
    bound of the broadcast.
    """
    named = F.upper(F.regexp_extract(F.trim("drive"), r"^([A-Za-z]):?[\\/]?$", 1))
    letters = drives.select(F.concat(F.when(named != "", named), F.lit(":")).alias("_drive"), "remote")
    known = F.broadcast(letters.where(F.col("_drive").isNotNull()).groupBy("_drive").agg(F.min("remote").alias("_remote")))
    canonical = canonical_path(path)
    letter = F.upper(F.regexp_extract(canonical, "^([A-Za-z]:)", 1))
    rest = F.expr("substring(_canonical, 3)")
    remote = F.regexp_replace("_remote", r"\\+$", "")
    mapped = (
        F.when(rest == "", F.col("_remote"))
        .when(rest.startswith("\\"), F.concat(remote, rest))
        .otherwise(F.concat(remote, F.lit("\\"), rest))
    )
    joined = df.withColumn("_canonical", canonical).withColumn("_drive", letter).join(known, "_drive", "left")
    value = F.when(F.col("_remote").isNull(), F.col("_canonical")).otherwise(canonical_path(mapped))
    return joined.withColumn(path, value).drop("_canonical", "_drive", "_remote")


def volume_root(path: Column | str) -> Column:
    r"""``C:`` or ``\\server\share``; anything else belongs to ``DEFAULT``."""
    p = canonical_path(path)
    share = F.regexp_extract(p, r"^(\\\\[^\\]*(?:\\[^\\]*)?)", 1)
    drive = F.upper(F.regexp_extract(p, r"^(.:)", 1))
    return F.when(share != "", share).when(drive != "", drive).otherwise(F.lit("DEFAULT"))


def is_network_path(path: Column | str) -> Column:
    return canonical_path(path).startswith("\\\\")


def same_path(left: Column | str, right: Column | str) -> Column:
    return path_key(left).eqNullSafe(path_key(right))


def parent_key(key: Column | str) -> Column:
    k = col(key)
    return F.nullif(F.when(F.locate(SEP, k) > 0, F.regexp_replace(k, "/[^/]*$", "")), F.lit(""))


def base_of(name: Column | str) -> Column:
    """Name without its last extension."""
    n = col(name)
    return F.regexp_replace(n, r"\.[^.]*$", "")


def extension(name: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(col(name), r"(\.[^.]+)$", 1))


def leaf(key: Column | str) -> Column:
    return F.element_at(F.split(col(key), r"[/\\]"), -1)


def components(key: Column | str) -> Column:
    """Number of separator-delimited parts, so ``substring_index(key, '/', n)`` is an ancestor."""
    k = col(key)
    return F.length(k) - F.length(F.translate(k, SEP, "")) + 1


def level_below(key: Column | str, root: Column | str) -> Column:
    return (components(key) - components(root)).cast("int")


def is_below(key: Column | str, root: Column | str) -> Column:
    """Strictly inside by path component, so ``/data2`` is not inside ``/data``."""
    return F.startswith(col(key), F.concat(col(root), F.lit(SEP)))


def explode_ancestors(
    df: DataFrame, key: str, root: Column | str, out: str = "ancestor_key", *, include_self: bool = False
) -> DataFrame:
    """One row per ancestor of ``key`` from ``root`` downwards.

    ``sequence`` + ``substring_index`` instead of a lambda: both stay inside
    whole-stage codegen. Keys outside the root produce no rows.
    """
    first, last = components(root), components(key)
    last = last if include_self else last - 1
    inside = is_below(key, root) | ((col(key) == col(root)) & F.lit(include_self))
    depths = F.when(inside, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return (
        df.withColumn("_depth", F.explode(depths))
        .withColumn(out, F.expr(f"substring_index(`{key}`, '/', _depth)"))
        .drop("_depth")
    )


def ancestor_array(key: Column | str) -> Column:
    """All strict ancestors as an array, outermost first, for display and small fixtures."""
    k = col(key)
    parts = F.split(k, SEP)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), SEP),
    )


def explode_all_ancestors(df: DataFrame, key: str, out: str = "ancestor_key", *, include_self: bool = False) -> DataFrame:
    """One row per ancestor of ``key`` up to its first component, for keys without a known root."""
    last = components(key) if include_self else components(key) - 1
    depths = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return (
        df.withColumn("_depth", F.explode(depths))
        .withColumn(out, F.expr(f"substring_index(`{key}`, '/', _depth)"))
        .where(F.col(out) != "")
        .drop("_depth")
    )
