"""Incremental refresh: reuse the old listing of folders that did not change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def unchanged_folders(old: DataFrame, new: DataFrame, tolerance_seconds: int = 2) -> DataFrame:
    """Folders whose modified time is within the tolerance of the cached one."""
    cached = old.where("is_dir").select("root_key", "path_key", F.col("modified_at").alias("_cached"))
    drift = F.abs(F.unix_micros("modified_at") - F.unix_micros("_cached"))
    return new.where("is_dir").join(cached, ["root_key", "path_key"]).where(
        drift <= tolerance_seconds * 1_000_000
    ).select("root_key", "path_key")


def prune_refresh(old: DataFrame, new: DataFrame, enabled: bool = False) -> DataFrame:
    """Entries below unchanged folders from ``old``, all others from ``new``.

    Off by default: a folder's time does not change when a file inside is
    rewritten, so only read-only archives should be refreshed this way.
    """
    if not enabled:
        return new
    pruned = unchanged_folders(old, new).withColumnRenamed("path_key", "ancestor_key")
    folders = old.select("root_key", "parent_key").union(new.select("root_key", "parent_key")).distinct()
    covered = (
        P.explode_ancestors(folders, "parent_key", "root_key", include_self=True)
        .join(pruned, ["root_key", "ancestor_key"], "left_semi").select("root_key", "parent_key").distinct()
    )
    kept = old.join(covered, ["root_key", "parent_key"], "left_semi")
    live = new.join(covered, ["root_key", "parent_key"], "left_anti")
    return kept.select(*new.columns).unionByName(live.select(*new.columns))
