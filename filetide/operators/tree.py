"""Folder tree: roll-ups, shares, differences, listings, largest files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .skew import attach, newest, sorted_by, top_k

TREE = ["root_key", "snapshot_id"]
REPARSE = 0x400

# Extension classes of the storage view.
CATEGORIES = {
    "Virtual disk / ISO": [".vhdx", ".vhd", ".iso", ".vmdk"],
    "Executable / System": [".exe", ".dll", ".msi", ".sys"],
    "Archive": [".zip", ".7z", ".rar", ".tar", ".gz"],
    "Video": [".mp4", ".mkv", ".avi", ".mov"],
    "Image / Graphics": [".jpg", ".png", ".gif", ".webp", ".psd"],
    "Log / System dump": [".log", ".dmp", ".tmp"],
    "Office document": [".docx", ".xlsx", ".pptx", ".pdf"],
}
OTHER_CATEGORY = "Other"
NO_EXTENSION = "(none)"


# --- scope of a scan -------------------------------------------------------

def exclude_folders(entries: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Drop every subtree below the root that has a folder name containing a pattern.

    A pattern without a separator matches inside one path component, so one
    ``contains`` over the folder part replaces a test per name.
    """
    wanted = [p.strip().lower() for p in patterns if p.strip()]
    if not wanted:
        return entries
    folders = F.when(F.col("is_dir"), F.col("path_key")).otherwise(F.col("parent_key"))
    below_root = F.substring(folders, F.length("root_key") + F.lit(1), F.length(folders))
    hit = reduce(lambda a, b: a | b, [F.contains(below_root, F.lit(p)) for p in wanted])
    return entries.where(~F.coalesce(hit, F.lit(False)))


def drop_reparse(entries: DataFrame) -> DataFrame:
    """Junctions and links are not followed: drop them and everything below them.

    Ancestors are expanded for distinct folders, not for every file.
    """
    links = entries.where((F.col("attributes").bitwiseAND(REPARSE)) != 0)
    link_keys = links.select(*TREE, F.col("path_key").alias("ancestor_key")).distinct()
    folders = entries.select(*TREE, "parent_key").distinct()
    cut = (
        P.explode_ancestors(folders, "parent_key", "root_key", include_self=True)
        .join(link_keys, [*TREE, "ancestor_key"], "left_semi")
        .select(*TREE, "parent_key")
        .distinct()
    )
    plain = entries.where(F.coalesce(F.col("attributes").bitwiseAND(REPARSE), F.lit(0)) == 0)
    return plain.join(cut, [*TREE, "parent_key"], "left_anti").select(*entries.columns)


def coverage(entries: DataFrame, scan_errors: DataFrame) -> DataFrame:
    """Folders scanned, files found, unreadable folders, and whether the scan is complete."""
    found = entries.groupBy(*TREE).agg(
        F.count_if("is_dir").alias("folders_scanned"), F.count_if(~F.col("is_dir")).alias("files_found")
    )
    errors = scan_errors.groupBy(*TREE).agg(F.count_distinct("folder_path").alias("unreadable_folders"))
    joined = found.join(errors, TREE, "full_outer")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("folders_scanned", "files_found", "unreadable_folders")]
    return joined.select(*TREE, *counts).withColumn("is_complete", F.col("unreadable_folders") == 0)


def unreadable_folders(scan_errors: DataFrame) -> DataFrame:
    return scan_errors.select(*TREE, "folder_path").distinct().orderBy(*TREE, F.lower("folder_path"))


# --- roll-up ---------------------------------------------------------------

def direct_totals(entries: DataFrame) -> DataFrame:
    """Totals of what lies directly in each folder: the only pass over the files."""
    is_file = ~F.col("is_dir")
    return entries.groupBy(*TREE, "parent_key").agg(
        F.sum(F.when(is_file, F.col("size")).otherwise(F.lit(0))).alias("bytes"),
        F.count_if(is_file).alias("files"),
        F.count_if("is_dir").alias("folders"),
    )


def rollup(entries: DataFrame) -> DataFrame:
    """Bytes, files and folders below every directory, at any depth.

    Files are first summed per folder, and only those sums are repeated for the
    ancestors: the expansion grows with folders times depth, not files times
    depth. Both steps have map-side partial sums, so the root is no hot key.
    """
    sums = ["bytes", "files", "folders"]
    up = P.explode_ancestors(direct_totals(entries), "parent_key", "root_key", "folder_key", include_self=True)
    empty = entries.where("is_dir").select(
        *TREE, F.col("path_key").alias("folder_key"), *[F.lit(0).cast("long").alias(s) for s in sums]
    )
    return (
        up.select(*TREE, "folder_key", *sums)
        .unionByName(empty)
        .groupBy(*TREE, "folder_key")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def root_share(rolled: DataFrame) -> DataFrame:
    """Percentage of the root, clipped at 100. The join is salted: one root may own most folders."""
    roots = rolled.where(F.col("folder_key") == F.col("root_key")).select(
        *TREE, F.col("bytes").alias("root_bytes"), (F.col("folders") + 1).alias("_rows")
    )
    joined = attach(rolled, roots, TREE, group_rows="_rows", how="left")
    share = F.when(F.col("root_bytes") > 0, F.least(F.lit(100.0), F.col("bytes") / F.col("root_bytes") * 100.0))
    return joined.withColumn("percentage", F.coalesce(share, F.lit(0.0)))


def node_sizes(entries: DataFrame, rolled: DataFrame | None = None) -> DataFrame:
    """Every entry with its size: own length for a file, everything below for a folder."""
    rolled = rollup(entries) if rolled is None else rolled
    named = rolled.select(
        *TREE, F.col("folder_key").alias("path_key"), P.parent_key("folder_key").alias("parent_key"),
        P.leaf("folder_key").alias("leaf"), F.lit(True).alias("is_dir"), F.col("bytes").alias("size"), "files", "folders",
    )
    files = entries.where(~F.col("is_dir")).select(
        *TREE, "path_key", "parent_key", P.leaf("path_key").alias("leaf"), "is_dir", "size",
        F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("folders"),
    )
    return named.unionByName(files)


def child_share(entries: DataFrame) -> DataFrame:
    """Share of each child in its parent folder."""
    rolled = rollup(entries)
    parents = rolled.select(
        *TREE, F.col("folder_key").alias("parent_key"), F.col("bytes").alias("parent_bytes"),
        (F.col("files") + F.col("folders")).alias("_rows"),
    )
    joined = attach(
        node_sizes(entries, rolled), parents, [*TREE, "parent_key"], group_rows="_rows"
    )
    whole = F.greatest(F.col("parent_bytes"), F.lit(1))
    return joined.withColumn("share", F.least(F.lit(100.0), F.col("size") / whole * 100.0))


# --- extensions ------------------------------------------------------------

def extension_totals(entries: DataFrame, k: int | None = 10) -> DataFrame:
    """Bytes, files and percentage per extension; the ``k`` largest of each root."""
    files = entries.where(~F.col("is_dir"))
    label = F.when(F.col("ext") == "", F.lit(NO_EXTENSION)).otherwise(F.lower("ext"))
    per_ext = files.groupBy(*TREE, label.alias("extension")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("files")
    )
    totals = per_ext.groupBy(*TREE).agg(F.sum("bytes").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("bytes") / F.col("_total") * 100.0).otherwise(F.lit(0.0))
    stats = per_ext.join(totals, TREE).withColumn("percentage", share).drop("_total")
    return stats if k is None else top_k(stats, TREE, [F.desc("bytes"), F.col("extension")], k)


def category(ext: Column | str) -> Column:
    e = F.lower(P.col(ext))
    label = F.lit(OTHER_CATEGORY)
    for name, members in reversed(CATEGORIES.items()):
        label = F.when(e.isin(members), F.lit(name)).otherwise(label)
    return label


def category_totals(entries: DataFrame) -> DataFrame:
    return (
        entries.where(~F.col("is_dir"))
        .groupBy(*TREE, category("ext").alias("category"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
    )


# --- top lists and orders --------------------------------------------------

def largest_files(entries: DataFrame, k: int = 10, below: str | None = None) -> DataFrame:
    """Largest files of the whole table or of one subtree (planned as a distributed top-k)."""
    files = entries.where(~F.col("is_dir"))
    if below is not None:
        files = files.where(F.startswith("path_key", F.lit(below + P.SEP)))
    return files.orderBy(F.desc("size"), "path_key").limit(k)


def largest_per_root(entries: DataFrame, k: int = 10) -> DataFrame:
    return top_k(entries.where(~F.col("is_dir")), TREE, [F.desc("size"), F.col("path_key")], k, "rank")


def largest_per_folder(entries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest files below every folder.

    A file outside its own folder's first ``k`` cannot be in an ancestor's first
    ``k``, so only those survivors are repeated for the ancestors.
    """
    order = [F.desc("size"), F.col("path_key")]
    files = entries.where(~F.col("is_dir")).select(*TREE, "parent_key", "path_key", "size")
    local = top_k(files, [*TREE, "parent_key"], order, k)
    spread = P.explode_ancestors(local, "parent_key", "root_key", "folder_key", include_self=True)
    return top_k(spread.select(*TREE, "folder_key", "path_key", "size"), [*TREE, "folder_key"], order, k, "rank")


def children(entries: DataFrame, parent: str) -> DataFrame:
    """One level of a folder: pushed down as an equality on ``parent_key``."""
    return ordered_children(entries.where(F.col("parent_key") == parent))


def ordered_children(nodes: DataFrame) -> DataFrame:
    """Folders before files, larger first."""
    name = "name" if "name" in nodes.columns else "leaf"
    tie = [c for c in ("path_key", "folder_key") if c in nodes.columns]
    return nodes.orderBy(F.desc("is_dir"), F.desc("size"), name, *tie)


def preorder_key(key: Column | str) -> Column:
    """Sorts a folder directly before its content: the separator must sort below every character."""
    return F.translate(P.col(key), P.SEP, "\u0001")


def preorder(entries: DataFrame, below: str | None = None) -> DataFrame:
    if below is not None:
        entries = entries.where((F.col("path_key") == below) | F.startswith("path_key", F.lit(below + P.SEP)))
    return sorted_by(entries, [(F.col("root_key"), False), (F.col("snapshot_id"), False), (preorder_key("path_key"), False)])


def with_level(entries: DataFrame, max_level: int | None = None) -> DataFrame:
    """Level below the root from the key alone; optionally cut at a depth."""
    levelled = entries.withColumn("level", P.level_below("path_key", "root_key"))
    return levelled if max_level is None else levelled.where(F.col("level") <= max_level)


def cleanup_hints(entries: DataFrame, k: int = 10) -> DataFrame:
    """Dumps, temporary files and logs above 50 MB; the ``k`` largest of each root."""
    ext = F.lower("ext")
    reason = (
        F.when(ext == ".dmp", F.lit("Crash dump"))
        .when((ext == ".tmp") | ((ext == ".log") & (F.col("size") > 50 * 1024 * 1024)), F.lit("Temporary or large log"))
    )
    hints = entries.where(~F.col("is_dir")).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return top_k(hints, TREE, [F.desc("size"), F.col("path_key")], k, "rank")


# --- snapshots of a tree ---------------------------------------------------

def tree_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Growth per node since the previous snapshot; a new node counts in full, a vanished one is absent."""
    before = previous.select("root_key", "path_key", F.col("size").alias("previous_size"))
    joined = current.join(before, ["root_key", "path_key"], "left")
    return joined.withColumn("diff", F.col("size") - F.coalesce("previous_size", F.lit(0))).withColumn(
        "is_new", F.col("previous_size").isNull()
    )


def diff_totals(diff: DataFrame) -> DataFrame:
    """Growth, shrinkage and net change of each root, from its files."""
    files = diff.where(~F.col("is_dir"))
    return files.groupBy("root_key").agg(
        F.sum(F.greatest("diff", F.lit(0))).alias("grown_bytes"),
        F.sum(F.least("diff", F.lit(0))).alias("shrunk_bytes"),
        F.sum("diff").alias("net_bytes"),
        F.count_if("is_new").alias("new_files"),
    )


def carry_hashes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Keep the old hash of a file whose path, size and both times are unchanged."""
    keys = ["root_key", "path_key", "size", "modified_at", "created_at"]
    known = (
        old.where(~F.col("is_dir") & F.col("sha256").isNotNull())
        .groupBy(*keys)
        .agg(F.min("sha256").alias("_old"))
    )
    joined = new.join(known, keys, "left")
    carried = F.when(~F.col("is_dir"), F.coalesce("sha256", "_old")).otherwise(F.col("sha256"))
    return joined.withColumn("sha256", carried).select(*new.columns)


def write_back_hashes(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Store computed hashes where path, size and modified time still match; one record per path.

    ``hashes(path_key, size, modified_at, sha256)``; of several records for one
    path the smallest (modified, size, hash) counts, so that runs agree.
    """
    first = (
        hashes.where(F.col("sha256").isNotNull())
        .groupBy("path_key")
        .agg(F.min(F.struct("modified_at", "size", "sha256")).alias("_h"))
        .select("path_key", F.col("_h.size").alias("size"), F.col("_h.modified_at").alias("modified_at"),
                F.col("_h.sha256").alias("_new"))
    )
    joined = entries.join(first, ["path_key", "size", "modified_at"], "left")
    return joined.withColumn("sha256", F.coalesce("_new", "sha256")).select(*entries.columns)


def list_roots(entries: DataFrame, scans: DataFrame) -> DataFrame:
    """Published roots, newest first. ``scans(root_key, snapshot_id, ts)`` is one row per publication."""
    totals = entries.where(~F.col("is_dir")).groupBy(*TREE).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("files")
    )
    last = scans.groupBy("root_key").agg(F.max(F.struct("ts", "snapshot_id")).alias("_last")).select(
        "root_key", F.col("_last.snapshot_id").alias("snapshot_id"), F.col("_last.ts").alias("ts")
    )
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes", "files")]
    return last.join(totals, TREE, "left").select(*TREE, "ts", *sums).orderBy(F.desc("ts"), "root_key")


def newest_per_root(sources: Sequence[DataFrame]) -> DataFrame:
    """Of several stores, the newest row of each root; an earlier source wins a tie."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(DataFrame.unionByName, tagged).withColumn("_first", -F.col("source_no"))
    return newest(both, ["root_key"], ["ts", "_first"]).drop("_first")


def low_space(volumes: DataFrame) -> DataFrame:
    """Volumes with at most a tenth (integer division) of their space left."""
    tenth = F.expr("total_bytes div 10")
    return volumes.withColumn("is_low", (F.col("total_bytes") > 0) & (F.col("available_bytes") <= tenth))
