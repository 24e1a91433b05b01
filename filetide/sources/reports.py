"""Report tables and CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, paths, rights
from ..operators import audit, migrate, search
from ..operators.tree import TREE

DATE = "yyyy/MM/dd HH:mm:ss"


def write_csv(report: DataFrame, folder: str) -> None:
    """Every cell quoted, with a header, quotes doubled."""
    report.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def write_transfer_plan(copy: DataFrame, directories: DataFrame, excluded: DataFrame, folder: str, *, threads: int = 8,
                        copy_acl: bool = False) -> None:
    """Copy units, planned folders and exclusions as JSON lines; thread count and ACL flag on every unit."""
    settings = [F.lit(min(max(threads, 1), 32)).alias("threads"), F.lit(copy_acl).alias("copy_acl")]
    copy.select("plan_id", "wave", "source", "destination", *settings).write.mode("overwrite").json(f"{folder}/units")
    directories.write.mode("overwrite").json(f"{folder}/directories")
    excluded.write.mode("overwrite").json(f"{folder}/exclusions")


def _date(column: str) -> Column:
    return F.coalesce(F.date_format(column, DATE), F.lit("-"))


# --- one select per exported report ----------------------------------------

def audit_report(candidates: DataFrame) -> DataFrame:
    parts = F.array_join(F.transform("breakdown", lambda f: F.concat(f["name"], F.lit(" +"), f["points"].cast("string"))), " / ")
    return candidates.select(
        F.array_join("issue_types", ", ").alias("issues"), "name", formats.format_bytes("size", 2).alias("size_text"),
        _date("modified_at").alias("modified"), _date("accessed_at").alias("accessed"), "detail",
        F.coalesce("group_id", F.lit("")).alias("group_id"), "path", "score",
        F.concat(parts, F.lit(" = "), F.col("score").cast("string")).alias("score_parts"),
    )


def acl_matrix(flat: DataFrame) -> DataFrame:
    """One row per folder and entry; the marker row of an unreadable folder is an error row."""
    error = F.col("access_type") == "Error"
    return flat.select(
        "path_key", "folder_name", "protected", "sid", "account", "access_type",
        F.when(error, "AccessDenied").otherwise(rights.friendly("rights")).alias("rights_text"), F.col("rights").alias("rights_bits"),
        "is_inherited", rights.applies_to("inherit_flags", "prop_flags").alias("applies_to"),
    )


def search_report(hits: DataFrame) -> DataFrame:
    return hits.select(
        F.when(F.col("is_dir"), "Folder").otherwise("File").alias("type"), "name", "size",
        F.when(F.col("is_dir"), "-").otherwise(formats.format_bytes("size", 2)).alias("size_text"),
        _date("modified_at").alias("modified"), "ext", F.length("path").alias("path_length"),
        F.coalesce(F.when(F.col("snippet") != "", F.col("snippet")), F.col("reason")).alias("reason_or_snippet"), "path",
    )


def storage_report(shares: DataFrame, errors: DataFrame) -> DataFrame:
    """Folder rows of a scan plus one row per unreadable folder, which is not an empty folder."""
    rows = shares.select(
        *TREE, F.lit("Folder").alias("row_kind"), paths.leaf("folder_key").alias("name"), "folder_key",
        formats.format_bytes("bytes").alias("size_text"),
        F.when(F.col("folder_key") == F.col("root_key"), "-").otherwise(F.format_string("%.1f%%", F.col("percentage"))).alias("share_text"),
        "files", "folders",
    )
    unread = errors.select(
        *TREE, F.lit("Unavailable").alias("row_kind"), paths.leaf("folder_path").alias("name"), F.col("folder_path").alias("folder_key"),
        F.lit("").alias("size_text"), F.lit("").alias("share_text"), F.lit(None).cast("long").alias("files"), F.lit(None).cast("long").alias("folders"),
    ).distinct()
    return rows.unionByName(unread)


def diff_report(diff: DataFrame) -> DataFrame:
    source = F.when(F.col("source_count") == 1, F.col("first_source")).when(F.col("source_count") == 0, "(No existing data)").otherwise(
        F.concat(F.col("source_count").cast("string"), F.lit(" sources")))
    return diff.select(
        "plan_id", "kind", source.alias("source"), "source_detail", F.col("rel_path").alias("target"),
        F.concat(F.lit("Level: "), F.col("level").cast("string"), F.lit(" ("), formats.format_bytes(F.coalesce("est_size", F.lit(0))), F.lit(")")).alias("target_detail"),
    )


def design_matrix(nodes: DataFrame, sources: DataFrame, plan_aces: DataFrame) -> DataFrame:
    """One row per node and entry; nodes without entries or sources say so."""
    counted = migrate.design_diff(nodes, sources)
    joined = counted.join(plan_aces, ["plan_id", "node_id"], "left")
    mapping = F.when(F.col("source_count") == 0, "(New)").when(F.col("source_count") == 1, F.col("first_source")).otherwise(
        F.concat(F.col("source_count").cast("string"), F.lit(" sources")))
    none = F.col("account").isNull()
    return joined.select(
        "plan_id", "rel_path", "name", "level", mapping.alias("mapping"), formats.format_bytes(F.coalesce("est_size", F.lit(0))).alias("size_text"),
        F.when(F.col("inherit_acl"), "Inherited").otherwise("Explicit").alias("inheritance"),
        F.coalesce("account", F.lit("(None)")).alias("account"), F.coalesce("access_type", F.lit("-")).alias("access_type"),
        F.when(none, "-").otherwise(rights.basic("rights")).alias("permissions"),
    )


# --- tables behind the workbook sheets --------------------------------------

ACTIONS = {
    "Duplicate": "Archive or delete all but the original",
    "Dormant": "Ask the owners, then move to an archive",
    "VersionFamily": "Keep the newest version",
    "ExtractedArchive": "Delete the archive",
    "GraveyardTree": "Review the whole folder",
    "PathTooLong": "Flatten or rename folders",
    "InvalidChar": "Rename before migration",
}


def kpi_by_issue(candidates: DataFrame) -> DataFrame:
    """Count, bytes and recommended action per issue; a candidate counts for each of its issues."""
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    each = candidates.select(*TREE, F.explode("issue_types").alias("issue"), "size", "is_original", "is_alias")
    copy = (F.col("issue") != "Duplicate") | ~F.col("is_original")
    size = F.when((F.col("issue") == "Duplicate") & F.col("is_alias"), F.lit(0)).otherwise(F.col("size"))
    return each.where(copy).groupBy(*TREE, "issue").agg(F.count("*").alias("files"), F.sum(size).alias("bytes")).withColumn(
        "action", F.try_element_at(action, F.col("issue")))


def issue_list(candidates: DataFrame) -> DataFrame:
    return audit.sort(candidates).select(
        *TREE, "issue_type", "name", "size", "detail", "score", audit.confidence().alias("confidence"), "path_key"
    )


def media_top(media: DataFrame, k: int = 100) -> DataFrame:
    return media.orderBy(F.desc("size"), "path_key").limit(k).select(*TREE, "path_key", "media_class", "size", "status")


def access_ledger(items: DataFrame) -> DataFrame:
    return items.select(
        "target", "path_key", "folder_name", "level", rights.basic("allowed").alias("rights_text"), "change_type", "grant_source", "grant_trace"
    )


def wave_overview(waves: DataFrame) -> DataFrame:
    warnings = F.array_join(F.array_compact(F.array(
        F.when(F.col("many_files"), "over 100,000 files"), F.when(F.col("over_48h"), "over 48 hours"))), ", ")
    return waves.select(
        "plan_id", "wave", "wave_name", formats.format_bytes("bytes").alias("size_text"), formats.format_count("files").alias("files_text"),
        formats.format_duration("full_seconds").alias("full_copy"), formats.format_duration("cutover_seconds").alias("cutover"),
        "source_count", warnings.alias("warnings"),
    )


def mapping_detail(copy: DataFrame, excluded: DataFrame) -> DataFrame:
    """Units with the number of nested sources left out; the exclusions themselves are rows of their own."""
    counts = excluded.groupBy("plan_id", "source_key").agg(F.count("*").alias("excluded_count"))
    return copy.join(counts, ["plan_id", "source_key"], "left").select(
        "plan_id", "wave", "source_key", "destination_key", F.coalesce("excluded_count", F.lit(0)).alias("excluded_count")
    )
