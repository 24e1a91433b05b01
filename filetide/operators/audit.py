"""Composition of an audit: one candidate per path, totals, filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import EXTRA
from .skew import sorted_by, top_k
from .tree import TREE

# Fixed order of the detectors; it breaks ties between equal scores.
ISSUES = [
    "PathTooLong", "InvalidChar", "Dormant", "VersionFamily", "ExtractedArchive", "GraveyardTree", "Duplicate",
]
READY = ["Duplicate", "Dormant", "VersionFamily", "ExtractedArchive"]
RECLAIMABLE = ["Duplicate", "VersionFamily", "ExtractedArchive"]
_EXTRA_TYPES = {
    "sha256": "string", "group_id": "string", "group_index": "int", "is_original": "boolean",
    "is_alias": "boolean", "physical_id": "string",
}


def union_reasons(*parts: DataFrame) -> DataFrame:
    """All detectors in one table; columns only duplicates have are null elsewhere."""
    out = None
    for part in parts:
        missing = [F.lit(None).cast(_EXTRA_TYPES[c]).alias(c) for c in EXTRA if c not in part.columns]
        if "is_ignored" not in part.columns:
            missing.append(F.lit(False).alias("is_ignored"))
        part = part.select("*", *missing)
        out = part if out is None else out.unionByName(part)
    return out


def combine(reasons: DataFrame) -> DataFrame:
    """One candidate per path. Scores of independent reasons add up without a cap.

    A path has at most one reason per detector, which bounds the collected list.
    """
    tie = F.array_position(F.array(*[F.lit(i) for i in ISSUES]), F.col("issue_type"))
    item = F.struct(
        F.when(F.col("issue_type") == "Duplicate", 0).otherwise(1).alias("group"), (-F.col("score")).alias("neg"),
        tie.alias("tie"), "issue_type", "detail", "breakdown", "related_key", "path", "name", "parent_key", "size",
        "modified_at", "accessed_at",
    )
    packed = reasons.groupBy(*TREE, "path_key").agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.sum("score").cast("int").alias("score"),
        *[F.max(c).alias(c) for c in EXTRA], F.max("is_ignored").alias("is_ignored"),
    )
    first = F.element_at("_items", 1)
    details = F.array_distinct(F.filter(F.transform("_items", lambda i: i["detail"]), lambda d: F.trim(d) != ""))
    related = F.filter(F.transform("_items", lambda i: i["related_key"]), lambda r: r.isNotNull() & (r != ""))
    return packed.select(
        *TREE, "path_key", *[first[c].alias(c) for c in ("path", "name", "parent_key", "size", "modified_at", "accessed_at")],
        first["issue_type"].alias("issue_type"),
        F.array_distinct(F.transform("_items", lambda i: i["issue_type"])).alias("issue_types"),
        F.array_join(details, " / ").alias("detail"), "score",
        F.flatten(F.transform("_items", lambda i: i["breakdown"])).alias("breakdown"),
        F.get(related, F.lit(0)).alias("related_key"), "sha256", "group_id", "group_index", "physical_id",
        F.coalesce("is_original", F.lit(False)).alias("is_original"),
        F.coalesce("is_alias", F.lit(False)).alias("is_alias"), "is_ignored",
    )


def has_issue(*issues: str) -> Column:
    return F.arrays_overlap("issue_types", F.array(*[F.lit(i) for i in issues]))


def cleanable() -> Column:
    return ~has_issue("GraveyardTree") & ~F.col("is_original")


def reclaimable_bytes() -> Column:
    return F.when(F.col("is_alias"), F.lit(0)).otherwise(F.col("size"))


def confidence() -> Column:
    return (
        F.when(F.col("is_original"), F.lit("Protected")).when(F.col("score") >= 80, F.lit("Recommended"))
        .when(F.col("score") >= 50, F.lit("Review Needed")).otherwise(F.lit("Reference"))
    )


def with_flags(candidates: DataFrame) -> DataFrame:
    return (
        candidates.withColumn("is_cleanable", cleanable())
        .withColumn("reclaimable_bytes", reclaimable_bytes())
        .withColumn("confidence", confidence())
    )


# --- totals ----------------------------------------------------------------

def _issue_totals(wasted: Column) -> list[Column]:
    out = []
    for issue in ISSUES:
        counted = F.col("issue_type") == issue
        size = F.col("size")
        if issue == "Duplicate":
            counted, size = counted & ~F.coalesce("is_original", F.lit(False)), wasted
        out.append(F.count_if(counted).alias(f"{issue}_count"))
        out.append(F.coalesce(F.sum(F.when(counted, size)), F.lit(0)).alias(f"{issue}_bytes"))
    return out


def ready_bytes(candidates: DataFrame) -> DataFrame:
    """Bytes that could be freed at once: copies, older versions and extracted archives."""
    ready = cleanable() & ~F.col("is_ignored") & has_issue(*RECLAIMABLE)
    return candidates.groupBy(*TREE).agg(
        F.coalesce(F.sum(F.when(ready, reclaimable_bytes())), F.lit(0)).alias("ready_bytes")
    )


def summary(entries: DataFrame, reasons: DataFrame, candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per root: files scanned, count and bytes per issue, ready bytes, coverage."""
    scanned = entries.where(~F.col("is_dir")).groupBy(*TREE).agg(F.count("*").alias("files_scanned"))
    alias = F.coalesce("is_alias", F.lit(False))
    per_issue = reasons.groupBy(*TREE).agg(*_issue_totals(F.when(alias, F.lit(0)).otherwise(F.col("size"))))
    cover = coverage.select(*TREE, "unreadable_folders", "is_complete")
    joined = scanned.join(per_issue, TREE, "left").join(ready_bytes(candidates), TREE, "left").join(cover, TREE, "left")
    return joined.na.fill(0)


def totals_of_candidates(candidates: DataFrame) -> DataFrame:
    """The issue totals again, from candidates that remain after a cleanup."""
    copy = F.col("is_original") | F.col("is_alias")
    out = []
    for issue in ISSUES:
        hit = has_issue(issue)
        counted = hit & ~F.col("is_original") if issue == "Duplicate" else hit
        size = F.when(copy, F.lit(0)).otherwise(F.col("size")) if issue == "Duplicate" else F.col("size")
        out.append(F.count_if(counted).alias(f"{issue}_count"))
        out.append(F.coalesce(F.sum(F.when(counted, size)), F.lit(0)).alias(f"{issue}_bytes"))
    return candidates.groupBy(*TREE).agg(*out)


def selection_totals(selected: DataFrame) -> DataFrame:
    """Files and bytes of a selection, each path once."""
    once = selected.groupBy("path_key").agg(F.max("size").alias("size"))
    return once.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# --- filters ---------------------------------------------------------------

def category_filter(name: str) -> Column:
    """The named views of the audit list; ``All`` and unknown names keep everything not ignored."""
    shown = ~F.col("is_ignored")
    if name == "ReadyToClean":
        return shown & (F.col("score") >= 80) & cleanable() & has_issue(*READY)
    if name == "ReviewAdvised":
        return shown & (F.col("score") >= 50) & (F.col("score") < 80) & cleanable()
    if name == "PathLimit":
        return shown & has_issue("PathTooLong", "InvalidChar")
    return shown & has_issue(name) if name in ISSUES else shown


def text_filter(text: str) -> Column:
    needle = F.lit(text.strip().lower())
    hit = F.lit(False)
    for column in ("name", "path", "detail"):
        hit = hit | F.contains(F.lower(F.coalesce(column, F.lit(""))), needle)
    return hit & ~F.col("is_ignored")


# --- orders ----------------------------------------------------------------

def order_by(name: str = "Default", descending: bool = False) -> list[tuple[Column, bool]]:
    """``(expression, descending)`` of a named order; copies of one group stay together, its original first."""
    # Ungrouped rows sort after every group.
    group = (F.coalesce(F.col("group_index"), F.lit(2**31 - 1)), False)
    original = (F.col("is_original"), True)
    lowered = F.lower("name")
    tie = (F.col("path_key"), False)
    if name == "Size":
        return [(F.col("size"), descending), group, original, (lowered, False), tie]
    if name == "LastWriteTime":
        return [(F.col("modified_at"), descending), group, original, tie]
    if name == "FileName":
        return [(lowered, descending), group, original, tie]
    if name == "IssueType":
        number = F.array_position(F.array(*[F.lit(i) for i in ISSUES]), F.col("issue_type"))
        return [(number, descending), group, original, tie]
    if name == "DuplicateGroupIndex":
        return [(F.coalesce("group_index", F.lit(0)), True) if descending else group, original, tie]
    if name == "FullPath":
        return [(F.col("path_key"), descending)]
    if name == "Detail":
        return [(F.lower("detail"), descending), group, original, tie]
    return [(cleanable(), True), (F.col("score"), True), (F.col("size"), True), (lowered, False), tie]


def sort(candidates: DataFrame, name: str = "Default", descending: bool = False) -> DataFrame:
    return sorted_by(candidates, order_by(name, descending))


def shown(candidates: DataFrame, limit: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """Rows to display and, apart from the limit, the count of all that match."""
    ordered = sort(candidates)
    return (ordered if limit is None else ordered.limit(limit)), candidates.agg(F.count("*").alias("matched"))


def early_candidates(reasons: DataFrame, pending: DataFrame, k: int = 300) -> DataFrame:
    """The largest paths with a reason that need no hash, while hashing is still going on."""
    ready = reasons.join(pending.select(*TREE, "path_key").distinct(), [*TREE, "path_key"], "left_anti")
    paths = ready.groupBy(*TREE, "path_key").agg(F.max("size").alias("_size"))
    top = top_k(paths, TREE, [F.desc("_size"), F.col("path_key")], k).select(*TREE, "path_key")
    return combine(ready.join(top, [*TREE, "path_key"], "left_semi"))
