"""Hygiene audit and cleanup."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, cleanup, dedupe, hygiene, tree
from ..session import cut_lineage


@dataclass(frozen=True)
class AuditOptions:
    dormant_years: float = 3.0
    min_file_size: int = dedupe.MIN_SIZE
    path_limits: bool = True
    dormant: bool = True
    versions: bool = True
    archives: bool = True
    graveyards: bool = True
    duplicates: bool = True
    network: bool = False
    sample_from: int | None = None


def collect_reasons(
    entries: DataFrame, content: DataFrame | None, ignores: DataFrame, as_of: datetime, options: AuditOptions = AuditOptions()
) -> DataFrame:
    """Reasons of all switched-on detectors, written once; a switched-off detector reads nothing.

    The entries are written first, dealt by path: every detector reads them several times,
    and a table in few files would leave its names and families to as few tasks.
    """
    entries = cut_lineage(entries.repartition("path_key"))
    files = entries.where(~F.col("is_dir"))
    counted = hygiene.without_ignored(files, ignores)
    parts = []
    if options.path_limits:
        parts += [hygiene.long_paths(counted), hygiene.bad_names(counted)]
    if options.dormant:
        parts.append(hygiene.dormant(counted, as_of, options.dormant_years))
    found = hygiene.discover(
        files, as_of, options.dormant_years, versions=options.versions, archives=options.archives, graves=options.graveyards
    )
    if found is not None:
        parts.append(hygiene.without_ignored(found, ignores))
    if options.duplicates and content is not None:
        candidates = dedupe.size_groups(entries, options.min_file_size)
        copies = dedupe.grouped(dedupe.confirmed(candidates, content, network=options.network, sample_from=options.sample_from))
        marks = ignores.select("path_key", "size", "modified_at").distinct().withColumn("_kept", F.lit(True))
        flagged = dedupe.reasons(copies).join(marks, ["path_key", "size", "modified_at"], "left")
        parts.append(flagged.withColumn("is_ignored", F.coalesce("_kept", F.lit(False))).drop("_kept"))
    return cut_lineage(audit.union_reasons(*parts))


def hygiene_audit(
    entries: DataFrame, content: DataFrame | None, ignores: DataFrame, scan_errors: DataFrame, as_of: datetime,
    options: AuditOptions = AuditOptions(),
) -> dict[str, DataFrame]:
    reasons = collect_reasons(entries, content, ignores, as_of, options)
    candidates = audit.combine(reasons)
    return {
        "reasons": reasons,
        "candidates": audit.with_flags(candidates),
        "summary": audit.summary(entries, reasons, candidates, tree.coverage(entries, scan_errors)),
    }


def cleanup_check(candidates: DataFrame, selected: DataFrame, newer: DataFrame) -> dict[str, DataFrame]:
    planned = cleanup.plan(candidates, selected)
    checked = cleanup.revalidate(planned, newer)
    return {"selection": audit.selection_totals(planned), "plan": checked, "outcome": cleanup.revalidation_totals(checked)}
