"""Detectors of cleanup candidates. Each returns ``reasons`` rows: one per path and issue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import paths as P
from ..functions.formats import format_bytes
from ..session import cut_lineage
from .skew import attach
from .tree import TREE

# Fixed scores and limits.
YEAR_SECONDS = 365.25 * 86400
SCORE_LONG_PATH = SCORE_BAD_NAME = 40
SCORE_VERSION, SCORE_ARCHIVE, SCORE_GRAVEYARD = 75, 90, 80
SCORE_CAP = 95
GRAVEYARD_FILES, GRAVEYARD_BYTES = 3, 1024 * 1024

_FACTOR = "array<struct<name:string,points:int>>"


def seconds_before(as_of: datetime, column: str) -> Column:
    """Age of a timestamp in seconds."""
    return (F.unix_micros(F.lit(as_of)) - F.unix_micros(column)) / F.lit(1_000_000.0)


def factors(*pairs: tuple[str, Column | int]) -> Column:
    """Score breakdown; a pair with null points is left out."""
    items = []
    for name, points in pairs:
        value = points if isinstance(points, Column) else F.lit(points)
        items.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("int").alias("points"))))
    return F.array_compact(F.array(*items)).cast(_FACTOR)


def _score(breakdown: str = "breakdown") -> Column:
    return F.aggregate(breakdown, F.lit(0), lambda acc, f: acc + f["points"])


def reason_rows(df: DataFrame, issue: str, detail: Column, breakdown: Column, *, cap: int | None = None,
                related: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    rows = df.withColumn("breakdown", breakdown)
    score = _score() if cap is None else F.least(_score(), F.lit(cap))
    return rows.select(
        *TREE, "path_key", "path", "name", "parent_key", "size", "modified_at", "accessed_at",
        F.lit(issue).alias("issue_type"), detail.alias("detail"), score.cast("int").alias("score"), "breakdown",
        (F.lit(None).cast("string") if related is None else related).alias("related_key"),
        *extra,
    )


def without_ignored(rows: DataFrame, ignores: DataFrame) -> DataFrame:
    """Leave out files marked to keep whose size and modified time are unchanged."""
    return rows.join(ignores.select("path_key", "size", "modified_at"), ["path_key", "size", "modified_at"], "left_anti")


def void_ignores(ignores: DataFrame, entries: DataFrame) -> DataFrame:
    """Marks that no longer hold because their file was changed."""
    present = entries.where(~F.col("is_dir")).select(
        "path_key", F.col("size").alias("_size"), F.col("modified_at").alias("_modified")
    )
    changed = (F.col("size") != F.col("_size")) | (F.col("modified_at") != F.col("_modified"))
    return ignores.join(present, "path_key").where(changed).select(*ignores.columns).distinct()


def long_paths(files: DataFrame) -> DataFrame:
    detail = F.concat(F.length("path").cast("string"), F.lit(" characters (limit 240)"))
    return reason_rows(files.where(N.is_long_path("path")), "PathTooLong", detail, factors(("Path length", SCORE_LONG_PATH)))


def bad_names(files: DataFrame) -> DataFrame:
    flagged = files.withColumn("_reasons", N.bad_name_reasons("name")).where(F.size("_reasons") > 0)
    return reason_rows(flagged, "InvalidChar", F.array_join("_reasons", " / "), factors(("Unsafe name", SCORE_BAD_NAME)))


def recently_read(as_of: datetime, column: str = "accessed_at") -> Column:
    """Read in the last year; a clock up to a day ahead still counts, later dates do not."""
    age = seconds_before(as_of, column)
    return F.coalesce((age <= YEAR_SECONDS) & (age >= -86400), F.lit(False))


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy/MM/dd")


def _years(column: str, as_of: datetime) -> Column:
    return seconds_before(as_of, column) / YEAR_SECONDS


def dormant(files: DataFrame, as_of: datetime, years: float = 3.0) -> DataFrame:
    """Not written for ``years`` and not read for one year."""
    cutoff = YEAR_SECONDS * years
    old = files.where((seconds_before(as_of, "modified_at") > cutoff) & ~recently_read(as_of))
    age = _years("modified_at", as_of)
    written = F.concat(F.lit("Modified: "), _day("modified_at"), F.format_string(" (%.1f years ago)", age))
    unread = seconds_before(as_of, "accessed_at") > cutoff
    detail = F.concat(written, F.when(unread, F.concat(F.lit(" / Accessed: "), _day("accessed_at"))).otherwise(F.lit("")))
    return reason_rows(old, "Dormant", detail, factors(
        ("Unmodified for years", 60), ("Unread for a year", 10), ("Dormant for over 5 years", F.when(age > 5, 10)),
    ))


def version_families(files: DataFrame, as_of: datetime) -> DataFrame:
    """Older versions beside a newer file of the same family in one folder.

    The newest member comes from a partial aggregation and is joined back salted,
    so neither a folder nor a family with a third of all files is one task.
    """
    keys = [*TREE, "parent_key", "family_key"]
    # Written once: both the families and their members read the names taken apart.
    named = cut_lineage(N.with_family(files.select(*TREE, "parent_key", "path_key", "path", "name", "size", "modified_at", "accessed_at")))
    families = named.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.max(F.col("suffix") != "").alias("_suffixed"),
        F.min(F.struct(
            (-F.unix_micros("modified_at")).alias("newest_first"), F.col("path_key").alias("key"),
            F.col("name").alias("name"), F.col("modified_at").alias("modified_at"), F.col("size").alias("size"),
        )).alias("active"),
    ).where((F.col("_n") >= 2) & F.col("_suffixed"))
    members = attach(named, families, keys, group_rows="_n")
    twin = (F.col("modified_at") == F.col("active.modified_at")) & (F.col("size") == F.col("active.size"))
    older = members.where((F.col("path_key") != F.col("active.key")) & ~twin)
    suffixed = F.col("suffix") != ""
    detail = F.concat(
        F.lit("Newer version exists: "), F.col("active.name"), F.lit(" ("), _day("active.modified_at"), F.lit(")"),
        F.when(suffixed, F.concat(F.lit(" / suffix: "), F.col("suffix"))).otherwise(F.lit("")),
    )
    stale = seconds_before(as_of, "modified_at") > 365 * 86400
    return reason_rows(older, "VersionFamily", detail, factors(
        ("Older version", SCORE_VERSION), ("Version suffix", F.when(suffixed, 10)),
        ("Unmodified for over a year", F.when(stale, 10)),
    ), cap=SCORE_CAP, related=F.col("active.key"))


def folder_activity(files: DataFrame, as_of: datetime) -> DataFrame:
    """Files, bytes, last write, last read and any recent read below every folder of the root."""
    direct = files.groupBy(*TREE, "parent_key").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("modified_at").alias("max_write"),
        F.max("accessed_at").alias("max_access"), F.max(recently_read(as_of)).alias("recent_read"),
    )
    spread = P.explode_ancestors(direct, "parent_key", "root_key", "folder_key", include_self=True)
    return spread.groupBy(*TREE, "folder_key").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.max("max_write").alias("max_write"),
        F.max("max_access").alias("max_access"), F.max("recent_read").alias("recent_read"),
    )


def extracted_archives(files: DataFrame, activity: DataFrame) -> DataFrame:
    """Archives beside a folder of the same name that holds files."""
    archives = files.where(F.col("ext").isin(N.ARCHIVE_EXTENSIONS)).withColumn("_base", N.archive_base("name"))
    archives = archives.withColumn("folder_key", F.concat("parent_key", F.lit(P.SEP), F.lower("_base")))
    folders = activity.select(*TREE, "folder_key", F.col("files").alias("_files"), F.col("bytes").alias("_bytes"))
    joined = archives.join(folders, [*TREE, "folder_key"])
    detail = F.concat(
        F.lit('Extracted folder "'), F.col("_base"), F.lit('/" exists in same folder ('), format_bytes("_bytes"),
        F.lit(" / "), F.format_number(F.col("_files").cast("double"), 0), F.lit(" files)"),
    )
    return reason_rows(joined, "ExtractedArchive", detail, factors(("Extracted folder exists", SCORE_ARCHIVE)),
                       related=F.col("folder_key"))


def graveyards(activity: DataFrame, as_of: datetime, years: float = 3.0) -> DataFrame:
    """Folders below the root with enough content, nothing written for years and nothing read lately."""
    old = seconds_before(as_of, "max_write") > YEAR_SECONDS * years
    dead = activity.where(
        (F.col("folder_key") != F.col("root_key")) & (F.col("files") >= GRAVEYARD_FILES)
        & (F.col("bytes") >= GRAVEYARD_BYTES) & old & ~F.col("recent_read")
    ).withColumn("_leaf", P.leaf("folder_key"))
    age = _years("max_write", as_of)
    as_entry = dead.select(
        *TREE, F.col("folder_key").alias("path_key"), F.col("folder_key").alias("path"),
        F.concat("_leaf", F.lit("/")).alias("name"), P.parent_key("folder_key").alias("parent_key"),
        F.col("bytes").alias("size"), F.col("max_write").alias("modified_at"), F.col("max_access").alias("accessed_at"),
        "files", "_leaf", age.alias("_age"),
    )
    detail = F.concat(
        F.lit("All "), F.format_number(F.col("files").cast("double"), 0), F.lit(" files ("), format_bytes("size"),
        F.format_string(") unedited and unread for %.1f years", F.col("_age")),
    )
    return reason_rows(as_entry, "GraveyardTree", detail, factors(
        ("All files unedited and unread", SCORE_GRAVEYARD),
        ("Folder name", F.when(N.has_graveyard_word("_leaf"), 10)),
        ("Unmodified for over 5 years", F.when(F.col("_age") > 5, 5)),
    ), cap=SCORE_CAP, related=F.col("path_key"))


def discover(files: DataFrame, as_of: datetime, years: float = 3.0, *, versions: bool = True, archives: bool = True,
             graves: bool = True) -> DataFrame | None:
    """The three metadata detectors in one union; a switched-off detector reads nothing."""
    parts = [version_families(files, as_of)] if versions else []
    if archives or graves:
        activity = folder_activity(files, as_of)
        parts += [extracted_archives(files, activity)] if archives else []
        parts += [graveyards(activity, as_of, years)] if graves else []
    if not parts:
        return None
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
