"""Rules on file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import base_of, col, extension

# Suffix patterns of older versions, copies and dates.
VERSION_TOKEN = (
    r"([_\s\-\.](v\d+(\.\d+)*|ver\d*|rev\d*|修正版?|\d+|最新版?|本当(の最終)?|最終版?|確定版?|提出用?|案\d*"
    r"|fix|draft|old|bak|copy|コピー|\(\d+\)))+$"
)
DATE_STAMP = r"([_\s\-\.]\d{4}[._\-]?\d{2}[._\-]?\d{2}|[_\s\-\.]\d{6,8})$"
COPY_SUFFIX = r"(\s*-\s*コピー(\s*\(\d+\))?)$"
COPY_WORDS = [
    "コピー", "copy", "複写", "バックアップ", "backup", "bak", "複製", "復元", "restore", "最新", "old", "new", "編集",
]
COPY_NUMBER = r"[(_\- ]\d+[)]"
GRAVEYARD_WORDS = [
    "_old", "_bak", "_backup", "_退避", "_過去", "_旧", "archive", "temp", "-old", "-bak", "old_",
]
ARCHIVE_EXTENSIONS = [".zip", ".7z", ".tar.gz", ".tgz", ".tar", ".rar", ".lzh", ".bz2", ".xz"]
NTFS_INVALID = r'*:<>?/\|"'
LONG_PATH = 240
ROUNDS = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tail(text: Column, regex: str) -> Column:
    return F.regexp_extract(text, "(?iU)" + regex, 0)


def _cut(text: Column, tail: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - F.length(tail))


def _strip_once(state: Column) -> Column:
    """Cut a copy mark, then a date stamp, then version words from the end of ``state.base``."""

    def finish(c: Column, d: Column, v: Column, left: Column) -> Column:
        base = F.regexp_replace(left, "[ _-]+$", "")
        found = F.transform(F.array(c, d, v), lambda t: F.regexp_replace(t, "^[ _-]+|[ _-]+$", ""))
        return F.struct(
            base.alias("base"), F.concat(state["suffixes"], F.filter(found, lambda t: t != "")).alias("suffixes"),
            (((c == "") & (d == "") & (v == "")) | (base == "")).alias("done"),
        )

    def words(c: Column, d: Column, undated: Column) -> Column:
        return _let(_tail(undated, VERSION_TOKEN), lambda v: finish(c, d, v, _cut(undated, v)))

    def dates(c: Column, uncopied: Column) -> Column:
        return _let(_tail(uncopied, DATE_STAMP), lambda d: _let(_cut(uncopied, d), lambda rest: words(c, d, rest)))

    return _let(_tail(state["base"], COPY_SUFFIX), lambda c: _let(_cut(state["base"], c), lambda rest: dates(c, rest)))


def with_family(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``family_key`` and ``suffix``.

    Copy marks, date stamps and version words are cut from the end of the base
    name, at most five times; a name with nothing left is its own family. A fold
    that stops by itself: most names take one round.
    """
    start = F.struct(
        base_of(name).alias("base"), F.array().cast("array<string>").alias("suffixes"), F.lit(False).alias("done")
    )
    folded = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["done"], s).otherwise(_strip_once(s))
    )
    out = df.withColumn("_family", folded)
    empty = F.col("_family.base") == ""
    family = F.concat(F.lower(F.when(empty, base_of(name)).otherwise(F.col("_family.base"))), extension(name))
    suffix = F.when(empty, F.lit("")).otherwise(F.array_join("_family.suffixes", " "))
    return out.withColumn("family_key", family).withColumn("suffix", suffix).drop("_family")


def has_copy_word(name: Column | str) -> Column:
    lowered = F.lower(col(name))
    found = F.rlike(lowered, F.lit(COPY_NUMBER))
    for word in COPY_WORDS:
        found = found | F.contains(lowered, F.lit(word))
    return found


def bad_name_reasons(name: Column | str) -> Column:
    """Array of the reasons a name is unsafe; empty when it is fine."""
    n = col(name)
    invalid = F.array_distinct(F.split(F.regexp_replace(n, r'[^*:<>?/\\|"]', ""), ""))
    invalid_text = F.array_join(F.filter(invalid, lambda c: c != ""), " ")
    return F.array_compact(F.array(
        F.when(F.endswith(n, F.lit(" ")), F.lit("Trailing space")),
        F.when(F.endswith(n, F.lit(".")), F.lit("Trailing dot")),
        F.when(F.rlike(n, F.lit(r"[\x00-\x1f]")), F.lit("Control characters")),
        F.when(invalid_text != "", F.concat(F.lit("Invalid on NTFS: "), invalid_text)),
    ))


def is_long_path(path: Column | str) -> Column:
    return F.length(col(path)) >= LONG_PATH


def has_graveyard_word(folder_name: Column | str) -> Column:
    lowered = F.lower(col(folder_name))
    found = F.lit(False)
    for word in GRAVEYARD_WORDS:
        found = found | F.contains(lowered, F.lit(word))
    return found


def archive_base(name: Column | str) -> Column:
    """Archive name without its extension; ``x.tar.xz`` loses both."""
    base = base_of(name)
    return F.when(F.endswith(F.lower(base), F.lit(".tar")), base_of(base)).otherwise(base)
