"""Search predicates. Each returns a boolean ``Column`` over ``entries``.

Words match without case. A word with a separator is looked for in the whole
path, any other word in the name only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ILLEGAL_NAME = r'[\x00-\x1f<>:"/\\|?*]|[ .]$'
LONG_PATH_RISK = 240
UNITS = {"TB": 1024**4, "GB": 1024**3, "MB": 1024**2, "KB": 1024, "B": 1}
CONTENT_EXTENSIONS = [
    ".txt", ".log", ".csv", ".tsv", ".json", ".xml", ".html", ".htm", ".md",
    ".cs", ".sql", ".ps1", ".bat", ".cmd", ".py", ".ini", ".cfg", ".yaml", ".yml",
    ".xlsx", ".xlsm", ".docx", ".pptx", ".pdf",
]
OFFICE_EXTENSIONS = [".xlsx", ".xlsm", ".docx", ".pptx"]


def every(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True)) if predicates else F.lit(True)


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates) if predicates else F.lit(False)


def word(term: str) -> Column:
    if "\\" in term or "/" in term:
        return F.contains(F.col("path_key"), F.lit(term.lower().replace("\\", "/")))
    return F.contains(F.lower("name"), F.lit(term.lower()))


def keyword_groups(groups: Sequence[Sequence[str]]) -> Column:
    """Every group must have at least one of its words."""
    return every([any_of([word(w) for w in group]) for group in groups if group])


def phrases(terms: Sequence[str]) -> Column:
    return every([word(t) for t in terms])


def without(terms: Sequence[str]) -> Column:
    return every([~word(t) for t in terms])


def normal_extension(value: str) -> str:
    clean = value.strip().lstrip("*").lower()
    return clean if clean.startswith(".") else "." + clean


def extensions(values: Sequence[str]) -> Column:
    return F.col("ext").isin(sorted({normal_extension(v) for v in values})) & ~F.col("is_dir")


def parse_bytes(text: str) -> int | None:
    number = text.strip().upper()
    factor = 1
    for unit, value in UNITS.items():
        if number.endswith(unit):
            number, factor = number[: -len(unit)].strip(), value
            break
    try:
        return int(float(number) * factor)
    except ValueError:
        return None


def size_bounds(text: str) -> tuple[int | None, int | None]:
    """``>10MB``, ``<=1GB``, ``1KB..2KB``, or an exact size. All bounds are inclusive."""
    if ".." in text:
        parts = [p for p in text.split("..") if p]
        return (parse_bytes(parts[0]), parse_bytes(parts[1])) if len(parts) == 2 else (None, None)
    value = parse_bytes(text.lstrip("<>=")) if text[:1] in "<>" else parse_bytes(text)
    if text.startswith(">"):
        return value, None
    if text.startswith("<"):
        return None, value
    return value, value


def between(column: str, low: object, high: object) -> Column:
    bounds = []
    if low is not None:
        bounds.append(F.col(column) >= F.lit(low))
    if high is not None:
        bounds.append(F.col(column) <= F.lit(high))
    return every(bounds)


def size_between(low: int | None, high: int | None) -> Column:
    """Folders have no size of their own and never match a size bound."""
    if low is None and high is None:
        return F.lit(True)
    return between("size", low, high) & ~F.col("is_dir")


def date_bounds(text: str, as_of: datetime) -> tuple[datetime | None, datetime | None]:
    """``today``, ``yesterday``, ``>7d``, ``<30d``, ``>2024-01-31``, ``<2024-01-31``."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    name = text.lower()
    if name == "today":
        return day, None
    if name == "yesterday":
        return day - timedelta(days=1), day
    if text[:1] not in "<>":
        return None, None
    relative = re.fullmatch(r"[<>](\d+)d", text)
    if relative:
        bound = as_of - timedelta(days=int(relative.group(1)))
    else:
        try:
            bound = datetime.fromisoformat(text.lstrip("<>="))
        except ValueError:
            return None, None
    return (bound, None) if text.startswith(">") else (None, bound)


def modified_between(low: datetime | None, high: datetime | None) -> Column:
    """Inclusive; a missing date never matches a bound."""
    return between("modified_at", low, high)


def years_before(as_of: datetime, years: int) -> datetime:
    try:
        return as_of.replace(year=as_of.year - years)
    except ValueError:  # 29 February
        return as_of.replace(year=as_of.year - years, day=28)


def dormant_bound(text: str, as_of: datetime) -> datetime | None:
    """``3y``, ``180d`` or ``3`` (years), with an optional comparison sign."""
    match = re.fullmatch(r"[<>=]*\s*(\d+)\s*([yYdD]?)", text)
    if not match or int(match.group(1)) == 0:
        return None
    number, unit = int(match.group(1)), match.group(2).lower()
    return as_of - timedelta(days=number) if unit == "d" else years_before(as_of, number)


def path_contains(terms: Sequence[str]) -> Column:
    return every([F.contains(F.col("path_key"), F.lit(t.lower().replace("\\", "/"))) for t in terms])


def path_at_least(length: int) -> Column:
    return F.length("path") >= length


def illegal_name() -> Column:
    return F.rlike(F.col("name"), F.lit(ILLEGAL_NAME))


def pattern(expression: str) -> Column:
    """Regular expression on name or path; a broken one is an error, not "no filter"."""
    re.compile(expression)
    test = F.lit("(?i)" + expression)
    return F.rlike(F.col("name"), test) | F.rlike(F.col("path"), test)


def entry_type(directories_only: bool | None, include_folders: bool = False) -> Column:
    if directories_only is None:
        return F.lit(True) if include_folders else ~F.col("is_dir")
    return F.col("is_dir") if directories_only else ~F.col("is_dir")


def content_eligible() -> Column:
    return F.col("ext").isin(CONTENT_EXTENSIONS) & ~F.col("is_dir")


def relevance(keywords: Sequence[str], as_of: datetime, snippet: str | None = None) -> Column:
    """Points for name, folder, excerpt and freshness; 0 without any keyword."""
    words = list(dict.fromkeys(w.strip().strip('"*').lower() for w in keywords if w.strip()))
    if not words:
        return F.lit(0)
    name = F.lower("name")
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.coalesce(F.col("parent_key"), F.lit(""))
    score = F.lit(0)
    for w in words:
        kw = F.lit(w)
        score = score + (
            F.when((name == kw) | (base == kw), 100)
            .when(F.startswith(name, kw) | F.startswith(base, kw), 50)
            .when(F.contains(name, kw), 30)
            .otherwise(0)
        )
        score = score + F.when(F.contains(folder, F.lit(w.replace("\\", "/"))), 10).otherwise(0)
        if snippet is not None:
            score = score + F.when(F.contains(F.lower(F.coalesce(snippet, F.lit(""))), kw), 15).otherwise(0)
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("modified_at")) / F.lit(86_400_000_000.0)
    return score + F.when(age <= 7, 5).when(age <= 30, 3).when(age <= 365, 1).otherwise(0)
