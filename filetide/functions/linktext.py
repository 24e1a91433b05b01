"""Link targets: external test and prefix rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# What makes a spreadsheet formula refer to another workbook.
BOOK_IN_BRACKETS = r"(?i)\[[^\]]*(?:[\\/][^\]]*|\.xlsx|\.xlsm|\.xlsb|\.xls|\.csv)\]"
INDEX_IN_BRACKETS = r"\[\s*[+-]?\d+\s*\]!"


def is_external_formula(formula: Column | str) -> Column:
    """A path, a workbook in brackets or a numbered book; table columns like ``[Amount]`` are not."""
    f = col(formula)
    hit = F.contains(f, F.lit("\\\\")) | F.contains(f, F.lit(":/"))
    hit = hit | F.rlike(f, F.lit(BOOK_IN_BRACKETS)) | F.rlike(f, F.lit(INDEX_IN_BRACKETS))
    return F.coalesce((F.trim(f) != "") & hit, F.lit(False))


def is_external(kind: Column | str, target: Column | str) -> Column:
    """Relationships and shortcuts are external as recorded; formulas must prove it."""
    k = col(kind)
    return F.when(k.isin("formula", "definedName"), is_external_formula(target)).otherwise(col(target).isNotNull())


def quoted(text: Column) -> Column:
    """A literal as a case-insensitive pattern."""
    safe = F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iu)\\Q"), safe, F.lit("\\E"))


def _as_replacement(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def replace_ignoring_case(text: Column, old: Column, new: Column) -> Column:
    return F.regexp_replace(text, quoted(old), _as_replacement(new))


def replace_in_formula(formula: Column, old: Column, new: Column) -> Column:
    """Inside single quotes a quote is written twice, so both forms of the prefix are tried."""
    double = lambda c: F.replace(c, F.lit("'"), F.lit("''"))
    escaped = F.contains(F.lower(formula), F.lower(double(old)))
    raw = F.contains(F.lower(formula), F.lower(old))
    pieces = F.split(formula, quoted(old), -1)
    quotes = lambda c: F.length(c) - F.length(F.translate(c, "'", ""))
    first = F.element_at(pieces, 1)
    start = F.struct(first.alias("text"), (quotes(first) % 2).alias("open"))

    def step(s: Column, piece: Column) -> Column:
        inserted = F.when(s["open"] == 1, double(new)).otherwise(new)
        return F.struct(F.concat(s["text"], inserted, piece).alias("text"), ((s["open"] + quotes(piece)) % 2).alias("open"))

    aware = F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda s: s["text"])
    return F.when(escaped, replace_ignoring_case(formula, double(old), double(new))).when(raw, aware).otherwise(formula)
