"""Display text of sizes, durations and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# Fixed values.
SUFFIXES = ["B", "KB", "MB", "GB", "TB", "PB"]


def format_bytes(size: Column | str, decimals: int = 1) -> Column:
    """1024-based size; half rounds to even, one decimal drops a trailing zero."""
    n = col(size)
    magnitude = F.abs(n)
    place = F.lit(0)
    for i in range(1, len(SUFFIXES)):
        place = F.when(magnitude >= 1024**i, F.lit(i)).otherwise(place)
    scaled = F.bround(magnitude / F.pow(F.lit(1024.0), place), decimals)
    if decimals == 2:
        text = F.format_string("%.2f", scaled)
    else:
        text = F.regexp_replace(F.format_string("%.1f", scaled), r"\.0$", "")
    text = F.when(place == 0, magnitude.cast("string")).otherwise(text)
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), place + 1)
    return F.when(n == 0, F.lit("0 B")).otherwise(F.concat(sign, text, F.lit(" "), suffix))


def format_duration(seconds: Column | str) -> Column:
    total = F.floor(col(seconds)).cast("long")
    d, h = F.floor(total / 86400), F.floor(total / 3600)
    m, s = F.floor(total / 60), total
    text = lambda *parts: F.concat(*[x for p, unit in parts for x in (p.cast("long").cast("string"), F.lit(unit))])
    return (
        F.when(total >= 86400, text((d, "d "), (h % 24, "h "), (m % 60, "m")))
        .when(total >= 3600, text((h, "h "), (m % 60, "m")))
        .when(total >= 60, text((m, "m "), (s % 60, "s")))
        .otherwise(text((F.greatest(s, F.lit(1)), "s")))
    )


def format_count(count: Column | str) -> Column:
    """Thousands separators; a null is unmeasured, not zero."""
    c = col(count)
    return F.when(c.isNull(), F.lit("Unmeasured (-)")).otherwise(
        F.concat(F.format_number(c.cast("double"), 0), F.lit(" files"))
    )
