"""Excerpts around a match."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

RADIUS = 60


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.translate(text, char, ""))


def snippet_at(text: Column | str, position: Column, length: Column | int, radius: int = RADIUS) -> Column:
    """The matching line with one line either side, trimmed far from the match.

    ``position`` is 1-based as ``locate`` gives it; 0 yields null.
    """
    t = col(text)
    length = F.lit(length) if isinstance(length, int) else length
    far = max(radius * 2, 160)

    def lines(m: Column) -> Column:
        before = F.substring(t, F.lit(1), m["at"])
        after = F.substring(t, m["stop"] + 1, F.length(t))
        return _let(F.struct(m["at"].alias("at"), m["stop"].alias("stop"), before.alias("b"), after.alias("a")), window)

    def window(w: Column) -> Column:
        lone = (_count(w["b"], "\n") == 1) & F.startswith(w["b"], F.lit("\n"))
        start = F.when(lone, F.lit(1)).otherwise(w["at"] - F.length(F.substring_index(w["b"], "\n", -2)))
        end = w["stop"] + F.length(F.substring_index(w["a"], "\n", 2))
        return _let(F.struct(w["at"].alias("at"), w["stop"].alias("stop"), start.alias("s"), end.alias("e")), trimmed)

    def trimmed(w: Column) -> Column:
        start = F.when(w["at"] - w["s"] > far, w["at"] - radius).otherwise(w["s"])
        end = F.when(w["e"] - w["stop"] > far, w["stop"] + radius).otherwise(w["e"])
        return _let(F.struct(start.alias("s"), end.alias("e")), marked)

    def marked(w: Column) -> Column:
        body = F.translate(F.substring(t, w["s"] + 1, w["e"] - w["s"]), "\r\n", "  ")
        body = F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), r"\s+", " ")
        head = F.when(w["s"] > 0, F.lit("...")).otherwise(F.lit(""))
        return F.trim(F.concat(head, body, F.when(w["e"] < F.length(t), F.lit("...")).otherwise(F.lit(""))))

    found = F.struct((position - 1).alias("at"), (position - 1 + length).alias("stop"))
    return _let(found, lambda m: F.when(m["at"] >= 0, lines(m)))


def snippet(text: Column | str, keyword: str, radius: int = RADIUS) -> Column:
    """Snippet around the first occurrence of ``keyword``, ignoring case; null without one."""
    t = col(text)
    return snippet_at(t, F.locate(keyword.lower(), F.lower(t)), len(keyword), radius)


def first_match(text: Column | str, keywords: Sequence[str]) -> Column:
    """``struct(end, width)`` of the match that ends first; of equal ends the longest."""
    lowered = F.lower(col(text))
    found = []
    for kw in keywords:
        pos = F.locate(kw.lower(), lowered)
        found.append(F.when(pos > 0, F.struct((pos + len(kw) - 1).alias("end"), F.lit(-len(kw)).alias("neg"))))
    best = F.array_min(F.array(*found))
    return F.when(best.isNotNull(), F.struct(best["end"].alias("end"), (-best["neg"]).alias("width")))


def highlight(
    text: Column | str, keywords: Sequence[str], length: int = 60, opening: str = "【", closing: str = "】"
) -> Column:
    """The earliest match in brackets with its surroundings; empty without a match."""
    t = col(text)
    flat = lambda c: F.translate(c, "\r\n", "  ")

    def around(m: Column) -> Column:
        start = m["end"] - m["width"]
        margin = F.greatest(F.lit(0), F.floor((F.lit(length) - m["width"]) / 2).cast("int"))
        left, right = F.greatest(F.lit(0), start - margin), F.least(F.length(t), m["end"] + margin)
        out = F.concat(
            F.when(left > 0, F.lit("...")).otherwise(F.lit("")),
            flat(F.substring(t, left + 1, start - left)), F.lit(opening),
            F.substring(t, start + 1, m["width"]), F.lit(closing),
            flat(F.substring(t, m["end"] + 1, right - m["end"])),
            F.when(right < F.length(t), F.lit("...")).otherwise(F.lit("")),
        )
        return F.when(m.isNull(), F.lit("")).otherwise(out)

    return _let(first_match(t, keywords), around)


def three_line_excerpt(text: Column | str, keyword: Column) -> Column:
    """Line with the keyword between its neighbours, joined by `` / ``.

    Without the keyword in any single line the first line is returned.
    """
    lines = F.split(col(text), "\n")
    hits = F.filter(
        F.sequence(F.lit(1), F.size(lines)),
        lambda i: F.contains(F.lower(F.element_at(lines, i)), F.lower(keyword)),
    )
    at = F.get(hits, F.lit(0))
    first = F.greatest(at - 1, F.lit(1))
    last = F.least(at + 1, F.size(lines))
    body = F.array_join(F.transform(F.slice(lines, first, last - first + 1), F.trim), " / ")
    out = F.concat(
        F.when(first > 1, F.lit("... ")).otherwise(F.lit("")), body,
        F.when(last < F.size(lines), F.lit(" ...")).otherwise(F.lit("")),
    )
    return F.when(at.isNull(), F.element_at(lines, 1)).otherwise(out)
