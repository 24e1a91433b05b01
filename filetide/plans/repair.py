"""Link repair, media report and search jobs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from ..functions import terms
from ..operators import links, media, search
from ..sources.textstore import TextStore


def link_repair_plan(all_links: DataFrame, mapping: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    rewritten = links.rewrite(links.external(all_links), mapping)
    return {
        "links": rewritten,
        "changes": links.changes_per_file(rewritten),
        "files": links.item_status(rewritten, links.lock_siblings(entries)),
    }


def media_report(entries: DataFrame, optimised: DataFrame, **options: object) -> dict[str, DataFrame]:
    """``optimised(path_key, optimised_size)`` holds the sizes measured after optimisation."""
    classified = media.classify(entries, **options)
    sized = media.with_savings(classified.join(optimised, "path_key", "left"))
    return {"media": sized, "videos": media.videos(sized), "totals": media.totals(sized)}


def run_search(
    entries: DataFrame, spec: search.SearchSpec, as_of: datetime, texts: DataFrame | TextStore | None = None, links: DataFrame | None = None,
    order: str = "Relevance", index: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All hits in order and their totals; ``search.shown``-like cuts are the caller's."""
    found = search.hit_columns(search.hits(entries, spec, texts, links, index))
    words: Sequence[str] = [*spec.words(), *spec.phrases]
    scored = found.withColumn("relevance", terms.relevance(words, as_of, "snippet"))
    return {"totals": search.totals(found), "rows": search.sort_hits(scored, order)}
