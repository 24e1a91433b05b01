"""Search over entries and their texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.snippets import snippet_at
from ..session import cut_lineage
from ..sources.textstore import TextStore
from .text import group_candidates

MAX_ROWS = 10_000  # rows kept for display; totals always count everything


@dataclass(frozen=True)
class SearchSpec:
    """The filters of one search; an empty spec matches every entry of the allowed type."""

    keyword_groups: Sequence[Sequence[str]] = ()
    phrases: Sequence[str] = ()
    excluded: Sequence[str] = ()
    extensions: Sequence[str] = ()
    min_size: int | None = None
    max_size: int | None = None
    modified_min: datetime | None = None
    modified_max: datetime | None = None
    path_contains: Sequence[str] = ()
    min_path_length: int | None = None
    only_illegal: bool = False
    regex: str | None = None
    directories_only: bool | None = None
    include_folders: bool = False
    content_mode: bool = False
    content_keyword: str | None = None
    link_only: bool = False
    link_keyword: str | None = None

    def metadata_column(self) -> Column:
        """Everything but the words: plain predicates that reach the Parquet scan."""
        parts = [T.entry_type(self.directories_only, self.include_folders)]
        if self.extensions:
            parts.append(T.extensions(self.extensions))
        parts.append(T.size_between(self.min_size, self.max_size))
        parts.append(T.modified_between(self.modified_min, self.modified_max))
        if self.min_path_length is not None:
            parts.append(T.path_at_least(self.min_path_length))
        if self.only_illegal:
            parts.append(T.illegal_name())
        if self.path_contains:
            parts.append(T.path_contains(self.path_contains))
        if self.excluded:
            parts.append(T.without(self.excluded))
        if self.regex is not None:
            parts.append(T.pattern(self.regex))
        return T.every(parts)

    def name_column(self) -> Column:
        return T.keyword_groups(self.keyword_groups) & T.phrases(self.phrases)

    def to_column(self) -> Column:
        return self.metadata_column() & self.name_column()

    def all_groups(self) -> list[list[str]]:
        return [list(g) for g in self.keyword_groups if g] + [[p] for p in self.phrases if p.strip()]

    def words(self) -> list[str]:
        flat = [w for g in self.keyword_groups for w in g]
        return list(dict.fromkeys(w.lower() for w in flat))


def _label(group: Sequence[str]) -> str:
    return "(" + " OR ".join(group) + ")" if len(group) > 1 else group[0]


def name_hits(entries: DataFrame, spec: SearchSpec) -> DataFrame:
    reason = "Illegal Chars" if spec.only_illegal else ("Name" if spec.content_mode else "Match")
    return entries.where(spec.to_column()).select(
        "*", F.lit(None).cast("string").alias("snippet"), F.lit(reason).alias("reason")
    )


def text_marks(texts: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Which groups a text meets, and an excerpt for each, computed in the scan.

    Whole texts are read but never shuffled: what goes on to the join is the
    path, a flag per group and a short excerpt, for texts that meet a group.
    """
    lowered = F.lower("text")
    marks = []
    for group in groups:
        places = [
            F.when(pos > 0, F.struct(pos.alias("pos"), F.lit(len(w)).alias("width")))
            for w in group
            for pos in [F.locate(w.lower(), lowered)]
        ]
        best = places[0] if len(places) == 1 else F.array_min(F.array(*places))
        # Bound as a lambda variable, so that positions are looked up once per text and group.
        marked = F.transform(F.array(best), lambda b: F.when(b.isNotNull(), F.struct(
            b["pos"].alias("pos"), snippet_at("text", b["pos"], b["width"]).alias("snippet"))))
        marks.append(F.get(marked, F.lit(0)))
    meets_one = T.any_of([F.contains(lowered, F.lit(w.lower())) for g in groups for w in g])
    return texts.where(meets_one).select("path_key", F.array(*marks).alias("marks"))


def content_hits(entries: DataFrame, texts: DataFrame | TextStore, spec: SearchSpec, index: DataFrame | None = None) -> DataFrame:
    """Name-or-content search: groups the name does not meet must be met by the text.

    The ``content_keyword`` is always required from the text. In plain mode the
    name must match in full and only the ``content_keyword`` is looked up.

    Metadata decides first. With a ``TextStore`` only the files that hold texts of
    the entries left are read, and with a trigram ``index`` only entries whose
    postings allow the groups still open are left.
    """
    base = entries.where(spec.metadata_column())
    named = spec.name_column()
    mandatory = [[spec.content_keyword]] if spec.content_keyword else []
    if not spec.content_mode and not mandatory:
        return name_hits(entries, spec)

    groups = mandatory + (spec.all_groups() if spec.content_mode else [])
    met_by_name = [F.lit(False)] * len(mandatory) + [
        T.any_of([T.word(w) for w in g]) for g in groups[len(mandatory):]
    ]
    candidates = base.where(T.content_eligible())
    if spec.content_mode:
        candidates = candidates if mandatory else candidates.where(~named)
    else:
        candidates = candidates.where(named)

    candidates = candidates.withColumn("_named", F.array(*met_by_name))
    if index is not None:
        candidates = _allowed(candidates, index, groups)
    if isinstance(texts, TextStore):
        candidates = cut_lineage(candidates)
        texts = texts.of(candidates)
    joined = candidates.join(text_marks(texts, groups), "path_key")
    numbers = range(1, len(groups) + 1)
    required = [~F.element_at("_named", i) for i in numbers]
    in_text = [F.element_at("marks", i).isNotNull() for i in numbers]
    ok = T.every([~need | there for need, there in zip(required, in_text)])
    needed = sum((r.cast("int") for r in required), F.lit(0))
    best = F.array_min(F.array(*[F.when(required[i - 1], F.element_at("marks", i)) for i in numbers]))
    labels = F.array_compact(F.array(*[F.when(required[i - 1], F.lit(_label(groups[i - 1]))) for i in numbers]))
    text = F.concat(F.lit('Content: "'), F.array_join(labels, " AND "), F.lit('"'))
    also_name = (F.lit(len(spec.keyword_groups)) > needed) | (F.lit(len(spec.words())) > needed)
    reason = F.when(needed == 0, F.lit("Name")).when(also_name, F.concat(F.lit("Name + "), text)).otherwise(text)
    from_text = joined.where(ok).select(*entries.columns, best["snippet"].alias("snippet"), reason.alias("reason"))
    if not spec.content_mode or mandatory:
        return from_text
    return name_hits(entries, spec).unionByName(from_text)


def _allowed(candidates: DataFrame, index: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Candidates whose open groups (``_named`` says which the name meets) may all be in the text."""
    open_groups = [i for i, g in enumerate(groups) if all(len(w) >= 3 for w in g)]
    if not open_groups:
        return candidates
    known = candidates.join(group_candidates(index, groups), "path_key", "left")
    may = [F.element_at("_named", i + 1) | F.coalesce(F.array_contains("_met", i), F.lit(False)) for i in open_groups]
    return known.where(T.every(may)).drop("_met")


def link_hits(entries: DataFrame, links: DataFrame, spec: SearchSpec) -> DataFrame:
    """Office files with any external link, or with one whose target contains a text."""
    targets = links
    reason = "Office External Link"
    if spec.link_keyword:
        targets = links.where(F.contains(F.lower("target"), F.lit(spec.link_keyword.lower())))
        reason = f'OfficeLink: "{spec.link_keyword}"'
    keyed = targets.select(F.col("file_path").alias("path_key"))
    base = entries.where(spec.to_column() & F.col("ext").isin(T.OFFICE_EXTENSIONS))
    return base.join(keyed, "path_key", "left_semi").select(
        *entries.columns, F.lit(None).cast("string").alias("snippet"), F.lit(reason).alias("reason")
    )


def hits(
    entries: DataFrame, spec: SearchSpec, texts: DataFrame | TextStore | None = None, links: DataFrame | None = None, index: DataFrame | None = None
) -> DataFrame:
    """All hits of a spec with excerpt and reason."""
    if (spec.content_mode or spec.content_keyword) and texts is not None:
        return content_hits(entries, texts, spec, index)
    if (spec.link_only or spec.link_keyword) and links is not None:
        return link_hits(entries, links, spec)
    return name_hits(entries, spec)


def hit_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "*", F.col("parent_key").alias("directory"), F.length("path").alias("path_length"),
        (F.length("path") > T.LONG_PATH_RISK).alias("long_path_risk"),
    )


def totals(found: DataFrame) -> DataFrame:
    """Count and bytes of every hit, independent of how many rows are shown."""
    return found.agg(
        F.count("*").alias("hits"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def shown(found: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """The rows kept for display; ``totals`` is the other half of the answer."""
    return found.orderBy(F.desc("modified_at"), "path_key").limit(limit)


SORTS = {
    "DateDesc": ["-modified_at"],
    "DateAsc": ["modified_at"],
    "CreatedDesc": ["-created_at"],
    "CreatedAsc": ["created_at"],
    "Relevance": ["-relevance", "-modified_at"],
}


def sort_hits(found: DataFrame, order: str = "Relevance") -> DataFrame:
    """A named order with the path as tie-break; unknown names mean relevance."""
    keys = SORTS.get(order, SORTS["Relevance"])
    return found.orderBy(*[F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys], "path_key")


def dedupe_hits(found: DataFrame) -> DataFrame:
    """One hit per path: the first by ``priority``; an empty excerpt is taken from a later one."""
    rest = [c for c in found.columns if c not in ("path_key", "priority", "snippet", "reason")]
    has = F.coalesce(F.col("snippet"), F.lit("")) != ""
    packed = found.groupBy("path_key").agg(
        F.min(F.struct("priority", "snippet", "reason", *rest)).alias("_first"),
        F.min(F.when(has, F.struct("priority", "snippet", "reason"))).alias("_with"),
    )
    own = F.coalesce(F.col("_first.snippet"), F.lit("")) != ""
    pick = lambda c: F.when(own | F.col("_with").isNull(), F.col(f"_first.{c}")).otherwise(F.col(f"_with.{c}"))
    return packed.select(
        "path_key", F.col("_first.priority").alias("priority"), pick("snippet").alias("snippet"),
        pick("reason").alias("reason"), *[F.col(f"_first.{c}").alias(c) for c in rest],
    )


def unite_candidates(sources: Sequence[DataFrame]) -> DataFrame:
    """Paths from outside indexes and the full scan, each once; an earlier source wins."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    merged = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in merged.columns if c not in ("path_key", "source_no")]
    packed = merged.groupBy("path_key").agg(F.min(F.struct("source_no", *rest)).alias("_row"))
    return packed.select("path_key", "_row.*")
