"""Matching over texts: paged documents, many keywords, trigram postings, decoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.markup import markup_to_text
from ..functions.snippets import three_line_excerpt
from ..session import cut_lineage
from ..sources.textstore import TextStore
from .skew import measured_join

SHARD = 50_000  # keywords in one automaton: some 20 MB

# --- paged documents -------------------------------------------------------

def match_pages(pages: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Documents where every group occurs on some page, with their best page.

    The best page is the first that meets all groups, else the first that meets
    any. Excerpts are made in the scan, for pages with a match; texts are not shuffled.
    """
    lowered = F.lower("text")
    met = [T.any_of([F.contains(lowered, F.lit(w.lower())) for w in g]) for g in groups]
    words = [w for g in groups for w in g]
    first_word = F.coalesce(*[F.when(F.contains(lowered, F.lit(w.lower())), F.lit(w)) for w in words])
    rank = F.when(T.every(met), 0).otherwise(1)
    hits = pages.where(T.any_of(met)).select(
        "path", *[m.alias(f"_g{i}") for i, m in enumerate(met)],
        F.struct(rank.alias("rank"), "page_no", three_line_excerpt("text", first_word).alias("snippet")).alias("_page"),
    )
    docs = hits.groupBy("path").agg(
        *[F.max(f"_g{i}").alias(f"_g{i}") for i in range(len(groups))], F.min("_page").alias("_best")
    )
    return docs.where(T.every([F.col(f"_g{i}") for i in range(len(groups))])).select(
        "path", F.col("_best.page_no").alias("page_no"), F.col("_best.snippet").alias("snippet"),
        (F.col("_best.rank") == 0).alias("all_on_one_page"),
    )


# --- many keywords ---------------------------------------------------------

def match_groups(docs: DataFrame, groups: Sequence[Sequence[str]], key: str = "path_key") -> DataFrame:
    """Numbers of the keyword groups each document meets: one pass, no shuffle."""
    lowered = F.lower("text")
    met = [F.when(T.any_of([F.contains(lowered, F.lit(w.lower())) for w in g]), F.lit(i)) for i, g in enumerate(groups)]
    return docs.select(key, F.array_compact(F.array(*met)).alias("groups")).where(F.size("groups") > 0)


def distinct_trigrams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, trigram)`` once each; duplicates are removed inside the row before anything moves."""
    grams = F.array_distinct(_pieces(F.lower(text), 3))
    return docs.select(key, F.explode(grams).alias("trigram"))


def _pieces(text: Column, width: int) -> Column:
    """All overlapping pieces of ``width`` characters, in one pass over the text.

    A look-ahead matches at every position; substrings by position would walk
    the text again for each of them.
    """
    return F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * width + "))"), F.lit(1))


def match_keyword_table(docs: DataFrame, keywords: DataFrame, key: str = "path_key", shard: int = SHARD) -> DataFrame:
    """Which keywords of a table each document contains, for keyword lists too long for expressions.

    ``keywords(group_id, keyword)``. The distinct keywords are dealt by hash into
    shards of about ``shard``; of each an Aho-Corasick automaton is built in the
    tasks that read the texts, which finds all its keywords in one pass over a text.
    Texts are read once per shard and never shuffled: what leaves the scan is a
    document with the keywords it holds.
    """
    words = cut_lineage(keywords.select("group_id", F.lower("keyword").alias("keyword")).where(F.col("keyword") != "").distinct())
    distinct = words.select("keyword").distinct()
    shards = max(1, -(-distinct.count() // shard))
    dealt = cut_lineage(distinct.withColumn("_shard", F.pmod(F.xxhash64("keyword"), F.lit(shards))))
    # Lower case is Spark's on both sides.
    lowered = docs.where(F.col("text").isNotNull()).select(key, F.lower("text").alias("_text"))
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, keyword string"
    found = [
        lowered.mapInArrow(_scanner([r["keyword"] for r in dealt.where(F.col("_shard") == i).select("keyword").collect()], key), schema)
        for i in range(shards)
    ]
    return measured_join(reduce(DataFrame.unionByName, found), words, ["keyword"]).select(key, "group_id", "keyword")


def _scanner(words: Sequence[str], key: str):
    """All of ``words`` that occur in each text, once each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, i)
        if words:
            automaton.make_automaton()
        for batch in batches:
            hits = [sorted({i for _, i in automaton.iter(t)}) if words else [] for t in batch.column("_text").to_pylist()]
            places = pa.array([at for at, found in enumerate(hits) for _ in found], pa.int64())
            found = pa.array([words[i] for held in hits for i in held], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(places), found], names=[key, "keyword"])

    return scan


# --- trigram index ---------------------------------------------------------

def trigram_index(docs: DataFrame, key: str = "path_key") -> DataFrame:
    return distinct_trigrams(docs, key, "text")


def write_trigram_index(index: DataFrame, path: str, key: str = "path_key", partitions: int | None = None) -> None:
    """Postings sorted by trigram, so that a query reads a few row groups.

    The range is over trigram and document, which splits a very common trigram.
    Without ``partitions`` Spark sets their number by size.
    """
    ranged = index.repartitionByRange(*([partitions] if partitions else []), "trigram", key)
    ranged.sortWithinPartitions("trigram", key).write.mode("overwrite").parquet(path)


def _grams(text: str) -> list[str]:
    lowered = text.lower()
    return sorted({lowered[i:i + 3] for i in range(len(lowered) - 2)})


def trigram_candidates(index: DataFrame, query: str, key: str = "path_key") -> DataFrame:
    """Documents that hold every trigram of the query; some may not hold the query itself."""
    grams = _grams(query)
    if not grams:
        raise ValueError("a query needs three characters to use the index")
    hits = index.where(F.col("trigram").isin(grams)).groupBy(key).agg(F.count("*").alias("_n"))
    return hits.where(F.col("_n") == len(grams)).select(key)


def group_candidates(index: DataFrame, groups: Sequence[Sequence[str]], key: str = "path_key") -> DataFrame:
    """``(key, _met)``: numbers of the keyword groups whose words a document may hold, from one read of the postings.

    A group with a word below three characters may be met by any document and is
    left out.
    """
    asked = {i: [_grams(w) for w in g] for i, g in enumerate(groups) if all(len(w) >= 3 for w in g)}
    every = sorted({gram for words in asked.values() for grams in words for gram in grams})
    held = index.where(F.col("trigram").isin(every)).groupBy(key).agg(F.collect_set("trigram").alias("_held"))
    holds = lambda grams: F.size(F.array_intersect("_held", F.array(*map(F.lit, grams)))) == len(grams)
    met = [F.when(T.any_of([holds(grams) for grams in words]), F.lit(i)) for i, words in asked.items()]
    return held.select(key, F.array_compact(F.array(*met)).alias("_met")).where(F.size("_met") > 0)


def trigram_search(index: DataFrame, docs: DataFrame | TextStore, query: str, key: str = "path_key") -> DataFrame:
    """Documents that contain the query: candidates from the index, verified on the text.

    With a ``TextStore`` only the files that hold candidates are read.
    """
    test = F.contains(F.lower("text"), F.lit(query.lower()))
    if len(query) < 3:
        return (docs.all() if isinstance(docs, TextStore) else docs).where(test).select(key)
    candidates = trigram_candidates(index, query, key)
    if isinstance(docs, TextStore):
        candidates = cut_lineage(candidates)
        docs = docs.of(candidates)
    # The text is tested where it is read; only keys go on to the join.
    return docs.where(test).select(key).join(candidates, key, "left_semi")


# --- decoding --------------------------------------------------------------

def _decode(raw: bytes) -> str:
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    if len(raw) >= 8 and raw[1::2].count(0) > len(raw) // 4:
        return raw.decode("utf-16-le", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp932", "replace")


def decode_text(files: DataFrame) -> DataFrame:
    """``file_text`` from ``file_content``: byte order mark, UTF-16 by null bytes, strict UTF-8, else CP932.

    The whole content decides. Valid UTF-8 without a null byte, marked or not, is
    decoded by expressions; only other contents travel to Python in Arrow batches
    (a null byte may mean UTF-16, and ``decode`` stops at a broken one).
    """

    @F.pandas_udf("string")
    def decode_rest(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: None if raw is None else _decode(bytes(raw)))

    raw = F.col("content")
    mark = F.lit(bytearray(b"\xef\xbb\xbf"))
    plain = F.is_valid_utf8(raw.cast("string")) & ~F.contains(raw, F.lit(bytearray(b"\x00")))
    body = F.when(F.startswith(raw, mark), F.substring(raw, F.lit(4), F.octet_length(raw))).otherwise(raw)
    return files.select("path_key", F.when(plain, body.cast("string")).otherwise(decode_rest(F.when(~plain, raw))).alias("text"))


def pages_to_text(pages: DataFrame, markup: str = "html", key: str = "path_key") -> DataFrame:
    return pages.select(key, markup_to_text(markup).alias("text"))
