"""Search: predicates, content, excerpts, orders."""

from datetime import datetime

from pyspark.sql import functions as F

from filetide.functions import snippets, terms
from filetide.operators import search, text
from filetide.operators.search import SearchSpec
from filetide.plans.repair import run_search
from filetide.streaming import hits as stream
from filetide.session import scratch_path, write_scratch
from filetide.sources.textstore import TextStore

from .registry import ORACLE, add, once, positioned

AS_OF = datetime(2002, 1, 1)
DOCS_AS_OF = datetime(2024, 2, 1)


def found(t, spec):
    return search.name_hits(t.estate, spec).select("path_key", "size")


def predicate(name, spec, where):
    add(name, lambda t: found(t, spec), f"SELECT path_key, size FROM {{estate}} WHERE {where}")


predicate("b1_keyword_groups", SearchSpec(keyword_groups=[["LINE_3", "line_5"], ["_77", "_88"]]),
          "NOT is_dir AND (name ILIKE '%line\\_3%' ESCAPE '\\' OR name ILIKE '%line\\_5%' ESCAPE '\\') AND (contains(name, '_77') OR contains(name, '_88'))")
predicate("b1_keyword_with_separator", SearchSpec(keyword_groups=[["Asia\\NATION_12"]]), "NOT is_dir AND contains(path_key, 'asia/nation_12')")
predicate("b2_phrase", SearchSpec(phrases=["Line_4_1"]), "NOT is_dir AND contains(lower(name), 'line_4_1')")
predicate("b3_excluded", SearchSpec(excluded=["line_1", "europe/"]), "NOT is_dir AND NOT contains(lower(name), 'line_1') AND NOT contains(path_key, 'europe/')")
predicate("b4_extensions", SearchSpec(extensions=["*.ZIP", "xz"], include_folders=True), "NOT is_dir AND ext IN ('.zip', '.xz')")
_low, _high = terms.size_bounds("20KB..30KB")
predicate("b5_size_range", SearchSpec(min_size=_low, max_size=_high, include_folders=True), "NOT is_dir AND size BETWEEN 20480 AND 30720")
predicate("b5_size_at_least", SearchSpec(min_size=terms.size_bounds(">0.05MB")[0]), "NOT is_dir AND size >= 52428")
predicate("b6_modified_range", SearchSpec(modified_min=terms.date_bounds(">400d", AS_OF)[0], modified_max=terms.date_bounds("<2001-06-30", AS_OF)[1]),
          "NOT is_dir AND modified_at >= TIMESTAMP '2002-01-01' - INTERVAL 400 DAY AND modified_at <= TIMESTAMP '2001-06-30'")
predicate("b7_dormant", SearchSpec(modified_max=terms.dormant_bound(">3y", AS_OF)), "NOT is_dir AND modified_at <= TIMESTAMP '1999-01-01'")
predicate("b8_path_contains", SearchSpec(path_contains=["EUROPE", "Order_1"]), "NOT is_dir AND contains(path_key, 'europe') AND contains(path_key, 'order_1')")
predicate("b9_path_length", SearchSpec(min_path_length=72), "NOT is_dir AND length(path) >= 72")
add("b10_illegal_names",
    lambda t: search.name_hits(
        t.estate.withColumn("name", F.when(F.length("name") % 5 == 0, F.concat("name", F.lit("?"))).when(F.length("name") % 5 == 1, F.concat("name", F.lit("."))).otherwise(F.col("name"))),
        SearchSpec(only_illegal=True)).groupBy("reason").agg(F.count("*").alias("n")),
    "SELECT 'Illegal Chars' AS reason, COUNT(*) AS n FROM {estate} WHERE NOT is_dir AND length(name) % 5 IN (0, 1)")
predicate("b11_regex", SearchSpec(regex=r"LINE_[3-5]_\d+7_"), "NOT is_dir AND regexp_matches(path_key, 'line_[3-5]_[0-9]+7_')")
predicate("b12_folders_only", SearchSpec(directories_only=True, keyword_groups=[["nation"]]), "is_dir AND contains(lower(name), 'nation')")
predicate("b12_folders_included", SearchSpec(include_folders=True, keyword_groups=[["order_77"]]), "contains(lower(name), 'order_77')")
predicate("b13_empty_spec", SearchSpec(), "NOT is_dir")

# --- content ------------------------------------------------------------------

MIXED = SearchSpec(keyword_groups=[["doc_1", "que"], ["the", "der"]], content_mode=True)
ORACLE["name_text"] = "SELECT d.*, lower(d.name) AS lname, lower(f.text) AS ltext, f.text FROM {docs} d JOIN {file_text} f USING (path_key)"
ORACLE["mixed"] = """
  SELECT *, contains(lname, 'doc_1') OR contains(lname, 'que') AS n1, contains(lname, 'the') OR contains(lname, 'der') AS n2,
    contains(ltext, 'doc_1') OR contains(ltext, 'que') AS t1, contains(ltext, 'the') OR contains(ltext, 'der') AS t2 FROM {name_text}"""
_REASON = """CASE WHEN n1 AND n2 THEN 'Name' WHEN n1 THEN 'Name + Content: "(the OR der)"' WHEN n2 THEN 'Name + Content: "(doc_1 OR que)"'
  ELSE 'Name + Content: "(doc_1 OR que) AND (the OR der)"' END"""
add("b15_content_eligible", lambda t: t.estate.unionByName(t.media).unionByName(t.page_files).where(terms.content_eligible()).groupBy("ext").agg(F.count("*").alias("n")),
    "SELECT ext, COUNT(*) AS n FROM (SELECT * FROM {estate} UNION ALL SELECT * FROM {media} UNION ALL SELECT * FROM {page_files}) WHERE NOT is_dir AND ext IN ('.txt', '.xlsx', '.docx', '.xlsm', '.pdf', '.csv') GROUP BY ALL")
add("b16_external_link_filter", lambda t: search.link_hits(t.page_files, t.links, SearchSpec(link_only=True, link_keyword="example.COM")).select("path_key", "reason"),
    """SELECT path_key, 'OfficeLink: "example.COM"' AS reason FROM {page_files} p WHERE ext <> '.xls' AND EXISTS (
         SELECT 1 FROM {links} l WHERE l.file_path = p.path_key AND contains(lower(target), 'example.com'))""")
add("b17_matched_reasons", lambda t: search.content_hits(t.docs, t.file_text, MIXED).groupBy("reason").agg(F.count("*").alias("n")),
    f"SELECT {_REASON} AS reason, COUNT(*) AS n FROM {{mixed}} WHERE (n1 OR t1) AND (n2 OR t2) GROUP BY ALL")
add("b18_hit_columns", lambda t: search.hit_columns(search.name_hits(t.estate, SearchSpec())).select("path_key", "directory", "path_length", "long_path_risk"),
    "SELECT path_key, parent_key AS directory, length(path) AS path_length, length(path) > 240 AS long_path_risk FROM {estate} WHERE NOT is_dir")
add("b19_bounded_rows", lambda t: search.shown(search.name_hits(t.estate, SearchSpec(extensions=["txt"]))).select("path_key"),
    "SELECT path_key FROM {estate} WHERE ext = '.txt' ORDER BY modified_at DESC, path_key LIMIT 10000")
add("b19_exact_totals", lambda t: search.totals(search.name_hits(t.estate, SearchSpec(extensions=["txt"]))),
    "SELECT COUNT(*) AS hits, CAST(SUM(size) AS BIGINT) AS bytes FROM {estate} WHERE ext = '.txt'")
add("b20_dedupe_hits",
    lambda t: search.dedupe_hits(
        search.name_hits(t.docs, SearchSpec()).select("path_key", "size", F.lit(0).alias("priority"), "snippet", "reason").unionByName(
            search.content_hits(t.docs, t.file_text, SearchSpec(content_keyword="the")).select("path_key", "size", F.lit(1).alias("priority"), F.lit("x").alias("snippet"), "reason"))
    ).select("path_key", "priority", "snippet", "reason"),
    """SELECT path_key, 0 AS priority, CASE WHEN contains(ltext, 'the') THEN 'x' END AS snippet,
         CASE WHEN contains(ltext, 'the') THEN 'Content: "the"' ELSE 'Match' END AS reason FROM {name_text}""")
add("u6_unmet_groups",
    lambda t: search.content_hits(t.docs, t.file_text, SearchSpec(keyword_groups=[["doc_1"], ["que"], ["the"]], content_mode=True)).select("path_key", "reason"),
    """SELECT path_key, CASE WHEN req = '' THEN 'Name' WHEN n = 3 THEN 'Content: "' || req || '"' ELSE 'Name + Content: "' || req || '"' END AS reason FROM (
         SELECT path_key, array_to_string(list_filter([CASE WHEN contains(lname, 'doc_1') THEN '' ELSE 'doc_1' END, CASE WHEN contains(lname, 'que') THEN '' ELSE 'que' END,
             CASE WHEN contains(lname, 'the') THEN '' ELSE 'the' END], lambda x: x <> ''), ' AND ') AS req,
           CAST(NOT contains(lname, 'doc_1') AS INT) + CAST(NOT contains(lname, 'que') AS INT) + CAST(NOT contains(lname, 'the') AS INT) AS n
         FROM {name_text} WHERE (contains(lname, 'doc_1') OR contains(ltext, 'doc_1')) AND (contains(lname, 'que') OR contains(ltext, 'que'))
           AND (contains(lname, 'the') OR contains(ltext, 'the')))""")
add("d24_unite_candidates",
    lambda t: search.unite_candidates([t.previous.where("is_dir").select("path_key"), t.entries.select("path_key")]).select("path_key", "source_no"),
    "SELECT path_key, CASE WHEN is_dir THEN 0 ELSE 1 END AS source_no FROM {entries}")

# --- orders -------------------------------------------------------------------

WORDS = ["order_77", "line_3", "asia"]
_SCORE = " + ".join(
    f"""(CASE WHEN lower(name) = '{w}' OR regexp_replace(lower(name), '[.][^.]*$', '') = '{w}' THEN 100
      WHEN starts_with(lower(name), '{w}') THEN 50 WHEN contains(lower(name), '{w}') THEN 30 ELSE 0 END + CASE WHEN contains(COALESCE(parent_key, ''), '{w}') THEN 10 ELSE 0 END)""" for w in WORDS)
_AGE = "(epoch_us(TIMESTAMP '2002-01-01') - epoch_us(modified_at)) / 86400000000.0"
add("k9_relevance", lambda t: t.estate.select("path_key", terms.relevance(WORDS, AS_OF).alias("relevance")),
    f"SELECT path_key, {_SCORE} + CASE WHEN {_AGE} <= 7 THEN 5 WHEN {_AGE} <= 30 THEN 3 WHEN {_AGE} <= 365 THEN 1 ELSE 0 END AS relevance FROM {{estate}}")
for _order, _sql in {"DateDesc": "modified_at DESC", "DateAsc": "modified_at", "CreatedDesc": "created_at DESC", "CreatedAsc": "created_at"}.items():
    add(f"k8_order_{_order.lower()}",
        lambda t, o=_order: positioned(search.sort_hits(search.name_hits(t.estate, SearchSpec(extensions=["tmp"])), o), "path_key"),
        f"SELECT path_key, row_number() OVER (ORDER BY {_sql}, path_key) AS position FROM {{estate}} WHERE ext = '.tmp'")
add("j2_search",
    lambda t: positioned(run_search(t.docs, SearchSpec(keyword_groups=[["que", "der"]], content_mode=True), DOCS_AS_OF, stored_texts(t), index=postings(t))["rows"], "path_key", "relevance"),
    """SELECT path_key, relevance, row_number() OVER (ORDER BY relevance DESC, modified_at DESC, path_key) AS position FROM (SELECT path_key, modified_at,
         (CASE WHEN contains(lname, 'que') THEN 30 ELSE 0 END) + (CASE WHEN contains(lname, 'der') THEN 30 ELSE 0 END)
         + CASE WHEN contains(lower(COALESCE(snip, '')), 'que') THEN 15 ELSE 0 END + CASE WHEN contains(lower(COALESCE(snip, '')), 'der') THEN 15 ELSE 0 END
         + CASE WHEN age <= 7 THEN 5 WHEN age <= 30 THEN 3 WHEN age <= 365 THEN 1 ELSE 0 END AS relevance FROM (
           SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(modified_at)) / 86400000000.0 AS age FROM {snipped}))""")

# --- excerpts -----------------------------------------------------------------

def _snip_sql(source: str) -> str:
    """Excerpt from ``pos`` (1-based) and ``w``, written with lists of lines."""
    return f"""
  SELECT *, trim(CASE WHEN s2 > 0 THEN '...' ELSE '' END || regexp_replace(regexp_replace(replace(replace(substr(text, s2 + 1, e2 - s2), chr(13), ' '), chr(10), ' '), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')
      || CASE WHEN e2 < length(text) THEN '...' ELSE '' END) AS snip FROM (
    SELECT *, CASE WHEN pos - 1 - s1 > 160 THEN pos - 1 - 60 ELSE s1 END AS s2, CASE WHEN e1 - (pos - 1 + w) > 160 THEN pos - 1 + w + 60 ELSE e1 END AS e2 FROM (
      SELECT *, CASE WHEN len(bl) = 2 AND bl[1] = '' THEN 1 ELSE length(before) - length(array_to_string(bl[GREATEST(len(bl) - 1, 1):], chr(10))) END AS s1,
        pos - 1 + w + length(array_to_string(al[1:2], chr(10))) AS e1 FROM (
        SELECT *, string_split(before, chr(10)) AS bl, string_split(after, chr(10)) AS al FROM (
          SELECT *, substr(text, 1, pos - 1) AS before, substr(text, pos + w) AS after FROM ({source}) WHERE pos > 0))))"""


_FIRST = "CASE WHEN {0} > 0 AND ({1} = 0 OR {0} < {1}) THEN {0} ELSE {1} END"
# Place and width of each group's first word, then of the first among the groups the name does not meet.
_PLACES = f"""SELECT *, CASE WHEN n1 THEN p2 WHEN n2 OR p1 < p2 THEN p1 ELSE p2 END AS pos, CASE WHEN NOT n1 AND (n2 OR p1 < p2) THEN w1 ELSE 3 END AS w FROM (
    SELECT *, {_FIRST.format('a', 'b')} AS p1, CASE WHEN a > 0 AND (b = 0 OR a < b) THEN 5 ELSE 3 END AS w1, {_FIRST.format('c', 'd')} AS p2 FROM (
      SELECT *, instr(ltext, 'doc_1') AS a, instr(ltext, 'que') AS b, instr(ltext, 'the') AS c, instr(ltext, 'der') AS d FROM {{mixed}}))
  WHERE (n1 OR t1) AND (n2 OR t2) AND NOT (n1 AND n2)"""
ORACLE["mixed_hits"] = f"""
  SELECT path_key, {_REASON} AS reason, snip AS snippet FROM ({_snip_sql(_PLACES)}) UNION ALL SELECT path_key, 'Name', NULL FROM {{mixed}} WHERE n1 AND n2"""


@once
def postings(t):
    return text.trigram_index(t.file_text)


def stored_texts(t):
    """The texts in buckets, written once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORES:
        _STORES[key] = TextStore(t.spark, scratch_path(t.spark, "texts"), 16).write(t.file_text)
    return _STORES[key]


_STORES: dict[tuple[str, str], TextStore] = {}
_MIXED_HITS = "SELECT * FROM {mixed_hits}"
add("b14_name_or_content", lambda t: search.content_hits(t.docs, t.file_text, MIXED).select("path_key", "reason", "snippet"), _MIXED_HITS)
add("b14_from_store", lambda t: search.content_hits(t.docs, stored_texts(t), MIXED).select("path_key", "reason", "snippet"), _MIXED_HITS)
add("b14_from_index", lambda t: search.content_hits(t.docs, stored_texts(t), MIXED, postings(t)).select("path_key", "reason", "snippet"), _MIXED_HITS)
add("b14_content_keyword", lambda t: search.content_hits(t.docs, stored_texts(t), SearchSpec(content_keyword="Que", keyword_groups=[["doc_2"]])).select("path_key", "reason", "snippet"),
    f"""SELECT path_key, 'Content: "Que"' AS reason, snip AS snippet FROM ({_snip_sql("SELECT *, instr(ltext, 'que') AS pos, 3 AS w FROM {name_text} WHERE contains(ltext, 'que') AND contains(lname, 'doc_2')")})""")
add("j15_trigram_search", lambda t: text.trigram_search(postings(t), stored_texts(t), "There"), "SELECT path_key FROM {file_text} WHERE contains(lower(text), 'there')")

ORACLE["snipped"] = _snip_sql("""SELECT *, CASE WHEN p1 > 0 AND (p2 = 0 OR p1 <= p2) THEN p1 ELSE p2 END AS pos, 3 AS w FROM (
    SELECT *, instr(ltext, 'que') AS p1, instr(ltext, 'der') AS p2 FROM {name_text})""")
add("f32_snippet", lambda t: t.file_text.select("path_key", snippets.snippet("text", "QUE").alias("snip")).where(F.col("snip").isNotNull()),
    f"SELECT path_key, snip FROM ({_snip_sql('SELECT *, instr(ltext, chr(113) || chr(117) || chr(101)) AS pos, 3 AS w FROM {name_text}')})")
add("f33_highlight", lambda t: t.file_text.select("path_key", snippets.highlight("text", ["que", "der", "there"]).alias("marked")),
    """SELECT path_key, CASE WHEN fin IS NULL THEN '' ELSE
         CASE WHEN l > 0 THEN '...' ELSE '' END || replace(replace(substr(text, l + 1, fin - w - l), chr(10), ' '), chr(13), ' ') || '【' || substr(text, fin - w + 1, w) || '】'
         || replace(replace(substr(text, fin + 1, r - fin), chr(10), ' '), chr(13), ' ') || CASE WHEN r < length(text) THEN '...' ELSE '' END END AS marked FROM (
         SELECT *, GREATEST(0, fin - w - (60 - w) // 2) AS l, LEAST(length(text), fin + (60 - w) // 2) AS r FROM (
           SELECT *, CASE WHEN e3 = m THEN 5 ELSE 3 END AS w, CASE WHEN m < 999999999 THEN m END AS fin FROM (
             SELECT *, LEAST(e1, e2, e3) AS m FROM (
               SELECT *, CASE WHEN instr(ltext, 'que') > 0 THEN instr(ltext, 'que') + 2 ELSE 999999999 END AS e1,
                 CASE WHEN instr(ltext, 'der') > 0 THEN instr(ltext, 'der') + 2 ELSE 999999999 END AS e2,
                 CASE WHEN instr(ltext, 'there') > 0 THEN instr(ltext, 'there') + 4 ELSE 999999999 END AS e3 FROM {name_text}))))""")


# --- streaming ----------------------------------------------------------------

def streamed_hits(t):
    """The saved search over an inventory that arrives as files.

    The files keep the order of the estate: neighbours share most of their paths, so they
    pack well, and nothing is exchanged to write them.
    """
    source, out = write_scratch(t.estate, "arrivals"), scratch_path(t.spark, "hits")
    files = len(t.spark.read.parquet(source).inputFiles())  # a task scans a part of fixed size, so batches of a quarter are many tasks
    arriving = t.spark.readStream.schema(t.estate.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(source)
    stream.stream_hits(arriving, SearchSpec(extensions=["txt"], min_size=20000), out).trigger(availableNow=True).start().awaitTermination()
    return stream.running_totals(t.spark, out)


add("r3_stream_hits", streamed_hits,
    "SELECT COUNT(*) AS hits, CAST(SUM(size) AS BIGINT) AS bytes FROM {estate} WHERE ext = '.txt' AND size >= 20000")
