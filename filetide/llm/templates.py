"""Line dedup by a log-template tree (operator 2).

A line is parsed to tokens between white space; tokens with a digit, an ``@`` or
``://`` are variable fields. The tree has a fixed depth: token count, then the
leading ``DEPTH`` tokens. Below a leaf the remaining tokens are cut into
``SEGMENTS`` equal parts. A template of the leaf is either all parts as they
are, or, for lines long enough, all parts but one, which is then a variable
field too. So every line has one exact and up to ``SEGMENTS`` general templates,
all of them hashes: no line is compared with another.

A template recurs if it stands in ``MIN_DOCS`` or more unrelated documents, more
for short lines (``MIN_EVIDENCE``: documents times tokens). Copies are not
unrelated: documents with equal texts count once. Of other documents, one whose
other lines mostly stand in fewer than ``MIN_DOCS`` documents is unrelated to all.
One made mostly of lines that others have too may be a near copy: its family is
the document that most of its ``SKETCH`` smallest shared leaves, each under an order of
its own, lead to (the least edited of those that share the leaf), so that neither an edited line nor a shared header decides
alone. However many copies there are, they neither make a line recur nor keep
one that does; their own lines are left to near dedup. Lines of fewer than
``MIN_TOKENS`` tokens (captions, closings) never enter the tree and always stay.

Of the lines of a recurring template the first, by ``doc_id`` and line number,
stays and the others go.

Defined results: a null text stays null, a text without a dropped line stays as
it is (also empty, blank and very long ones); a text whose lines all go becomes
empty and its row stays; a null ``doc_id`` sorts first; rows equal in ``doc_id``
and text are one document and get the same result. ``n_chars`` follows a changed
text; all other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, stored, table

DEPTH = 3
SEGMENTS = 4
MIN_TOKENS = 4
MIN_GENERAL = 16  # fewer tokens than this have no template with a general part
MIN_DOCS = 3
MIN_EVIDENCE = 30
SKETCH = 5  # orders of a document's leaves, each read from another place of their md5
VARIABLE = "[0-9@]|://"


def tokens(line: Column) -> Column:
    # Empty parts between blanks are removed natively; ``VARIABLE`` over a whole line is slower than its two halves.
    parts = F.array_remove(F.split(line, r"[\x20\x09-\x0D]"), "")
    masked = F.transform(parts, lambda t: F.when(t.rlike(VARIABLE), "<*>").otherwise(t))
    return F.when(line.rlike("[0-9@]") | line.contains("://"), masked).otherwise(parts)


def _line(toks: Column, at: Column) -> Column:
    n = F.size(toks)
    rest = n - DEPTH

    def part(k: int) -> Column:
        begin, end = F.floor(rest * k / SEGMENTS).cast("int"), F.floor(rest * (k + 1) / SEGMENTS).cast("int")
        return F.xxhash64(F.slice(toks, begin + DEPTH + 1, end - begin))

    def keys(leaf: Column, parts: Column) -> Column:
        exact = F.xxhash64(F.lit(-1), leaf, parts)
        general = [F.xxhash64(F.lit(k), leaf, *[parts[j] for j in range(SEGMENTS) if j != k]) for k in range(SEGMENTS)]
        return F.when(n >= MIN_GENERAL, F.array(exact, *general)).otherwise(F.array(exact))

    def row(leaf: Column) -> Column:
        all_keys = let(F.array(*[part(k) for k in range(SEGMENTS)]), lambda parts: keys(leaf, parts))
        return F.struct(at.alias("at"), n.alias("n_tokens"), leaf.alias("leaf"), all_keys.alias("keys"))

    return let(F.md5(F.concat_ws(" ", n.cast("string"), F.slice(toks, 1, DEPTH))), row)


def parsed(docs: DataFrame) -> DataFrame:
    """One row per line with enough tokens: its document, place, leaf and templates, and how many leaves the document has."""
    # All of it stands inside one explode: of a column exploded or filtered later, Spark would push the test that it is
    # not empty below the parse, and parse every text a second time for it.
    toks = F.transform(F.split("text", "\n"), tokens)
    made = F.filter(F.transform(toks, lambda t, i: F.when(F.size(t) >= MIN_TOKENS, _line(t, i))), lambda x: x.isNotNull())

    def counted(lines: Column) -> Column:
        total = F.size(F.array_distinct(lines["leaf"]))
        return let(total, lambda n: F.transform(lines, lambda x: F.struct(n.alias("total"), x.alias("line"))))

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("body"), F.explode(let(made, counted)).alias("row"))
    return rows.select(
        "doc_id", "body", F.xxhash64("doc_id", "body").alias("who"), "row.total", "row.line.at", "row.line.n_tokens",
        F.xxhash64("row.line.leaf").alias("leaf"), F.col("row.line.leaf").alias("digest"), "row.line.keys",
    )


def families(shared: DataFrame) -> DataFrame:
    """``(who, family)`` of the documents that hold lines of shared leaves."""
    order = lambda k: F.conv(F.substring("digest", 4 * k + 1, 15), 16, 10).cast("long")
    held = shared.groupBy("who").agg(
        F.count_distinct("leaf").alias("n_shared"), F.first("total").alias("total"), F.first("body").alias("body"), F.first("doc_id").alias("doc_id"),
        *[F.min(order(k)).alias(f"least{k}") for k in range(SKETCH)],
    )
    # Of the other lines of a document, those no one else has are more than half.
    apart = 2 * (F.col("total") - F.col("n_shared")) > F.col("total") - 1
    held = stored(held.withColumn("apart", apart), "leaf-counts")
    # Head of those that share a smallest leaf: the least edited, so that the same document heads most of a group's leaves.
    rank = F.struct((F.col("total") - F.col("n_shared")).alias("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    near = held.where(~F.col("apart")).withColumn("rank", rank).select("who", "rank", F.posexplode(F.array(*[f"least{k}" for k in range(SKETCH)])).alias("k", "least"))
    heads = near.groupBy("k", "least").agg(F.min("rank")["id"].alias("head"))
    led = near.join(heads, ["k", "least"]).groupBy("who", "head").agg(F.count("*").alias("n"))
    most = led.groupBy("who").agg(F.max(F.struct("n", "head"))["head"].alias("head"))
    joined = held.join(most, "who", "left")
    return joined.select("who", F.when(F.col("apart"), F.col("body")).otherwise(F.xxhash64(F.lit("head"), F.col("head"))).alias("family"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, gone)``: places of the lines to drop, for the documents that have any."""
    lines = stored(parsed(docs), "lines")
    leaves = lines.select("leaf", "body").distinct().groupBy("leaf").agg(F.count("*").alias("bodies")).where(F.col("bodies") >= MIN_DOCS)
    shared = stored(lines.join(leaves.select("leaf"), "leaf"), "shared-lines")
    related = shared.drop("total", "leaf", "digest").join(families(shared), "who")
    rows = stored(related.select("doc_id", "body", "at", "n_tokens", "family", F.explode("keys").alias("key")), "templates")
    place = F.struct("doc_id", "body", "at")
    recurring = (
        rows.groupBy("key", "body").agg(F.min("family").alias("family"), F.min(place).alias("first"), F.max("n_tokens").alias("n_tokens"))
        .groupBy("key").agg(F.count("*").alias("bodies"), F.count_distinct("family").alias("families"), F.min("first").alias("first"), F.max("n_tokens").alias("n_tokens"))
        .where((F.col("families") >= MIN_DOCS) & (F.col("families") * F.col("n_tokens") >= MIN_EVIDENCE))
        .select("key", "bodies", "first")
    )
    template = F.max(F.struct("bodies", "first")).alias("template")  # of a line's recurring templates, the most frequent
    chosen = rows.join(recurring, "key").groupBy("doc_id", "body", "at").agg(template)
    gone = chosen.where(~place.eqNullSafe(F.col("template.first")))
    return gone.groupBy("doc_id", "body").agg(F.sort_array(F.collect_list("at")).alias("gone"))


def drop_recurring(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without the repeated lines of recurring templates; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    key, body, gone = fresh("key"), fresh("body"), fresh("gone")
    found = dropped_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias(key), F.col("body").alias(body), F.col("gone").alias(gone))
    marked = docs.join(found, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(body)), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = marked
    if counts:
        out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        out = out.withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.drop(key, body, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_recurring(docs)


_SPACES = "[ \\t\\n\\x0B\\f\\r]+"
_GENERAL = " UNION ALL ".join(
    f"""SELECT doc_id, body, place, n, family, '{k}|' || leaf || '|' || array_to_string(t[4:3 + (n - 3) * {k} // {SEGMENTS}], ' ')
      || '|' || array_to_string(t[4 + (n - 3) * {k + 1} // {SEGMENTS}:], ' ') AS key FROM shared WHERE n >= {MIN_GENERAL}"""
    for k in range(SEGMENTS)
)
ORACLE = f"""
WITH cut AS (SELECT doc_id, text AS body, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
  raw AS (SELECT doc_id, body, i - 1 AS place, parts[i] AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
  tok AS (SELECT *, list_filter(string_split_regex(line, '{_SPACES}'), lambda x: x <> '') AS w FROM raw),
  masked AS (SELECT doc_id, body, place, len(w) AS n, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '{VARIABLE}') THEN '<*>' ELSE x END) AS t FROM tok WHERE len(w) >= {MIN_TOKENS}),
  leafed AS (SELECT *, CAST(n AS VARCHAR) || ' ' || array_to_string(t[1:{DEPTH}], ' ') AS leaf FROM masked),
  totals AS (SELECT doc_id, COUNT(DISTINCT leaf) AS total FROM leafed GROUP BY doc_id),
  common AS (SELECT * FROM leafed WHERE leaf IN (SELECT leaf FROM leafed GROUP BY leaf HAVING COUNT(DISTINCT body) >= {MIN_DOCS})),
  sketched AS (SELECT doc_id, COUNT(DISTINCT leaf) AS n_shared, {", ".join(f"MIN(substr(md5(leaf), {4 * k + 1}, 15)) AS h{k}" for k in range(SKETCH))} FROM common GROUP BY doc_id),
  owned AS (SELECT s.*, total - n_shared AS own, NOT 2 * (total - n_shared) > total - 1 AS near FROM totals t JOIN sketched s USING (doc_id)),
  near AS (SELECT doc_id, own, unnest({list(range(SKETCH))}) AS k, unnest([{", ".join(f"h{k}" for k in range(SKETCH))}]) AS h FROM owned WHERE near),
  led AS (SELECT doc_id, first_value(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY k, h ORDER BY own, CAST(doc_id AS VARCHAR)) AS head FROM near),
  heads AS (SELECT doc_id, MAX((n, head))[2] AS head FROM (SELECT doc_id, head, COUNT(*) AS n FROM led GROUP BY doc_id, head) GROUP BY doc_id),
  shared AS (SELECT c.*, CASE WHEN h.doc_id IS NULL THEN 'b|' || c.body ELSE 'h|' || h.head END AS family FROM common c LEFT JOIN heads h ON h.doc_id = c.doc_id),
  keyed AS (SELECT doc_id, body, place, n, family, 'x|' || leaf || '|' || array_to_string(t[4:], ' ') AS key FROM shared UNION ALL {_GENERAL}),
  once AS (SELECT key, body, MIN(family) AS family, MIN((doc_id, place)) AS earliest, MAX(n) AS n FROM keyed GROUP BY key, body),
  recurring AS (SELECT key, COUNT(*) AS bodies, MIN(earliest) AS earliest FROM once GROUP BY key
    HAVING COUNT(DISTINCT family) >= {MIN_DOCS} AND COUNT(DISTINCT family) * MAX(n) >= {MIN_EVIDENCE}),
  gone AS (SELECT doc_id, place FROM (SELECT doc_id, place, MAX((bodies, earliest)) AS best FROM keyed JOIN recurring USING (key) GROUP BY doc_id, place) WHERE best[2] <> (doc_id, place)),
  kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM raw ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(k.text, '') END AS text,
  CAST(COALESCE(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, (SELECT COUNT(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_dropped
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
