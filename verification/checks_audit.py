"""Hygiene, duplicates, audit composition, cleanup."""

from datetime import datetime

from pyspark.sql import functions as F

from filetide.functions import naming
from filetide.operators import audit, cleanup, dedupe, hygiene
from filetide.plans.audit import AuditOptions, collect_reasons, hygiene_audit

from .registry import ORACLE, add, once, positioned, up

AS_OF = datetime(2004, 6, 1)
DOCS_AS_OF = datetime(2024, 2, 1)
_AS, _DOCS = "TIMESTAMP '2004-06-01'", "TIMESTAMP '2024-02-01'"
_YEAR = 365.25 * 86400


def _age(column, as_of):
    return f"((epoch_us({as_of}) - epoch_us({column})) / 1000000.0)"


def awkward(t):
    """Estate files with long paths and unsafe names made from their own attributes."""
    files = t.estate.where(~F.col("is_dir"))
    n = F.length("name") % 7
    name = (
        F.when(n == 0, F.concat("name", F.lit(" "))).when(n == 1, F.concat("name", F.lit("."))).when(n == 2, F.concat(F.lit("a<b|"), "name"))
        .when(n == 3, F.concat("name", F.lit("\n."))).otherwise(F.col("name"))
    )
    return files.withColumn("name", name).withColumn("path", F.concat(F.repeat(F.lit("x"), F.length("name") * 13), "path"))


ORACLE["awkward"] = """
  SELECT path_key, nm AS name, repeat('x', length(nm) * 13) || path AS path, size FROM (SELECT *, CASE length(name) % 7 WHEN 0 THEN name || ' ' WHEN 1 THEN name || '.'
    WHEN 2 THEN 'a<b|' || name WHEN 3 THEN name || chr(10) || '.' ELSE name END AS nm FROM {estate} WHERE NOT is_dir)"""

add("f4_long_paths", lambda t: hygiene.long_paths(awkward(t)).select("path_key", "detail", "score"),
    "SELECT path_key, length(path) || ' characters (limit 240)' AS detail, 40 AS score FROM {awkward} WHERE length(path) >= 240")
add("f5_bad_names", lambda t: hygiene.bad_names(awkward(t)).select("path_key", "detail", "score"),
    """SELECT path_key, detail, 40 AS score FROM (SELECT path_key, array_to_string(list_filter([CASE WHEN ends_with(name, ' ') THEN 'Trailing space' END,
         CASE WHEN ends_with(name, '.') THEN 'Trailing dot' END, CASE WHEN contains(name, chr(10)) THEN 'Control characters' END,
         CASE WHEN contains(name, '<') THEN 'Invalid on NTFS: < |' END], lambda x: x IS NOT NULL), ' / ') AS detail FROM {awkward}) WHERE detail <> ''""")
add("f6_dormant", lambda t: hygiene.dormant(t.docs, DOCS_AS_OF, 2.0).select("path_key", "score", "detail"),
    f"""SELECT path_key, 70 + CASE WHEN y > 5 THEN 10 ELSE 0 END AS score, 'Modified: ' || strftime(modified_at, '%Y/%m/%d') || ' (' || printf('%.1f', y) || ' years ago)'
         || CASE WHEN {_age('accessed_at', _DOCS)} > {_YEAR} * 2 THEN ' / Accessed: ' || strftime(accessed_at, '%Y/%m/%d') ELSE '' END AS detail FROM (
         SELECT *, {_age('modified_at', _DOCS)} / {_YEAR} AS y FROM {{docs}}) WHERE y > 2
         AND NOT ({_age('accessed_at', _DOCS)} <= {_YEAR} AND {_age('accessed_at', _DOCS)} >= -86400)""")


def _families(table: str, rounds: int = 5) -> str:
    copy, date = r"(\s*-\s*コピー(\s*\(\d+\))?)$", r"([_\s\-\.]\d{4}[._\-]?\d{2}[._\-]?\d{2}|[_\s\-\.]\d{6,8})$"
    version = (r"([_\s\-\.](v\d+(\.\d+)*|ver\d*|rev\d*|修正版?|\d+|最新版?|本当(の最終)?|最終版?|確定版?|提出用?|案\d*"
               r"|fix|draft|old|bak|copy|コピー|\(\d+\)))+$")
    text = "SELECT *, regexp_replace(name, '[.][^.]*$', '') AS b0, regexp_replace(name, '[.][^.]*$', '') AS b, '' AS suf, FALSE AS done FROM {" + table + "}"
    for _ in range(rounds):
        text = f"SELECT *, regexp_extract(b, '(?i){copy}') AS c FROM ({text})"
        text = f"SELECT *, substr(b, 1, length(b) - length(c)) AS x1 FROM ({text})"
        text = f"SELECT *, regexp_extract(x1, '(?i){date}') AS d FROM ({text})"
        text = f"SELECT *, substr(x1, 1, length(x1) - length(d)) AS x2 FROM ({text})"
        text = f"SELECT *, regexp_extract(x2, '(?i){version}') AS v FROM ({text})"
        text = f"SELECT *, rtrim(substr(x2, 1, length(x2) - length(v)), ' _-') AS x3 FROM ({text})"
        pieces = "array_to_string(list_filter([trim(c, ' _-'), trim(d, ' _-'), trim(v, ' _-')], lambda q: q <> ''), ' ')"
        text = (f"SELECT * EXCLUDE (b, suf, done, c, d, v, x1, x2, x3), CASE WHEN done THEN b ELSE x3 END AS b, "
                f"CASE WHEN done OR {pieces} = '' THEN suf ELSE suf || CASE WHEN suf = '' THEN '' ELSE ' ' END || {pieces} END AS suf, "
                f"done OR (c = '' AND d = '' AND v = '') OR x3 = '' AS done FROM ({text})")
    return (f"SELECT *, lower(CASE WHEN b = '' THEN b0 ELSE b END) || ext AS family_key, CASE WHEN b = '' THEN '' ELSE suf END AS suffix FROM ({text})")


ORACLE["families"] = _families("parts")
ORACLE["families_all"] = _families("two_roots")
_RANKED = """
  SELECT *, COUNT(*) OVER w AS n, bool_or(suffix <> '') OVER w AS suffixed, first(path_key) OVER (w ORDER BY modified_at DESC, path_key) AS active,
    first(name) OVER (w ORDER BY modified_at DESC, path_key) AS active_name, first(modified_at) OVER (w ORDER BY modified_at DESC, path_key) AS active_time,
    first(size) OVER (w ORDER BY modified_at DESC, path_key) AS active_size FROM {%s} WINDOW w AS (PARTITION BY parent_key, family_key)"""
ORACLE["ranked_families"] = _RANKED % "families"
ORACLE["ranked_all"] = _RANKED % "families_all"
ORACLE["old_versions"] = """
  SELECT *, LEAST(95, 75 + CASE WHEN suffix <> '' THEN 10 ELSE 0 END + CASE WHEN (epoch_us(TIMESTAMP '2004-06-01') - epoch_us(modified_at)) / 86400000000.0 > 365 THEN 10 ELSE 0 END) AS score,
    'Newer version exists: ' || active_name || ' (' || strftime(active_time, '%Y/%m/%d') || ')' || CASE WHEN suffix <> '' THEN ' / suffix: ' || suffix ELSE '' END AS detail
  FROM {ranked_families} WHERE n >= 2 AND suffixed AND path_key <> active AND NOT (modified_at = active_time AND size = active_size)"""
add("f9_family_key", lambda t: naming.with_family(t.parts).select("path_key", "family_key", "suffix"), "SELECT path_key, family_key, suffix FROM {families}")
add("e1_version_families", lambda t: hygiene.version_families(t.parts, AS_OF).select("path_key", "score", "detail", F.col("related_key").alias("active")),
    "SELECT path_key, score, detail, active FROM {old_versions}")
add("f8_version_scores", lambda t: hygiene.version_families(t.parts, AS_OF).groupBy("score").agg(F.count("*").alias("n")),
    "SELECT score, COUNT(*) AS n FROM {old_versions} GROUP BY ALL")
add("f10_copy_words", lambda t: t.docs.unionByName(t.parts).select("path_key", naming.has_copy_word("name").alias("is_copy")),
    """SELECT path_key, regexp_matches(lower(name), 'コピー|copy|複写|バックアップ|backup|bak|複製|復元|restore|最新|old|new|編集') OR regexp_matches(name, '[(_\\- ][0-9]+[)]') AS is_copy
       FROM (SELECT * FROM {docs} UNION ALL SELECT * FROM {parts})""")
ORACLE["up_estate"] = up("estate")
ORACLE["activity"] = f"""
  SELECT anc AS folder_key, COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes, MAX(modified_at) AS max_write, MAX(accessed_at) AS max_access,
    bool_or({_age('accessed_at', _AS)} <= {_YEAR} AND {_age('accessed_at', _AS)} >= -86400) AS recent_read FROM {{up_estate}} WHERE NOT is_dir GROUP BY ALL"""
add("c2_folder_activity", lambda t: hygiene.folder_activity(t.estate.where(~F.col("is_dir")), AS_OF).select(
    "folder_key", "files", "bytes", F.unix_micros("max_write").alias("max_write"), F.unix_micros("max_access").alias("max_access"), "recent_read"),
    "SELECT folder_key, files, bytes, epoch_us(max_write) AS max_write, epoch_us(max_access) AS max_access, recent_read FROM {activity}")
_SIZE_TEXT = """CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN regexp_replace(printf('%.1f', round_even(b / 1024.0, 1)), '[.]0$', '') || ' KB'
  ELSE regexp_replace(printf('%.1f', round_even(b / 1048576.0, 1)), '[.]0$', '') || ' MB' END"""
add("d2_extracted_archives",
    lambda t: (lambda files: hygiene.extracted_archives(files, hygiene.folder_activity(files, AS_OF)))(t.estate.where(~F.col("is_dir"))).select("path_key", "score", "detail", "related_key"),
    f"""SELECT path_key, 90 AS score, 'Extracted folder "' || base || '/" exists in same folder (' || {_SIZE_TEXT} || ' / ' || format('{{:,}}', files) || ' files)' AS detail, folder_key AS related_key
        FROM (SELECT z.path_key, regexp_replace(z.name, '([.]tar)?[.](zip|xz)$', '') AS base, a.files, a.bytes AS b, a.folder_key FROM {{estate}} z JOIN {{activity}} a
          ON a.folder_key = z.parent_key || '/' || lower(regexp_replace(z.name, '([.]tar)?[.](zip|xz)$', '')) WHERE NOT z.is_dir AND z.ext IN ('.zip', '.xz'))""")
add("f7_graveyards", lambda t: hygiene.graveyards(hygiene.folder_activity(t.estate.where(~F.col("is_dir")), AS_OF), AS_OF).select("path_key", "size", "score"),
    f"""SELECT folder_key AS path_key, bytes AS size, LEAST(95, 80 + CASE WHEN {_age('max_write', _AS)} / {_YEAR} > 5 THEN 5 ELSE 0 END) AS score FROM {{activity}}
        WHERE folder_key <> '/estate' AND files >= 3 AND bytes >= 1048576 AND {_age('max_write', _AS)} > {_YEAR} * 3 AND NOT recent_read""")
add("d3_without_ignored", lambda t: hygiene.without_ignored(t.entries.where(~F.col("is_dir")), t.ignores).groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")),
    """SELECT ext, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes FROM {entries} e WHERE NOT is_dir AND NOT EXISTS (
         SELECT 1 FROM {ignores} i WHERE i.path_key = e.path_key AND i.size = e.size AND i.modified_at = e.modified_at) GROUP BY ALL""")
add("d3_void_marks", lambda t: hygiene.void_ignores(t.ignores, t.entries).select("path_key", "size"),
    "SELECT i.path_key, i.size FROM {ignores} i JOIN {entries} e USING (path_key) WHERE i.size <> e.size OR i.modified_at <> e.modified_at")

# --- duplicates -----------------------------------------------------------------

SMALL = {"sample_from": 512, "prefix_from": 1024}


@once
def copies(t):
    return dedupe.grouped(dedupe.confirmed(dedupe.size_groups(t.docs, 1), t.file_content, **SMALL))


_COPY = "regexp_matches(lower(name), 'コピー|copy|複写|バックアップ|backup|bak|複製|復元|restore|最新|old|new|編集') OR regexp_matches(name, '[(_\\- ][0-9]+[)]')"
ORACLE["dup_files"] = f"""
  SELECT *, row_number() OVER (w ORDER BY is_copy, depth, length(path), created_at, modified_at, path_key) AS pick,
    CASE WHEN physical_id IS NOT NULL THEN row_number() OVER (PARTITION BY size, sha, physical_id ORDER BY is_copy, depth, length(path), created_at, modified_at, path_key) ELSE 1 END AS nth
  FROM (SELECT d.*, sha256(f.text) AS sha, {_COPY} AS is_copy, len(string_split(d.path_key, '/')) - 1 AS depth, COUNT(*) OVER (PARTITION BY size, sha256(f.text)) AS copies
    FROM {{docs}} d JOIN {{file_text}} f USING (path_key)) WHERE copies > 1 WINDOW w AS (PARTITION BY size, sha)"""
ORACLE["dup_numbered"] = "SELECT *, dense_rank() OVER (ORDER BY size DESC, sha) AS group_index, pick = 1 AS is_original, nth > 1 AS is_alias FROM {dup_files}"
add("c7_size_groups", lambda t: dedupe.size_groups(t.estate.unionByName(t.docs), 1).groupBy("root_key", "size").agg(F.count("*").alias("n")),
    "SELECT root_key, size, COUNT(*) AS n FROM (SELECT * FROM {estate} UNION ALL SELECT * FROM {docs}) WHERE NOT is_dir AND size >= 1 GROUP BY ALL HAVING COUNT(*) > 1")
add("c8_sampled_stage",
    lambda t: dedupe.sampled(dedupe.size_groups(t.docs, 1), t.file_content, **SMALL).groupBy("size").agg(F.count("*").alias("n")).where(F.col("size") >= 512).select("size", "n"),
    "SELECT size, COUNT(*) AS n FROM {dup_files} WHERE size >= 512 AND copies > 1 GROUP BY ALL")
add("c8_confirmed_duplicates", lambda t: dedupe.confirmed(dedupe.size_groups(t.docs, 1), t.file_content, **SMALL).select("path_key", "size", "sha256"),
    "SELECT path_key, size, sha AS sha256 FROM {dup_files}")
add("c8_network_rule", lambda t: dedupe.confirmed(dedupe.size_groups(t.docs, 100), t.file_content, network=True).select("path_key", "sha256"),
    "SELECT path_key, sha AS sha256 FROM {dup_files} WHERE size >= 100")
# One file of each size group without content: its sample is unknown, so the group stays whole.
add("c9_failed_sample_keeps_group",
    lambda t: (lambda groups: dedupe.narrow(dedupe.hashed(groups, t.file_content.join(
        groups.groupBy("size").agg(F.min("path_key").alias("path_key")), "path_key", "left_anti"), dedupe.head_tail(F.col("content"))),
        ["root_key", "snapshot_id", "size"]))(dedupe.size_groups(t.docs, 1)).select("path_key", "size"),
    "SELECT path_key, size FROM (SELECT *, COUNT(*) OVER (PARTITION BY size) AS n FROM {docs}) WHERE n > 1")
add("c10_changed_length_has_no_hash",
    lambda t: dedupe.hashed(t.docs.withColumn("size", F.when(F.length("name") % 2 == 0, F.col("size") + 1).otherwise(F.col("size"))), t.file_content,
                            F.sha2(F.col("content"), 256)).select("path_key", "hash"),
    "SELECT d.path_key, CASE WHEN length(d.name) % 2 <> 0 THEN sha256(f.text) END AS hash FROM {docs} d JOIN {file_text} f USING (path_key)")
add("c11_duplicate_totals", lambda t: dedupe.totals(copies(t)).select("duplicate_count", "wasted_bytes"),
    "SELECT COUNT(*) FILTER (WHERE NOT is_original) AS duplicate_count, CAST(SUM(CASE WHEN NOT is_original AND NOT is_alias THEN size ELSE 0 END) AS BIGINT) AS wasted_bytes FROM {dup_numbered}")
add("e2_original_pick", lambda t: copies(t).select("path_key", "is_original", "original_key"),
    "SELECT path_key, is_original, first(path_key) OVER (PARTITION BY size, sha ORDER BY pick) AS original_key FROM {dup_numbered}")
add("e3_group_numbers", lambda t: copies(t).select("path_key", "group_id", "group_index"),
    "SELECT path_key, printf('DUP-%04d', group_index) AS group_id, group_index FROM {dup_numbered}")
add("e4_hardlink_aliases", lambda t: copies(t).select("path_key", "is_alias"), "SELECT path_key, is_alias FROM {dup_numbered}")

# --- composition -----------------------------------------------------------------

OPTIONS = AuditOptions(dormant_years=2.0, min_file_size=1, sample_from=512)


def _no_ignores(t):
    return t.docs.where(F.length("name") % 9 == 0).select("path_key", "size", "modified_at")


@once
def reasons(t):
    """Documents (duplicates, dormant) and parts (older versions) in one audit."""
    return collect_reasons(t.docs.unionByName(t.parts), t.file_content, _no_ignores(t), DOCS_AS_OF, OPTIONS)


def candidates(t):
    return audit.combine(reasons(t))


ORACLE["kept_marks"] = "SELECT path_key FROM {docs} WHERE length(name) % 9 = 0"
ORACLE["versions_all"] = "SELECT *, LEAST(95, 75 + CASE WHEN suffix <> '' THEN 10 ELSE 0 END + CASE WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(modified_at)) / 86400000000.0 > 365 THEN 10 ELSE 0 END) AS pts FROM {ranked_all} WHERE n >= 2 AND suffixed AND path_key <> active AND NOT (modified_at = active_time AND size = active_size)"
_DORMANT = f"""SELECT *, 70 + CASE WHEN {_age('modified_at', _DOCS)} / {_YEAR} > 5 THEN 10 ELSE 0 END AS pts FROM {{two_roots}} b
  WHERE {_age('modified_at', _DOCS)} / {_YEAR} > 2 AND NOT ({_age('accessed_at', _DOCS)} <= {_YEAR} AND {_age('accessed_at', _DOCS)} >= -86400)
    AND path_key NOT IN (SELECT path_key FROM {{kept_marks}})"""
ORACLE["two_roots"] = "SELECT * FROM {docs} UNION ALL SELECT * FROM {parts}"
ORACLE["all_reasons"] = f"""
  SELECT root_key, path_key, size, 'Dormant' AS issue, 3 AS tie, pts, FALSE AS orig, FALSE AS alias, FALSE AS ign FROM ({_DORMANT})
  UNION ALL SELECT root_key, path_key, size, 'VersionFamily', 4, pts, FALSE, FALSE, FALSE FROM {{versions_all}} WHERE path_key NOT IN (SELECT path_key FROM {{kept_marks}})
  UNION ALL SELECT '/parts', folder, bytes, 'GraveyardTree', 6, pts, FALSE, FALSE, FALSE FROM {{grave_parts}}
  UNION ALL SELECT root_key, path_key, size, 'Duplicate', 0, CASE WHEN is_original OR is_alias THEN 0 ELSE 95 END, is_original, is_alias,
    path_key IN (SELECT path_key FROM {{kept_marks}}) FROM {{dup_numbered}}"""
ORACLE["grave_parts"] = f"""
  SELECT folder, bytes, LEAST(95, 80 + CASE WHEN {_age('max_write', _DOCS)} / {_YEAR} > 5 THEN 5 ELSE 0 END) AS pts FROM (
    SELECT folder, COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes, MAX(modified_at) AS max_write,
      bool_or({_age('accessed_at', _DOCS)} <= {_YEAR} AND {_age('accessed_at', _DOCS)} >= -86400) AS recent FROM (
      SELECT *, parent_key AS folder FROM {{two_roots}} UNION ALL SELECT *, regexp_replace(parent_key, '/[^/]*$', '') AS folder FROM {{two_roots}} WHERE len(string_split(parent_key, '/')) = 4)
    GROUP BY folder) WHERE files >= 3 AND bytes >= 1048576 AND {_age('max_write', _DOCS)} / {_YEAR} > 2 AND NOT recent"""
ORACLE["combined"] = """
  SELECT path_key, MAX(size) AS size, CAST(SUM(pts) AS INT) AS score, arg_min(issue, CASE WHEN issue = 'Duplicate' THEN -1000000 ELSE -pts * 10 + tie END) AS issue_type,
    array_to_string(list(issue ORDER BY CASE WHEN issue = 'Duplicate' THEN -1000000 ELSE -pts * 10 + tie END), ',') AS issues,
    bool_or(orig) AS is_original, bool_or(alias) AS is_alias, bool_or(ign) AS is_ignored FROM {all_reasons} GROUP BY path_key"""
ORACLE["flagged"] = """SELECT *, NOT contains(issues, 'GraveyardTree') AND NOT is_original AS can_clean, CASE WHEN is_alias THEN 0 ELSE size END AS reclaim FROM {combined}"""
add("c12_combine_reasons", lambda t: candidates(t).select(
    "path_key", "size", "score", "issue_type", F.array_join("issue_types", ",").alias("issues"), "is_original", "is_alias", "is_ignored"),
    "SELECT * FROM {combined}")
add("u2_union_of_reasons", lambda t: reasons(t).groupBy("issue_type").agg(F.count("*").alias("n"), F.sum("score").alias("points")),
    "SELECT issue AS issue_type, COUNT(*) AS n, CAST(SUM(pts) AS BIGINT) AS points FROM {all_reasons} GROUP BY ALL")
add("c13_audit_summary",
    lambda t: hygiene_audit(t.docs.unionByName(t.parts), t.file_content, _no_ignores(t), t.scan_errors, DOCS_AS_OF, OPTIONS)["summary"].groupBy().agg(
        *[F.sum(c).alias(c) for c in ("files_scanned", "Duplicate_count", "Duplicate_bytes", "Dormant_count", "VersionFamily_count", "VersionFamily_bytes", "GraveyardTree_count", "ready_bytes")]),
    """SELECT (SELECT COUNT(*) FROM {two_roots}) AS files_scanned, COUNT(*) FILTER (WHERE issue = 'Duplicate' AND NOT orig) AS Duplicate_count,
         CAST(SUM(CASE WHEN issue = 'Duplicate' AND NOT orig AND NOT alias THEN size ELSE 0 END) AS BIGINT) AS Duplicate_bytes,
         COUNT(*) FILTER (WHERE issue = 'Dormant') AS Dormant_count, COUNT(*) FILTER (WHERE issue = 'VersionFamily') AS VersionFamily_count,
         CAST(SUM(CASE WHEN issue = 'VersionFamily' THEN size ELSE 0 END) AS BIGINT) AS VersionFamily_bytes, COUNT(*) FILTER (WHERE issue = 'GraveyardTree') AS GraveyardTree_count,
         (SELECT CAST(SUM(reclaim) AS BIGINT) FROM {flagged} WHERE can_clean AND NOT is_ignored AND regexp_matches(issues, 'Duplicate|VersionFamily|ExtractedArchive')) AS ready_bytes FROM {all_reasons}""")
add("c14_ready_bytes", lambda t: audit.ready_bytes(candidates(t)).agg(F.sum("ready_bytes").alias("ready_bytes")),
    "SELECT CAST(SUM(reclaim) AS BIGINT) AS ready_bytes FROM {flagged} WHERE can_clean AND NOT is_ignored AND regexp_matches(issues, 'Duplicate|VersionFamily|ExtractedArchive')")
add("c15_totals_after_removal",
    lambda t: audit.totals_of_candidates(candidates(t).where(F.col("score") < 165)).agg(
        F.sum("Duplicate_count").alias("dup"), F.sum("Duplicate_bytes").alias("dup_bytes"), F.sum("Dormant_count").alias("dormant"), F.sum("Dormant_bytes").alias("dormant_bytes")),
    """SELECT COUNT(*) FILTER (WHERE contains(issues, 'Duplicate') AND NOT is_original) AS dup,
         CAST(SUM(CASE WHEN contains(issues, 'Duplicate') AND NOT is_original AND NOT is_alias THEN size ELSE 0 END) AS BIGINT) AS dup_bytes,
         COUNT(*) FILTER (WHERE contains(issues, 'Dormant')) AS dormant, CAST(SUM(CASE WHEN contains(issues, 'Dormant') THEN size ELSE 0 END) AS BIGINT) AS dormant_bytes
       FROM {combined} WHERE score < 165""")
add("c16_selection_totals", lambda t: audit.selection_totals(reasons(t)),
    "SELECT COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes FROM {combined}")
add("f11_confidence", lambda t: audit.with_flags(candidates(t)).groupBy("confidence").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN is_original THEN 'Protected' WHEN score >= 80 THEN 'Recommended' WHEN score >= 50 THEN 'Review Needed' ELSE 'Reference' END AS confidence, COUNT(*) AS n
       FROM {combined} GROUP BY ALL""")
add("f12_cleanable", lambda t: audit.with_flags(candidates(t)).select("path_key", "is_cleanable", "reclaimable_bytes"),
    "SELECT path_key, can_clean AS is_cleanable, reclaim AS reclaimable_bytes FROM {flagged}")
_CATEGORY = {
    "ReadyToClean": "score >= 80 AND can_clean AND regexp_matches(issues, 'Duplicate|Dormant|VersionFamily|ExtractedArchive')",
    "ReviewAdvised": "score >= 50 AND score < 80 AND can_clean", "Duplicate": "contains(issues, 'Duplicate')", "Dormant": "contains(issues, 'Dormant')",
    "VersionFamily": "contains(issues, 'VersionFamily')", "All": "TRUE",
}
add("b21_category_filters",
    lambda t: (lambda c: c.agg(*[F.count_if(audit.category_filter(name)).alias(name) for name in _CATEGORY]))(candidates(t)),
    "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE NOT is_ignored AND {sql}) AS {name}" for name, sql in _CATEGORY.items()) + " FROM {flagged}")
add("b22_text_filter", lambda t: candidates(t).where(audit.text_filter("コピー")).select("path_key"),
    """SELECT path_key FROM {combined} c WHERE NOT is_ignored AND (contains(path_key, 'コピー') OR EXISTS (
         SELECT 1 FROM {versions_all} v WHERE v.path_key = c.path_key AND (contains(v.active_name, 'コピー') OR contains(v.suffix, 'コピー'))))""")
_ORDER = {
    "Default": ("Default", False, "can_clean DESC, score DESC, size DESC, lower(name), path_key"),
    "Size": ("Size", True, "size DESC, g, is_original DESC, lower(name), path_key"),
    "FileName": ("FileName", False, "lower(name), g, is_original DESC, path_key"),
    "LastWriteTime": ("LastWriteTime", True, "modified_at DESC, g, is_original DESC, path_key"),
    "DuplicateGroupIndex": ("DuplicateGroupIndex", False, "g, is_original DESC, path_key"),
    "FullPath": ("FullPath", True, "path_key DESC"),
    "IssueType": ("IssueType", False, "ty, g, is_original DESC, path_key"),
}
ORACLE["orderable"] = """
  SELECT f.*, COALESCE(b.name, string_split(f.path_key, '/')[-1] || '/') AS name,
    COALESCE(b.modified_at, (SELECT MAX(x.modified_at) FROM {two_roots} x WHERE starts_with(x.path_key, f.path_key || '/'))) AS modified_at, COALESCE(d.group_index, 2147483647) AS g,
    list_position(['PathTooLong', 'InvalidChar', 'Dormant', 'VersionFamily', 'ExtractedArchive', 'GraveyardTree', 'Duplicate'], issue_type) AS ty
  FROM {flagged} f LEFT JOIN {two_roots} b USING (path_key) LEFT JOIN {dup_numbered} d USING (path_key)"""
for _key, (_name, _desc, _sql) in _ORDER.items():
    add(f"k5_order_{_key.lower()}", lambda t, n=_name, d=_desc: positioned(audit.sort(candidates(t), n, d), "path_key"),
        f"SELECT path_key, row_number() OVER (ORDER BY {_sql}) AS position FROM {{orderable}}")
add("k6_shown_rows", lambda t: audit.shown(candidates(t), 300)[0].select("path_key"),
    "SELECT path_key FROM {orderable} ORDER BY can_clean DESC, score DESC, size DESC, lower(name), path_key LIMIT 300")
add("k6_matched_count", lambda t: audit.shown(candidates(t), 300)[1], "SELECT COUNT(*) AS matched FROM {combined}")
add("k7_early_candidates",
    lambda t: audit.early_candidates(reasons(t).where(F.col("issue_type") != "Duplicate"), dedupe.size_groups(t.docs, 1), 300).select("path_key", "score"),
    """SELECT path_key, score FROM (SELECT *, row_number() OVER (PARTITION BY root_key ORDER BY size DESC, path_key) AS rn FROM (
         SELECT root_key, path_key, MAX(size) AS size, CAST(SUM(pts) AS INT) AS score FROM {all_reasons} WHERE issue <> 'Duplicate' AND path_key NOT IN (
           SELECT path_key FROM (SELECT *, COUNT(*) OVER (PARTITION BY size) AS n FROM {docs} WHERE size >= 1) WHERE n > 1) GROUP BY ALL)) WHERE rn <= 300""")
add("j3_hygiene_audit",
    lambda t: hygiene_audit(t.docs.unionByName(t.parts), t.file_content, _no_ignores(t), t.scan_errors, DOCS_AS_OF, OPTIONS)["candidates"].select(
        "path_key", "score", "is_cleanable", "reclaimable_bytes", F.size("breakdown").alias("factors")),
    """SELECT path_key, score, can_clean AS is_cleanable, reclaim AS reclaimable_bytes, factors FROM {flagged} JOIN (
         SELECT path_key, CAST(SUM(CASE issue WHEN 'Dormant' THEN CASE WHEN pts = 80 THEN 3 ELSE 2 END WHEN 'GraveyardTree' THEN CASE WHEN pts = 85 THEN 2 ELSE 1 END
           WHEN 'VersionFamily' THEN 1 + CAST(suff AS INT) + CAST(stale AS INT) ELSE 1 END) AS INT) AS factors
         FROM (SELECT r.*, COALESCE(v.suffix <> '', FALSE) AS suff, COALESCE((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(v.modified_at)) / 86400000000.0 > 365, FALSE) AS stale FROM {all_reasons} r LEFT JOIN {versions_all} v USING (path_key)) GROUP BY ALL) USING (path_key)""")

# --- cleanup ----------------------------------------------------------------------


def planned(t):
    c = candidates(t)
    return cleanup.plan(c, c.where(F.length("path_key") % 2 == 0))


def newer(t):
    """A later inventory: some files gone, some grown, some touched, hashes known."""
    n = F.length("name")
    later = t.docs.unionByName(t.parts).join(t.file_content.select("path_key", F.sha2("content", 256).alias("_sha")), "path_key", "left")
    later = later.withColumn("size", F.when(n % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    later = later.withColumn("modified_at", F.when(n % 13 == 0, F.col("modified_at") + F.expr("INTERVAL 3 SECONDS")).otherwise(F.col("modified_at")))
    return later.withColumn("sha256", F.when(F.col("size") % 17 != 0, F.col("_sha"))).where(F.col("size") % 19 != 0)


ORACLE["later"] = """
  SELECT *, CASE WHEN size % 17 <> 0 THEN sha END AS sha2 FROM (SELECT b.path_key, b.physical_id, sha256(f.text) AS sha, CASE WHEN length(name) % 11 = 0 THEN size + 1 ELSE size END AS size,
    CASE WHEN length(name) % 13 = 0 THEN modified_at + INTERVAL 3 SECOND ELSE modified_at END AS modified_at FROM {two_roots} b LEFT JOIN {file_text} f USING (path_key)) WHERE size % 19 <> 0"""
ORACLE["plan_rows"] = """
  SELECT f.path_key, f.size, b.modified_at, o.path_key AS original_key, o.size AS original_size, o.modified_at AS original_modified
  FROM {flagged} f LEFT JOIN {two_roots} b USING (path_key) LEFT JOIN {dup_numbered} d USING (path_key)
    LEFT JOIN (SELECT * FROM {dup_numbered} WHERE is_original) o ON o.group_index = d.group_index
  WHERE can_clean AND length(f.path_key) % 2 = 0"""
ORACLE["rechecked"] = """
  SELECT p.path_key, p.size, CASE WHEN t.size IS NULL THEN 'TargetMissing' WHEN p.original_key IS NOT NULL AND o.size IS NULL THEN 'OriginalMissing'
      WHEN p.original_key IS NOT NULL AND o.size <> p.original_size THEN 'OriginalSizeChanged'
      WHEN p.original_key IS NOT NULL AND abs(epoch_us(o.modified_at) - epoch_us(p.original_modified)) > 2000000 THEN 'OriginalTimeChanged'
      WHEN p.original_key IS NOT NULL AND t.physical_id = o.physical_id THEN 'SamePhysicalFile'
      WHEN p.original_key IS NOT NULL AND NOT COALESCE(t.sha2 = o.sha2, FALSE) THEN 'HashMismatch'
      WHEN t.size <> p.size OR abs(epoch_us(t.modified_at) - epoch_us(p.modified_at)) > 2000000 THEN 'TargetChanged' END AS reject_reason
  FROM {plan_rows} p LEFT JOIN {later} t USING (path_key) LEFT JOIN {later} o ON o.path_key = p.original_key"""
add("d4_cleanup_plan", lambda t: planned(t).select("path_key", "original_key", "original_size"), "SELECT path_key, original_key, original_size FROM {plan_rows}")
add("d19_revalidation", lambda t: cleanup.revalidate(planned(t), newer(t)).select("path_key", "reject_reason"), "SELECT path_key, reject_reason FROM {rechecked}")
add("j4_cleanup_outcome", lambda t: cleanup.revalidation_totals(cleanup.revalidate(planned(t), newer(t))),
    "SELECT COALESCE(reject_reason, 'Accepted') AS outcome, COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes FROM {rechecked} GROUP BY ALL")
