"""Migration, links, media, texts, readers and streams."""


from pyspark.sql import functions as F

from filetide.functions import markup
from filetide.operators import links, media, migrate, search, text, tree
from filetide.plans.migration import plan_waves, transfer_check
from filetide.plans.repair import link_repair_plan, media_report
from filetide.session import cut_lineage, scratch_path
from filetide.sources import inventory, reports
from filetide.streaming import alerts, history as stream_history

from .checks_audit import candidates
from .checks_tree import STAMP, text_time
from .registry import ORACLE, add, once, positioned

TARGET = "/target"
BUDGET = 60_000_000_000

# --- design and waves ----------------------------------------------------------------


@once
def totals(t):
    return migrate.recursive_totals(t.plan_nodes)


@once
def paths(t):
    return migrate.with_paths(t.plan_nodes)


def pieces(t, policy):
    return migrate.assign_waves(migrate.units(t.plan_nodes, totals(t), t.plan_sources, policy), policy, BUDGET)


def waved(t):
    return migrate.node_waves(paths(t), pieces(t, migrate.TOP_LEVEL))


@once
def copy(t):
    return migrate.copy_units(waved(t), t.plan_sources, TARGET)


ORACLE["nation_sums"] = """
  SELECT n.plan_id, n.node_id, n.parent_id, n.ord, n.name, GREATEST(COALESCE(n.est_size, 0), COALESCE(c.s, 0)) AS total_size,
    CASE WHEN n.est_files IS NULL THEN c.f ELSE GREATEST(n.est_files, COALESCE(c.f, 0)) END AS total_files
  FROM {plan_nodes} n LEFT JOIN (SELECT parent_id, CAST(SUM(est_size) AS BIGINT) AS s, CAST(SUM(est_files) AS BIGINT) AS f FROM {plan_nodes} WHERE level = 2 GROUP BY ALL) c ON c.parent_id = n.node_id WHERE n.level = 1"""
ORACLE["plan_totals"] = """
  SELECT plan_id, node_id, est_size AS total_size, est_files AS total_files FROM {plan_nodes} WHERE level = 2
  UNION ALL SELECT plan_id, node_id, total_size, total_files FROM {nation_sums}
  UNION ALL SELECT r.plan_id, r.node_id, GREATEST(r.est_size, CAST(SUM(n.total_size) AS BIGINT)), CAST(SUM(n.total_files) AS BIGINT) FROM {plan_nodes} r JOIN {nation_sums} n ON n.parent_id = r.node_id
    WHERE r.level = 0 GROUP BY r.plan_id, r.node_id, r.est_size"""
ORACLE["plan_units"] = """
  SELECT plan_id, node_id AS unit_id, ord AS unit_ord, name, total_size AS size, total_files AS files FROM {nation_sums}
  UNION ALL SELECT r.plan_id, r.node_id, -1, r.name, GREATEST(0, r.est_size - CAST(SUM(n.total_size) AS BIGINT)), NULL FROM {plan_nodes} r JOIN {nation_sums} n ON n.parent_id = r.node_id
    WHERE r.level = 0 GROUP BY r.plan_id, r.node_id, r.name, r.est_size"""
ORACLE["plan_waved"] = "SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY unit_ord) AS wave FROM {plan_units}"
ORACLE["plan_paths"] = """
  SELECT c.plan_id, c.node_id, c.name, c.level, c.est_size, r.name || '/' || n.name || '/' || c.name AS rel_path, n.node_id AS unit_id FROM {plan_nodes} c JOIN {plan_nodes} n ON n.node_id = c.parent_id
    JOIN {plan_nodes} r ON r.node_id = n.parent_id WHERE c.level = 2
  UNION ALL SELECT n.plan_id, n.node_id, n.name, n.level, n.est_size, r.name || '/' || n.name, n.node_id FROM {plan_nodes} n JOIN {plan_nodes} r ON r.node_id = n.parent_id WHERE n.level = 1
  UNION ALL SELECT plan_id, node_id, name, level, est_size, name, node_id FROM {plan_nodes} WHERE level = 0"""
ORACLE["plan_copy"] = """
  SELECT p.plan_id, w.wave, lower(s.source_path) AS source_key, lower('/target/' || p.rel_path) AS destination_key FROM {plan_paths} p JOIN {plan_sources} s USING (plan_id, node_id)
    JOIN {plan_waved} w ON w.plan_id = p.plan_id AND w.unit_id = p.unit_id"""
add("c19_recursive_totals", lambda t: totals(t).select("plan_id", "node_id", "total_size", "total_files"), "SELECT * FROM {plan_totals}")
add("e9_next_fit_waves", lambda t: pieces(t, migrate.BUDGET).select("plan_id", "unit_id", "wave"),
    f"""SELECT plan_id, unit_id, wave FROM budget_walk""".replace("budget_walk", "{budget_walk}"))
ORACLE["numbered_units"] = "SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY unit_ord) AS i FROM {plan_units}"
ORACLE["budget_walk"] = f"""
  SELECT plan_id, unit_id, i, 1 AS wave, size AS filled FROM {{numbered_units}} WHERE i = 1
  UNION ALL SELECT u.plan_id, u.unit_id, u.i, CASE WHEN b.filled + u.size > {BUDGET} THEN b.wave + 1 ELSE b.wave END,
    CASE WHEN b.filled + u.size > {BUDGET} THEN u.size ELSE b.filled + u.size END FROM budget_walk b JOIN {{numbered_units}} u ON u.plan_id = b.plan_id AND u.i = b.i + 1"""
_SECONDS = "GREATEST(5, CAST(floor(SUM(size) * {} / 52428800) AS BIGINT))"
ORACLE["plan_waves"] = f"""
  SELECT plan_id, wave, CAST(SUM(size) AS BIGINT) AS bytes, CAST(SUM(files) AS BIGINT) AS files, {_SECONDS.format('1.0')} AS full_seconds, {_SECONDS.format('0.05')} AS cutover_seconds,
    'Wave ' || wave || ': ' || MIN(name) AS wave_name FROM {{plan_waved}} GROUP BY plan_id, wave"""
add("c20_wave_totals", lambda t: migrate.wave_totals(pieces(t, migrate.TOP_LEVEL), waved(t), t.plan_sources).select(
    "plan_id", "wave", "bytes", "files", "full_seconds", "cutover_seconds", "wave_name", "source_count"),
    """SELECT w.*, COALESCE(s.source_count, 0) AS source_count FROM {plan_waves} w LEFT JOIN (SELECT plan_id, wave, COUNT(DISTINCT source_key) AS source_count FROM {plan_copy} GROUP BY ALL) s USING (plan_id, wave)""")
add("c21_all_wave_totals", lambda t: migrate.all_wave_totals(migrate.wave_totals(pieces(t, migrate.TOP_LEVEL), waved(t), t.plan_sources)).select("plan_id", "wave", "bytes", "full_seconds"),
    "SELECT plan_id, wave, CAST(SUM(bytes) AS BIGINT) AS bytes, CAST(SUM(full_seconds) AS BIGINT) AS full_seconds FROM {plan_waves} GROUP BY ROLLUP (plan_id, wave)")
add("f27_wave_warnings", lambda t: migrate.wave_totals(pieces(t, migrate.TOP_LEVEL), waved(t), t.plan_sources, rate_mbps=0.5).groupBy("many_files", "over_48h").agg(F.count("*").alias("n")),
    """SELECT COALESCE(files > 100000, FALSE) AS many_files, GREATEST(5, CAST(floor(bytes / 1048576.0) AS BIGINT)) > 172800 AS over_48h, COUNT(*) AS n FROM {plan_waves} GROUP BY ALL""")


def all_policies(t):
    """Waves of every policy."""
    made = [
        plan_waves(t.plan_nodes, t.plan_sources, TARGET, policy, BUDGET)["waves"].select(F.lit(policy).alias("policy"), "plan_id", "wave", "bytes", "unit_count")
        for policy in (migrate.SINGLE, migrate.TOP_LEVEL, migrate.BUDGET)
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


add("j8_plan_waves", all_policies,
    """SELECT 'SingleBatch' AS policy, p.plan_id, 1 AS wave, total_size AS bytes, 1 AS unit_count FROM {plan_totals} p JOIN {plan_nodes} n USING (plan_id, node_id) WHERE n.level = 0
       UNION ALL SELECT 'ByTopLevelFolder', plan_id, wave, CAST(SUM(size) AS BIGINT), COUNT(*) FROM {plan_waved} GROUP BY plan_id, wave
       UNION ALL SELECT 'BySizeBudget', b.plan_id, b.wave, CAST(SUM(u.size) AS BIGINT), COUNT(*) FROM {budget_walk} b JOIN {plan_units} u USING (plan_id, unit_id) GROUP BY b.plan_id, b.wave""")
add("u5_distinct_copy_units", lambda t: copy(t).select("plan_id", "wave", "source_key", "destination_key"), "SELECT * FROM {plan_copy}")
add("d14_nested_sources", lambda t: migrate.exclusions(copy(t)),
    """SELECT DISTINCT a.plan_id, a.source_key, b.source_key AS excluded_key FROM {plan_copy} a JOIN {plan_copy} b ON b.plan_id = a.plan_id AND starts_with(b.source_key, a.source_key || '/')""")
_OVER = "SELECT plan_id, source_key, CASE WHEN contains(source_key, 'archive') THEN source_key || '/x' ELSE destination_key END AS destination_key FROM {plan_copy}"
add("d15_overlaps", lambda t: migrate.overlaps(copy(t).withColumn("destination_key", F.when(F.contains("source_key", F.lit("archive")), F.concat("source_key", F.lit("/x"))).otherwise(F.col("destination_key")))),
    f"SELECT DISTINCT plan_id, source_key, destination_key FROM ({_OVER}) WHERE starts_with(destination_key, source_key || '/')")
add("f28_bad_folder_names", lambda t: migrate.bad_folder_names(t.plan_nodes.withColumn("name", F.when(F.col("ord") % 10 == 3, F.concat("name", F.lit("?"))).otherwise(F.col("name")))).select("plan_id", "node_id"),
    "SELECT plan_id, node_id FROM {plan_nodes} WHERE ord % 10 = 3")
add("u4_planned_directories", lambda t: migrate.planned_directories(paths(t), TARGET), "SELECT DISTINCT plan_id, lower('/target/' || rel_path) AS directory FROM {plan_paths}")
add("d23_skeleton", lambda t: migrate.skeleton(paths(t), TARGET, t.target_entries).groupBy("plan_id", "exists").agg(F.count("*").alias("n")),
    """SELECT plan_id, COALESCE(e.path_key IS NOT NULL, FALSE) AS exists, COUNT(*) AS n FROM {plan_paths} p LEFT JOIN (SELECT DISTINCT path_key FROM {target_entries} WHERE is_dir) e
       ON e.path_key = lower('/target/' || rel_path) GROUP BY ALL""")
add("f26_design_diff", lambda t: migrate.design_diff(paths(t), t.plan_sources).select("plan_id", "node_id", "kind", "source_count"),
    """SELECT plan_id, node_id, CASE WHEN n > 1 THEN 'Consolidation' WHEN n = 0 THEN 'NewFolder' WHEN level > 1 THEN 'Relocation' ELSE 'Preserved' END AS kind, n AS source_count FROM (
         SELECT p.plan_id, p.node_id, p.level, COUNT(s.source_path) AS n FROM {plan_paths} p LEFT JOIN {plan_sources} s USING (plan_id, node_id) GROUP BY ALL)""")
add("f26_design_acl_changes", lambda t: migrate.design_acl_changes(t.plan_nodes, t.plan_aces).groupBy("plan_id", F.substring_index("change", " ", 1).alias("what")).agg(F.count("*").alias("n")),
    """SELECT n.plan_id, CASE WHEN a.account IS NOT NULL THEN 'Grant' WHEN n.inherit_acl THEN 'Inherit' ELSE 'Explicit' END AS what, COUNT(*) AS n FROM {plan_nodes} n
       LEFT JOIN {plan_aces} a USING (plan_id, node_id) GROUP BY ALL""")
add("j13_design_from_tree", lambda t: migrate.design_from_tree(tree.rollup(t.entries), 4)[0].select("node_id", "parent_id", "level", "est_size", "est_files"),
    """SELECT folder_key AS node_id, CASE WHEN folder_key <> '/estate' THEN regexp_replace(folder_key, '/[^/]*$', '') END AS parent_id, len(string_split(folder_key, '/')) - 2 AS level,
         bytes AS est_size, files AS est_files FROM {rolled} WHERE len(string_split(folder_key, '/')) - 2 < 4""")
add("j13_design_aces", lambda t: (lambda pair: migrate.design_aces(pair[0], pair[1], t.aces))(migrate.design_from_tree(tree.rollup(t.entries), 4)).groupBy("account").agg(F.count("*").alias("n")),
    """SELECT a.account, COUNT(*) AS n FROM {rolled} r LEFT JOIN {aces} a ON a.path_key = r.folder_key WHERE len(string_split(folder_key, '/')) - 2 < 4 GROUP BY ALL""")

# --- transfer -----------------------------------------------------------------------------


def expected(t):
    """Not written: each query takes other columns of it."""
    return migrate.expected_items(t.estate, copy(t))


ORACLE["exp_owner"] = """
  SELECT e.path_key, e.is_dir, e.size, e.modified_at, c.* FROM (SELECT u.path_key, MAX(u.anc) AS owner FROM {up_estate} u WHERE u.anc IN (SELECT source_key FROM {plan_copy}) GROUP BY ALL) o
    JOIN {estate} e ON e.path_key = o.path_key JOIN {plan_copy} c ON c.source_key = o.owner WHERE e.path_key NOT IN (SELECT source_key FROM {plan_copy})"""
ORACLE["exp_items"] = """
  SELECT plan_id, wave, destination_key || substr(path_key, length(source_key) + 1) AS target_key, is_dir, CASE WHEN NOT is_dir THEN size END AS size, path_key AS source_path FROM {exp_owner}
  UNION ALL SELECT DISTINCT plan_id, wave, destination_key, TRUE, NULL, NULL FROM {plan_copy}"""
add("d16_expected_union", lambda t: expected(t).select("plan_id", "wave", "target_key", "is_dir", "size"), "SELECT plan_id, wave, target_key, is_dir, size FROM {exp_items}")
ORACLE["up_target"] = "SELECT e.*, unnest(list_transform(range(2, len(string_split(path_key, '/'))), lambda i: array_to_string(string_split(path_key, '/')[1:i], '/'))) AS anc FROM {target_entries} e"
add("d17_cutover_removals", lambda t: migrate.removals(t.target_entries.select("path_key", "is_dir"), cut_lineage(expected(t).select("plan_id", "target_key")), copy(t)).select("path_key", "is_dir"),
    """SELECT o.path_key, o.is_dir FROM (SELECT path_key, is_dir, MAX(anc) AS owner FROM {up_target} WHERE anc IN (SELECT destination_key FROM {plan_copy}) GROUP BY ALL) o
       WHERE o.path_key NOT IN (SELECT destination_key FROM {plan_copy}) AND o.path_key NOT IN (SELECT target_key FROM {exp_items})""")
_SOURCES = lambda t: t.estate.withColumn("size", F.when(F.length("name") % 17 == 0, F.col("size") + 5).otherwise(F.col("size")))
add("d18_transfer_verify", lambda t: migrate.verify(migrate.expected_once(cut_lineage(expected(t).drop("sha256"))), t.target_entries, _SOURCES(t), columns=["wave", "is_dir"]).groupBy("wave", "is_dir", "problem").agg(F.count("*").alias("n")),
    """SELECT wave, is_dir, problem, COUNT(*) AS n FROM (SELECT x.wave, x.is_dir, CASE WHEN a.path_key IS NULL THEN 'Missing' WHEN a.is_dir <> x.is_dir THEN 'TypeMismatch'
           WHEN NOT x.is_dir AND length(s.name) % 17 = 0 THEN 'SourceChanged' WHEN NOT x.is_dir AND a.size <> x.size THEN 'SizeMismatch' END AS problem
         FROM {exp_items} x LEFT JOIN {target_entries} a ON a.path_key = x.target_key LEFT JOIN {estate} s ON s.path_key = x.source_path) GROUP BY ALL""")
add("j10_collisions", lambda t: migrate.collisions(migrate.expected_items(t.depot, t.depot_units)).select("target_key", "violation", "sources"),
    """SELECT target_key, CASE WHEN lo <> hi THEN 'FileAndFolder' ELSE 'DifferentContent' END AS violation, sources FROM (
         SELECT '/merged/' || lower(name) AS target_key, MIN(is_dir) AS lo, MAX(is_dir) AS hi, COUNT(*) AS sources,
           COUNT(DISTINCT CASE WHEN NOT is_dir THEN (size, COALESCE(sha256, path_key)) END) AS kinds FROM {depot} GROUP BY ALL) WHERE lo <> hi OR kinds > 1""")
add("j9_transfer_check", lambda t: transfer_check(t.depot, t.depot_units, t.target_entries)["verify"].groupBy("is_dir", "problem").agg(F.count("*").alias("n")),
    """SELECT is_dir, 'Missing' AS problem, COUNT(*) AS n FROM (SELECT lower(name) AS k, arg_min(is_dir, path_key) AS is_dir FROM {depot} GROUP BY ALL UNION ALL SELECT '', TRUE) GROUP BY ALL""")


def written_plan(t):
    """Units, directories and exclusions as written, read back."""
    folder = scratch_path(t.spark, "plan")
    reports.write_transfer_plan(copy(t), migrate.planned_directories(paths(t), TARGET), migrate.exclusions(copy(t)), folder, threads=64)
    read = lambda name, schema: t.spark.read.schema(schema).json(f"{folder}/{name}")
    rest = lambda kind, df: df.select(F.lit(kind).alias("kind"), "*").toDF("kind", "plan_id", "a", *(["b"] if len(df.columns) == 3 else []))
    units = read("units", "plan_id string, wave int, source string, destination string, threads int, copy_acl boolean")
    units = units.select(F.lit("unit").alias("kind"), "plan_id", F.lower("source").alias("a"), F.lower("destination").alias("b"), "wave", "threads", "copy_acl")
    folders = rest("directory", read("directories", "plan_id string, directory string"))
    nested = rest("exclusion", read("exclusions", "plan_id string, source_key string, excluded_key string"))
    return units.unionByName(folders, allowMissingColumns=True).unionByName(nested, allowMissingColumns=True)


add("a19_transfer_plan", written_plan,
    """SELECT 'unit' AS kind, plan_id, source_key AS a, destination_key AS b, wave, 32 AS threads, FALSE AS copy_acl FROM {plan_copy}
       UNION ALL SELECT DISTINCT 'directory', plan_id, lower('/target/' || rel_path), NULL, NULL, NULL, NULL FROM {plan_paths}
       UNION ALL SELECT DISTINCT 'exclusion', a.plan_id, a.source_key, b.source_key, NULL, NULL, NULL FROM {plan_copy} a JOIN {plan_copy} b ON b.plan_id = a.plan_id AND starts_with(b.source_key, a.source_key || '/')""")


def csv_round_trip(t):
    """The link map as quoted CSV, read back."""
    folder = scratch_path(t.spark, "csv")
    reports.write_csv(migrate.link_map(copy(t)), folder)
    return t.spark.read.schema("plan_id string, wave int, old_prefix string, new_prefix string").option("header", True).option("escape", '"').csv(folder).select(
        "plan_id", "wave", F.lower("old_prefix").alias("source_key"), F.lower("new_prefix").alias("destination_key"))


add("a15_link_map_csv", csv_round_trip, "SELECT * FROM {plan_copy}")
add("a15_design_matrix", lambda t: reports.design_matrix(paths(t), t.plan_sources, t.plan_aces).groupBy("plan_id", "access_type", "inheritance").agg(F.count("*").alias("n")),
    """SELECT n.plan_id, COALESCE(a.access_type, '-') AS access_type, CASE WHEN n.inherit_acl THEN 'Inherited' ELSE 'Explicit' END AS inheritance, COUNT(*) AS n
       FROM {plan_nodes} n LEFT JOIN {plan_aces} a USING (plan_id, node_id) GROUP BY ALL""")
add("a15_diff_report", lambda t: reports.diff_report(migrate.design_diff(paths(t), t.plan_sources)).groupBy("plan_id", "kind").agg(F.count("*").alias("n")),
    """SELECT plan_id, CASE WHEN n > 1 THEN 'Consolidation' WHEN n = 0 THEN 'NewFolder' WHEN level > 1 THEN 'Relocation' ELSE 'Preserved' END AS kind, COUNT(*) AS n FROM (
         SELECT p.plan_id, p.node_id, p.level, COUNT(s.source_path) AS n FROM {plan_paths} p LEFT JOIN {plan_sources} s USING (plan_id, node_id) GROUP BY ALL) GROUP BY ALL""")
add("a16_kpi_by_issue", lambda t: reports.kpi_by_issue(candidates(t)).groupBy("issue").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")),
    """SELECT issue, COUNT(*) AS files, CAST(SUM(CASE WHEN issue = 'Duplicate' AND is_alias THEN 0 ELSE size END) AS BIGINT) AS bytes FROM (SELECT *, unnest(string_split(issues, ',')) AS issue FROM {combined})
       WHERE NOT (issue = 'Duplicate' AND is_original) GROUP BY ALL""")


def size_sql(b: str, digits: int = 1) -> str:
    """1024-based size text; one digit drops a trailing zero."""
    scaled = lambda power, unit: f"printf('%.{digits}f', round_even({b} / {1024.0**power}, {digits}))" if digits == 2 else f"regexp_replace(printf('%.1f', round_even({b} / {1024.0**power}, 1)), '\\.0$', '')"
    steps = " ".join(f"WHEN {b} < {1024 ** (p + 1)} THEN {scaled(p, u)} || ' {u}'" for p, u in ((1, "KB"), (2, "MB"), (3, "GB")))
    return f"CASE WHEN {b} = 0 THEN '0 B' WHEN {b} < 1024 THEN {b} || ' B' {steps} ELSE {scaled(4, 'TB')} || ' TB' END"


def duration_sql(s: str) -> str:
    return f"""CASE WHEN {s} >= 86400 THEN ({s} // 86400) || 'd ' || ({s} // 3600 % 24) || 'h ' || ({s} // 60 % 60) || 'm' WHEN {s} >= 3600 THEN ({s} // 3600) || 'h ' || ({s} // 60 % 60) || 'm'
      WHEN {s} >= 60 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' ELSE GREATEST({s}, 1) || 's' END"""


add("a16_wave_overview", lambda t: reports.wave_overview(migrate.wave_totals(pieces(t, migrate.TOP_LEVEL), waved(t), t.plan_sources)),
    "SELECT w.plan_id, w.wave, wave_name, " + size_sql("bytes") + " AS size_text, CASE WHEN files IS NULL THEN 'Unmeasured (-)' ELSE format('{:,}', files) || ' files' END AS files_text, "
    + duration_sql("full_seconds") + " AS full_copy, " + duration_sql("cutover_seconds") + """ AS cutover, COALESCE(s.n, 0) AS source_count,
         array_to_string(list_filter([CASE WHEN files > 100000 THEN 'over 100,000 files' END, CASE WHEN full_seconds > 172800 THEN 'over 48 hours' END], lambda x: x IS NOT NULL), ', ') AS warnings
       FROM {plan_waves} w LEFT JOIN (SELECT plan_id, wave, COUNT(DISTINCT source_key) AS n FROM {plan_copy} GROUP BY ALL) s USING (plan_id, wave)""")
add("a16_media_top", lambda t: reports.media_top(media.classify(t.media), 40).select("path_key", "media_class", "size", "status"),
    """SELECT path_key, media_class, size, CASE WHEN protection IS NOT NULL THEN 'Protected (' || protection || ')' WHEN media_class = 'Video' THEN 'Large video' ELSE 'To optimise' END AS status
       FROM {media_rows} ORDER BY size DESC, path_key LIMIT 40""")
add("a15_search_report", lambda t: reports.search_report(search.hits(t.estate, search.SearchSpec(extensions=["txt"]))),
    "SELECT 'File' AS type, name, size, " + size_sql("size", 2) + """ AS size_text, strftime(modified_at, '%Y/%m/%d %H:%M:%S') AS modified, ext, length(path) AS path_length, 'Match' AS reason_or_snippet, path
       FROM {estate} WHERE ext = '.txt'""")
add("a15_audit_report", lambda t: reports.audit_report(candidates(t)).select("issues", "name", "size_text", "score", F.lower("path").alias("path")),
    "SELECT replace(issues, ',', ', ') AS issues, name, " + size_sql("size", 2) + " AS size_text, score, path_key AS path FROM {orderable}")


def saved_design(t):
    """A design saved and opened again: its nodes with their sources and grants."""
    folder = scratch_path(t.spark, "saved-design")
    inventory.save_design({"plan_nodes": t.plan_nodes, "plan_sources": t.plan_sources, "plan_aces": t.plan_aces}, folder)
    opened = inventory.open_design(t.spark, folder)
    named = opened["plan_nodes"].join(opened["plan_sources"], ["plan_id", "node_id"], "left").join(opened["plan_aces"], ["plan_id", "node_id"], "left")
    return named.select("plan_id", "node_id", "parent_id", "ord", "name", "level", "est_size", "est_files", "inherit_acl", "source_path", "ace_order", "account", "rights", "access_type")


add("a20_saved_design", saved_design,
    """SELECT plan_id, node_id, parent_id, ord, name, level, est_size, est_files, inherit_acl, source_path, ace_order, account, rights, access_type
       FROM {plan_nodes} LEFT JOIN {plan_sources} USING (plan_id, node_id) LEFT JOIN {plan_aces} USING (plan_id, node_id)""")
add("a16_mapping_detail", lambda t: reports.mapping_detail(copy(t), migrate.exclusions(copy(t))).select("plan_id", "source_key", "destination_key", "excluded_count"),
    """SELECT a.plan_id, a.source_key, a.destination_key, (SELECT COUNT(DISTINCT b.source_key) FROM {plan_copy} b WHERE b.plan_id = a.plan_id AND starts_with(b.source_key, a.source_key || '/')) AS excluded_count FROM {plan_copy} a""")
add("a16_issue_list", lambda t: positioned(reports.issue_list(candidates(t)), "path_key", "issue_type", "name", "size", "score"),
    """SELECT path_key, issue_type, name, size, score, row_number() OVER (ORDER BY can_clean DESC, score DESC, size DESC, lower(name), path_key) AS position FROM {orderable}""")


def nested_design(t):
    """Plans written as nested design files and loaded again."""
    child = lambda level: t.plan_nodes.where(F.col("level") == level)
    node = lambda children: F.struct(
        F.col("ord"), F.col("name").alias("Name"), F.col("est_size").alias("EstimatedSizeBytes"), F.col("est_files").alias("EstimatedFileCount"), F.col("inherit_acl").alias("InheritAcl"), *children)
    leaves = child(2).groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(node([]))).alias("Children"))
    mid = child(1).join(leaves, ["plan_id", "node_id"], "left").groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(node([F.col("Children")]))).alias("Children"))
    roots = child(0).join(mid, ["plan_id", "node_id"], "left").select(F.col("plan_id").alias("ProjectName"), F.array(node([F.col("Children")])).alias("RootFolders"))
    folder = scratch_path(t.spark, "design")
    roots.repartition("ProjectName").write.partitionBy().option("maxRecordsPerFile", 1).json(folder)
    return inventory.load_design(t.spark, folder)["plan_nodes"]


add("a20_load_design", lambda t: nested_design(t).select("plan_id", "name", "level", "est_size", "est_files", "inherit_acl"),
    "SELECT plan_id, name, level, est_size, est_files, inherit_acl FROM {plan_nodes}")


def listing_round_trip(t):
    folder = scratch_path(t.spark, "listing")
    t.entries.select(F.translate("path", "/", "\\").alias("path"), "is_dir", "size", "created_at", "modified_at", "accessed_at", "attributes", "physical_id").write.parquet(folder)
    return inventory.read_listing(t.spark, folder, "\\estate", "s1").select("path_key", "parent_key", "name", "ext", "level", "size")


add("a1_read_listing", listing_round_trip, "SELECT path_key, parent_key, name, ext, level, size FROM {entries}")

# --- links -----------------------------------------------------------------------------------


def repaired(t):
    return links.rewrite(t.links, t.link_map)


ORACLE["map_hit"] = """
  SELECT l.*, m.old_prefix, m.new_prefix FROM (SELECT *, row_number() OVER () AS id, replace(replace(lower(target), '''!a1', ''), '''', '') AS plain FROM {links}) l
    LEFT JOIN {link_map} m ON l.plain = lower(m.old_prefix) OR starts_with(l.plain, lower(m.old_prefix) || '/')"""
ORACLE["best_hit"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(old_prefix) DESC NULLS LAST, old_prefix) AS rn FROM {map_hit}) WHERE rn = 1"
ORACLE["rewritten"] = """
  SELECT *, CASE WHEN old_prefix IS NULL THEN target ELSE substr(target, 1, instr(lower(target), lower(old_prefix)) - 1) || new_prefix
    || substr(target, instr(lower(target), lower(old_prefix)) + length(old_prefix)) END AS new_target FROM {best_hit}"""
add("f36_external_links", lambda t: links.external(t.links).groupBy("kind").agg(F.count("*").alias("n")),
    "SELECT kind, COUNT(*) AS n FROM {links} WHERE kind <> 'formula' OR contains(target, ':/') GROUP BY ALL")
add("f37_prefix_rewrite", lambda t: repaired(t).select("file_path", "target", "new_target", "needs_fix"),
    "SELECT file_path, target, new_target, lower(new_target) <> lower(target) AS needs_fix FROM {rewritten}")
add("f37_changes_per_file", lambda t: links.changes_per_file(repaired(t)), "SELECT file_path, COUNT(*) AS links, COUNT(*) FILTER (WHERE new_target <> target) AS changed FROM {rewritten} GROUP BY ALL")
ORACLE["locked"] = "SELECT p.path_key, p.ext, EXISTS (SELECT 1 FROM {page_files} l WHERE l.path_key = '/pages/~$' || p.name) AS is_locked FROM {page_files} p WHERE NOT starts_with(p.name, '~$')"
add("d5_lock_siblings", lambda t: links.lock_siblings(t.page_files).select("path_key", "is_locked"), "SELECT path_key, is_locked FROM {locked}")
ORACLE["link_files"] = """
  SELECT file_path, bit_or(CASE WHEN contains(part, 'vbaProject') THEN 4 WHEN contains(part, 'externalLink') THEN 1 ELSE 2 END) AS categories, COUNT(*) FILTER (WHERE lower(new_target) <> lower(target)) AS fixable FROM {rewritten} GROUP BY ALL"""
_STATUS = """SELECT f.file_path, f.categories, CASE WHEN l.is_locked THEN 'Locked' WHEN l.ext = '.xls' THEN 'Detected (manual)' ELSE 'Candidate' END AS status,
  CASE WHEN l.is_locked OR l.ext = '.xls' OR f.categories = 4 THEN 'Skipped' WHEN fixable = 0 THEN 'NothingToDo' WHEN f.categories & 4 <> 0 THEN 'PartiallyFixed' ELSE 'FullyFixed' END AS repair
  FROM {link_files} f LEFT JOIN {locked} l ON l.path_key = f.file_path"""
add("f38_item_status", lambda t: links.item_status(repaired(t), links.lock_siblings(t.page_files)).select("file_path", "categories", "status", "repair"), _STATUS)
add("j12_link_repair_plan", lambda t: link_repair_plan(t.links, t.link_map, t.page_files)["files"].groupBy("status", "repair").agg(F.count("*").alias("n")),
    f"SELECT status, repair, COUNT(*) AS n FROM ({_STATUS}) GROUP BY ALL")

# --- media -------------------------------------------------------------------------------------

ORACLE["media_rows"] = """
  SELECT * FROM (SELECT *, CASE WHEN ext IN ('.psd', '.nef') THEN 'Master' WHEN ext IN ('.jpg', '.jpeg', '.png') THEN 'Image' WHEN ext IN ('.mp4', '.mov') THEN 'Video' END AS media_class,
    CASE WHEN ext IN ('.psd', '.nef') THEN 'Master extension' WHEN contains(path_key, '_master') THEN 'Protected folder name' END AS protection FROM {media})
  WHERE media_class IS NOT NULL AND NOT (media_class = 'Image' AND protection IS NULL AND size < 2097152)"""
add("f31_media_classes", lambda t: media.classify(t.media).select("path_key", "media_class", "protection"), "SELECT path_key, media_class, protection FROM {media_rows}")
add("k11_videos", lambda t: positioned(media.videos(media.classify(t.media)), "path_key", "size"), "SELECT path_key, size, row_number() OVER (ORDER BY size DESC, path_key) AS position FROM {media_rows} WHERE media_class = 'Video'")
ORACLE["media_done"] = "SELECT m.*, o.optimised_size FROM {media_rows} m LEFT JOIN {optimised} o USING (path_key)"
_MEDIA_TOTALS = """SELECT COUNT(*) FILTER (WHERE media_class <> 'Video') AS images, COUNT(*) FILTER (WHERE media_class = 'Video') AS videos, CAST(SUM(CASE WHEN optimised_size IS NOT NULL THEN size END) AS BIGINT) AS original_bytes,
  CAST(SUM(optimised_size) AS BIGINT) AS optimised_bytes FROM {media_done}"""
add("c24_media_totals", lambda t: media.totals(media.classify(t.media).join(t.optimised, "path_key", "left")).select("images", "videos", "original_bytes", "optimised_bytes"), _MEDIA_TOTALS)
add("j11_media_report", lambda t: media_report(t.media, t.optimised)["media"].select("path_key", "saved_bytes", F.round("reduction_percent", 4).alias("reduction_percent")),
    "SELECT path_key, COALESCE(GREATEST(size - optimised_size, 0), 0) AS saved_bytes, round(COALESCE(GREATEST(size - optimised_size, 0), 0) * 100.0 / size, 4) AS reduction_percent FROM (SELECT *, optimised_size FROM {media_done})")
add("d20_media_stamp", lambda t: media.stamp_check(media.classify(t.media), t.media.withColumn(
    "modified_at", F.col("modified_at") + F.when(F.length("name") % 2 == 0, F.expr("INTERVAL 2 SECONDS")).otherwise(F.expr("INTERVAL 3 SECONDS")))).select("path_key", "unchanged"),
    "SELECT path_key, length(name) % 2 = 0 AS unchanged FROM {media_rows}")

# --- texts ---------------------------------------------------------------------------------------

GROUPS = [["que", "the"], ["pour", "und", "with"]]
ORACLE["page_flags"] = "SELECT path, page_no, contains(lower(text), 'que') OR contains(lower(text), 'the') AS a, contains(lower(text), 'pour') OR contains(lower(text), 'und') OR contains(lower(text), 'with') AS b FROM {doc_pages}"
add("f35_paged_match", lambda t: text.match_pages(t.doc_pages, GROUPS).select("path", "page_no", "all_on_one_page"),
    """SELECT path, COALESCE(MIN(page_no) FILTER (WHERE a AND b), MIN(page_no) FILTER (WHERE a OR b)) AS page_no, bool_or(a AND b) AS all_on_one_page FROM {page_flags}
       GROUP BY path HAVING bool_or(a) AND bool_or(b)""")
add("j14_keyword_groups", lambda t: text.match_groups(t.file_text, GROUPS).select("path_key", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups")),
    """SELECT path_key, array_to_string(list_filter([CASE WHEN a THEN '0' END, CASE WHEN b THEN '1' END], lambda x: x IS NOT NULL), ',') AS groups FROM (
         SELECT path_key, contains(lower(text), 'que') OR contains(lower(text), 'the') AS a, contains(lower(text), 'pour') OR contains(lower(text), 'und') OR contains(lower(text), 'with') AS b FROM {file_text}) WHERE a OR b""")
add("j14_keyword_table", lambda t: text.match_keyword_table(t.file_text, t.keywords), "SELECT f.path_key, k.group_id, k.keyword FROM {file_text} f JOIN {keywords} k ON k.keyword <> '' AND contains(lower(f.text), k.keyword)")
add("j15_trigram_index", lambda t: text.trigram_index(t.file_text).groupBy("trigram").agg(F.count("*").alias("docs")),
    """SELECT trigram, COUNT(*) AS docs FROM (SELECT DISTINCT path_key, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS trigram FROM {file_text}) GROUP BY ALL""")


add("f34_markup_to_text", lambda t: t.pages.select("page_id", markup.markup_to_text("html").alias("text")),
    r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(replace(regexp_replace(regexp_replace(html, '(?i)</*(?:w:p|w:tr|w:tc|row|a:p|si|v|c )[^>]*>|</*c>', ' ', 'g'), '<[^>]*>', '', 'g'), '>', ''),
         '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS text FROM {pages}""")


def encoded(t):
    """Documents in six forms, turned back into text: UTF-8 and UTF-16 with and without mark, and CP932."""
    n = F.conv(F.substring(F.md5("path_key"), 1, 1), 16, 10).cast("int") % 6
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    content = (
        F.when(n == 0, F.encode("text", "UTF-8")).when(n == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(n == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(n == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(n == 4, F.encode(F.concat(F.lit("plain"), plain), "UTF-16LE")).otherwise(F.concat(F.encode(plain, "UTF-8"), F.unhex(F.lit("93FA967B8CEA836583588367"))))
    )
    return text.decode_text(t.file_text.select("path_key", content.alias("content"))).select("path_key", F.md5("text").alias("digest"))


add("j16_decode_text", encoded,
    """SELECT path_key, md5(CASE WHEN n < 4 THEN text WHEN n = 4 THEN 'plain' || plain ELSE plain || '日本語テスト' END) AS digest FROM (
         SELECT *, CAST('0x' || substr(md5(path_key), 1, 1) AS INT) % 6 AS n, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS plain FROM {file_text})""")

# --- streams ----------------------------------------------------------------------------------------


def arriving(t, name, frame):
    folder = scratch_path(t.spark, name)
    frame.write.parquet(folder)
    return stream_history.read_snapshots(t.spark, folder), scratch_path(t.spark, name + "-out")


def run_stream(t, frame, out):
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(frame.schema).parquet(out)


@once
def streamed_history(t):
    """Snapshots arriving in two parts without order, each also a tenth of a second later; then a far newer one, then late copies of the newest."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.STATE_STORE)
    folder, out = scratch_path(t.spark, "history"), scratch_path(t.spark, "history-out")
    twice = t.snapshots.unionByName(t.snapshots.withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 MILLISECONDS")))
    part = F.pmod(F.xxhash64("snapshot_id", "ts"), F.lit(2))
    closing = t.snapshots.agg(F.max("ts").alias("ts")).select(
        F.lit("~closing").alias("target_key"), F.lit("~closing").alias("snapshot_id"), (F.col("ts") + F.expr("INTERVAL 3000 DAYS")).alias("ts"), F.lit(0).cast("long").alias("total_bytes"), F.lit(0).cast("long").alias("total_files"))
    newest = t.snapshots.groupBy("target_key").agg(F.max(F.struct("ts", "snapshot_id", "total_bytes", "total_files")).alias("s")).select("target_key", "s.*")
    late = newest.withColumn("snapshot_id", F.concat(F.lit("late-"), "snapshot_id")).select(*t.snapshots.columns)
    for arrival in (*[twice.where(part == i) for i in range(2)], closing, late):
        arrival.write.mode("append").parquet(folder)
        written = run_stream(t, stream_history.stream_history(stream_history.read_snapshots(t.spark, folder), "2000 days"), out)
    return written.where("target_key <> '~closing'").select("target_key", "snapshot_id", text_time("ts"), "total_bytes", "total_files", "late")


add("r1_stream_history", streamed_history,
    f"""SELECT target_key, snapshot_id, strftime(ts, '{STAMP}') AS ts, total_bytes, total_files, FALSE AS late FROM (
         SELECT *, row_number() OVER (PARTITION BY target_key, date_trunc('second', ts) ORDER BY ts, snapshot_id) AS rn FROM (
           SELECT * FROM {{snapshots}} UNION ALL SELECT target_key, snapshot_id, ts + INTERVAL 100 MILLISECOND, total_bytes, total_files FROM {{snapshots}})) WHERE rn = 1
       UNION ALL SELECT target_key, 'late-' || snapshot_id, strftime(ts, '{STAMP}'), total_bytes, total_files, TRUE FROM (
         SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY ts DESC, snapshot_id DESC) AS age FROM {{snapshots}}) WHERE age = 1""")
add("r1_late_counts", lambda t: stream_history.late_counts(streamed_history(t)).where("late > 0"),
    "SELECT target_key, 1 AS late FROM {snapshots} GROUP BY ALL")


def streamed_alerts(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.STATE_STORE)
    source, out = arriving(t, "alerts", t.snapshots)
    return run_stream(t, alerts.stream_growth_alerts(source), out).select("target_key", "snapshot_id", "delta_bytes", "baseline_count", "is_anomaly", F.round("z_score", 4).alias("z_score"))


add("r2_stream_growth_alerts", streamed_alerts,
    """SELECT target_key, snapshot_id, delta AS delta_bytes, base_n AS baseline_count, COALESCE(base_n >= 5 AND delta >= 524288000 AND rate > med AND z > 3.5, FALSE) AS is_anomaly,
         round(z, 4) AS z_score FROM {verdicts}""")
