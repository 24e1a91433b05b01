"""Folder tree, snapshots of it, and history."""

from pyspark.sql import functions as F

from filetide.functions import formats, paths
from filetide.operators import history, refresh, tree
from filetide.plans.forecast import forecast
from filetide.plans.storage import storage_report
from filetide.sources import reports, snapshots as store
from filetide.session import cut_lineage, scratch_path

from .registry import ORACLE, add, positioned

STAMP = "%Y-%m-%d %H:%M:%S"


def text_time(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# A folder counts as unchanged when it or any folder above it is.
ORACLE["same_folders"] = """SELECT e.path_key FROM {entries} e JOIN {previous} p ON p.path_key = e.path_key AND p.is_dir
  WHERE e.is_dir AND abs(epoch_us(e.modified_at) - epoch_us(p.modified_at)) <= 2000000"""
ORACLE["unchanged"] = """SELECT path_key FROM {same_folders}
  UNION SELECT u.path_key FROM {up} u JOIN {same_folders} s ON s.path_key = u.anc WHERE u.is_dir"""


# --- scope and snapshots of the listing -------------------------------------

add(
    "a2_exclude_folders",
    lambda t: tree.exclude_folders(t.entries, ["ER#00000001", " nation_7 "]).groupBy("level", "is_dir").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes")),
    """SELECT level, is_dir, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes FROM {entries}
       WHERE NOT len(list_filter(string_split(CASE WHEN is_dir THEN path_key ELSE parent_key END, '/')[3:],
         lambda p: contains(p, 'er#00000001') OR contains(p, 'nation_7'))) > 0 GROUP BY ALL""",
)
add(
    "a3_drop_reparse",
    lambda t: tree.drop_reparse(t.entries).groupBy("level", "is_dir").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")),
    """SELECT level, is_dir, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes FROM {entries} e
       WHERE attributes & 1024 = 0 AND NOT EXISTS (SELECT 1 FROM {up} u JOIN {entries} d ON d.path_key = u.anc
         WHERE d.attributes & 1024 <> 0 AND u.path_key = e.path_key) GROUP BY ALL""",
)
add(
    "a4_coverage",
    lambda t: tree.coverage(t.entries, t.scan_errors),
    """SELECT root_key, snapshot_id, COUNT(*) FILTER (WHERE is_dir) AS folders_scanned, COUNT(*) FILTER (WHERE NOT is_dir) AS files_found,
       (SELECT COUNT(DISTINCT folder_path) FROM {scan_errors}) AS unreadable_folders, FALSE AS is_complete FROM {entries} GROUP BY ALL""",
)
add(
    "a4_unreadable_folders",
    lambda t: tree.unreadable_folders(t.scan_errors),
    "SELECT DISTINCT root_key, snapshot_id, folder_path FROM {scan_errors}",
)


def published(t):
    """Publish twice, the second time one root with other rows, and read back."""
    folder = scratch_path(t.spark, "published")
    store.publish(t.entries.unionByName(t.docs), folder)
    store.publish(t.docs.withColumn("size", F.col("size") + 1), folder)
    return store.read(t.spark, folder).groupBy("root_key", "snapshot_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


add(
    "a5_publish_snapshot", published,
    """SELECT root_key, snapshot_id, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes FROM {entries} GROUP BY ALL
       UNION ALL SELECT root_key, snapshot_id, COUNT(*), CAST(SUM(size + 1) AS BIGINT) FROM {docs} GROUP BY ALL""",
)


def published_if_complete(t):
    folder, partial = scratch_path(t.spark, "whole"), scratch_path(t.spark, "partial")
    both = cut_lineage(t.entries.unionByName(t.docs))
    store.publish_if_complete(both, tree.coverage(both, t.scan_errors), folder, partial)
    count = lambda place, name: store.read(t.spark, place).groupBy("root_key").agg(F.count("*").alias("n")).withColumn("place", F.lit(name))
    return count(folder, "published").unionByName(count(partial, "partial"))


add(
    "a6_publish_if_complete", published_if_complete,
    """SELECT root_key, COUNT(*) AS n, 'partial' AS place FROM {entries} GROUP BY ALL
       UNION ALL SELECT root_key, COUNT(*), 'published' FROM {docs} GROUP BY ALL""",
)
add(
    "a7_list_roots",
    lambda t: tree.list_roots(t.entries.unionByName(t.previous), t.scans).select("root_key", "snapshot_id", text_time("ts"), "bytes", "files"),
    f"""SELECT e.root_key, e.snapshot_id, strftime(MAX(e.modified_at), '{STAMP}') AS ts,
        CAST(SUM(CASE WHEN is_dir THEN 0 ELSE size END) AS BIGINT) AS bytes, COUNT(*) FILTER (WHERE NOT is_dir) AS files FROM {{entries}} e GROUP BY ALL""",
)


def without_docs(t):
    folder = scratch_path(t.spark, "roots")
    store.publish(t.entries.unionByName(t.docs), folder)
    store.delete_root(t.spark, folder, "/docs")
    return store.read(t.spark, folder).groupBy("root_key").agg(F.count("*").alias("n"))


add("a7_delete_root", without_docs, "SELECT root_key, COUNT(*) AS n FROM {entries} GROUP BY ALL")
add(
    "a8_newest_per_root",
    lambda t: tree.newest_per_root([
        t.snapshots.select(F.col("target_key").alias("root_key"), "snapshot_id", "ts"),
        t.orders.select(F.concat(F.lit("target_"), (F.col("o_custkey") % 200).cast("string")).alias("root_key"),
                        F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("snapshot_id"),
                        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 8000 DAYS")).alias("ts")),
    ]).select("root_key", text_time("ts"), "source_no"),
    f"""SELECT root_key, strftime(ts, '{STAMP}') AS ts, source_no FROM (
         SELECT *, row_number() OVER (PARTITION BY root_key ORDER BY ts DESC, source_no) AS rn FROM (
           SELECT target_key AS root_key, ts, 0 AS source_no FROM {{snapshots}}
           UNION ALL SELECT 'target_' || CAST(o_custkey % 200 AS STRING), o_orderdate + INTERVAL 8000 DAY, 1 FROM {{orders}})) WHERE rn = 1""",
)


def through_json(t):
    folder = scratch_path(t.spark, "tree-json")
    store.export_tree_json(t.entries, folder)
    return store.import_tree_json(t.spark, folder).select(
        "path_key", "parent_key", "is_dir", "size", text_time("modified_at"), "level", "sha256")


add(
    "a9_tree_json_round_trip", through_json,
    f"SELECT path_key, parent_key, is_dir, size, strftime(modified_at, '{STAMP}') AS modified_at, level, sha256 FROM {{entries}}",
)
add(
    "a10_carry_hashes",
    lambda t: tree.carry_hashes(t.entries, t.previous).where(~F.col("is_dir")).select("path_key", "sha256"),
    """SELECT e.path_key, COALESCE(e.sha256, p.sha256) AS sha256 FROM {entries} e LEFT JOIN (SELECT * FROM {previous} WHERE NOT is_dir) p
         ON p.path_key = e.path_key AND p.size = e.size AND p.modified_at = e.modified_at AND p.created_at = e.created_at WHERE NOT e.is_dir""",
)
add(
    "a11_write_back_hashes",
    lambda t: tree.write_back_hashes(
        t.entries, t.previous.select("path_key", "size", "modified_at", "sha256").unionByName(
            t.entries.select("path_key", "size", "modified_at", F.md5("name").alias("sha256")))
    ).where(~F.col("is_dir")).select("path_key", "sha256"),
    """SELECT e.path_key, COALESCE(h.sha256, e.sha256) AS sha256 FROM {entries} e LEFT JOIN (
         SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path_key ORDER BY modified_at, size, sha256) AS rn FROM (
           SELECT path_key, size, modified_at, sha256 FROM {previous} WHERE sha256 IS NOT NULL
           UNION ALL SELECT path_key, size, modified_at, md5(name) FROM {entries})) WHERE rn = 1) h
         ON h.path_key = e.path_key AND h.size = e.size AND h.modified_at = e.modified_at WHERE NOT e.is_dir""",
)

# --- roll-ups, shares, lists -------------------------------------------------

add("c1_folder_rollup", lambda t: tree.rollup(t.entries), "SELECT * FROM {rolled}")
add(
    "c3_root_share",
    lambda t: tree.root_share(tree.rollup(t.entries)).select("folder_key", "bytes", F.round("percentage", 6).alias("percentage")),
    """SELECT r.folder_key, r.bytes, round(LEAST(100.0, CASE WHEN t.bytes > 0 THEN r.bytes * 1.0 / t.bytes * 100 ELSE 0 END), 6) AS percentage
       FROM {rolled} r JOIN {rolled} t ON t.folder_key = r.root_key""",
)
add(
    "c4_child_share",
    lambda t: tree.child_share(t.entries).select("path_key", "size", F.round("share", 6).alias("share")),
    """SELECT n.path_key, n.size, round(LEAST(100.0, n.size * 1.0 / GREATEST(p.bytes, 1) * 100), 6) AS share FROM {nodes} n
       JOIN {rolled} p ON p.folder_key = regexp_replace(n.path_key, '/[^/]*$', '')""",
)
add(
    "c5_extension_totals",
    lambda t: tree.extension_totals(t.estate.unionByName(t.media)).select("root_key", "extension", "bytes", "files", F.round("percentage", 6).alias("percentage")),
    """SELECT root_key, extension, bytes, files, percentage FROM (
         SELECT *, round(bytes * 100.0 / SUM(bytes) OVER (PARTITION BY root_key), 6) AS percentage,
           row_number() OVER (PARTITION BY root_key ORDER BY bytes DESC, extension) AS rn FROM (
           SELECT root_key, CASE WHEN ext = '' THEN '(none)' ELSE lower(ext) END AS extension, CAST(SUM(size) AS BIGINT) AS bytes, COUNT(*) AS files
           FROM (SELECT * FROM {estate} UNION ALL SELECT * FROM {media}) WHERE NOT is_dir GROUP BY ALL)) WHERE rn <= 10""",
)
add(
    "c6_category_totals",
    lambda t: tree.category_totals(t.estate.unionByName(t.media)),
    """SELECT root_key, snapshot_id, CASE WHEN ext IN ('.zip', '.7z', '.rar', '.tar', '.gz') THEN 'Archive' WHEN ext IN ('.mp4', '.mov') THEN 'Video'
         WHEN ext IN ('.jpg', '.png', '.psd') THEN 'Image / Graphics' WHEN ext = '.tmp' THEN 'Log / System dump' ELSE 'Other' END AS category,
         CAST(SUM(size) AS BIGINT) AS bytes, COUNT(*) AS files FROM (SELECT * FROM {estate} UNION ALL SELECT * FROM {media}) WHERE NOT is_dir GROUP BY ALL""",
)
add(
    "c25_tree_diff_totals",
    lambda t: tree.diff_totals(tree.tree_diff(tree.node_sizes(t.entries), tree.node_sizes(t.previous))),
    """SELECT n.root_key, CAST(SUM(GREATEST(n.size - COALESCE(p.size, 0), 0)) AS BIGINT) AS grown_bytes,
         CAST(SUM(LEAST(n.size - COALESCE(p.size, 0), 0)) AS BIGINT) AS shrunk_bytes, CAST(SUM(n.size - COALESCE(p.size, 0)) AS BIGINT) AS net_bytes,
         COUNT(*) FILTER (WHERE p.size IS NULL) AS new_files FROM {nodes} n LEFT JOIN {nodes_previous} p USING (path_key) WHERE NOT n.is_dir GROUP BY ALL""",
)
add(
    "d1_tree_diff",
    lambda t: tree.tree_diff(tree.node_sizes(t.entries), tree.node_sizes(t.previous)).select("path_key", "size", "diff", "is_new"),
    """SELECT n.path_key, n.size, n.size - COALESCE(p.size, 0) AS diff, p.size IS NULL AS is_new
       FROM {nodes} n LEFT JOIN {nodes_previous} p USING (path_key)""",
)
add(
    "e11_levels",
    lambda t: tree.with_level(t.entries.drop("level"), 4).select("path_key", "level"),
    "SELECT path_key, level FROM {entries} WHERE level <= 4",
)
add(
    "f13_cleanup_hints",
    lambda t: tree.cleanup_hints(t.estate).select("root_key", "path_key", "size", "reason", "rank"),
    """SELECT root_key, path_key, size, 'Temporary or large log' AS reason, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY root_key ORDER BY size DESC, path_key) AS rank FROM {estate} WHERE ext = '.tmp') WHERE rank <= 10""",
)
add(
    "f15_low_space",
    lambda t: tree.low_space(t.volumes),
    "SELECT *, total_bytes > 0 AND available_bytes <= total_bytes // 10 AS is_low FROM {volumes}",
)
add(
    "k1_largest_files",
    lambda t: tree.largest_files(t.entries, 10).select("path_key", "size"),
    "SELECT path_key, size FROM {entries} WHERE NOT is_dir ORDER BY size DESC, path_key LIMIT 10",
)
add(
    "k1_largest_in_subtree",
    lambda t: tree.largest_files(t.entries, 10, "/estate/asia").select("path_key", "size"),
    "SELECT path_key, size FROM {entries} WHERE NOT is_dir AND starts_with(path_key, '/estate/asia/') ORDER BY size DESC, path_key LIMIT 10",
)
add(
    "k2_largest_per_folder",
    lambda t: tree.largest_per_folder(t.entries, 3).select("folder_key", "path_key", "size", "rank"),
    """SELECT folder_key, path_key, size, rank FROM (SELECT anc AS folder_key, path_key, size,
         row_number() OVER (PARTITION BY anc ORDER BY size DESC, path_key) AS rank FROM {up} WHERE NOT is_dir) WHERE rank <= 3""",
)
add(
    "k3_children_order",
    lambda t: positioned(tree.ordered_children(t.entries), "path_key"),
    """SELECT path_key, row_number() OVER (ORDER BY is_dir DESC, size DESC, name, path_key) AS position FROM {entries}""",
)
add(
    "k4_children_of_folder",
    lambda t: tree.children(t.entries, "/estate/europe").select("path_key", "is_dir", "size"),
    "SELECT path_key, is_dir, size FROM {entries} WHERE parent_key = '/estate/europe'",
)
add(
    "k10_preorder",
    lambda t: positioned(tree.preorder(t.entries), "path_key"),
    """SELECT path_key, row_number() OVER (ORDER BY root_key, snapshot_id, string_split(path_key, '/')) AS position FROM {entries}""",
)


add(
    "f40_prune_refresh",
    lambda t: refresh.prune_refresh(t.previous, t.entries, enabled=True).groupBy("snapshot_id", "is_dir").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")),
    """SELECT snapshot_id, is_dir, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes FROM (
         SELECT * FROM {previous} p WHERE EXISTS (SELECT 1 FROM {unchanged} u WHERE u.path_key = p.parent_key)
         UNION ALL SELECT * FROM {entries} e WHERE e.parent_key IS NULL OR NOT EXISTS (SELECT 1 FROM {unchanged} u WHERE u.path_key = e.parent_key)) GROUP BY ALL""",
)

# --- history -----------------------------------------------------------------

def grown(snapshots: str) -> str:
    return f"""
  SELECT *, total_bytes - prev_bytes AS delta, GREATEST((epoch_us(ts) - epoch_us(prev_ts)) / 86400000000.0, 1.0 / 86400) AS days,
    (total_bytes - prev_bytes) / GREATEST((epoch_us(ts) - epoch_us(prev_ts)) / 86400000000.0, 1.0 / 86400) AS rate,
    row_number() OVER (PARTITION BY target_key ORDER BY ts, snapshot_id) AS rn FROM (
    SELECT *, lag(total_bytes) OVER w AS prev_bytes, lag(ts) OVER w AS prev_ts, lag(snapshot_id) OVER w AS prev_id FROM {{{snapshots}}}
    WINDOW w AS (PARTITION BY target_key ORDER BY ts, snapshot_id))"""


ORACLE["grown"] = grown("snapshots")
ORACLE["kept"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY ts DESC, snapshot_id DESC) AS age FROM {snapshots}) WHERE age <= 500"
def verdicts(grown: str) -> str:
    """Each change with median and MAD of the earlier ones of its target."""
    past = "OVER (PARTITION BY target_key ORDER BY ts, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
  SELECT *, rn - 2 AS base_n, CASE WHEN rn - 2 >= 5 THEN 0.6745 * abs(rate - med) / GREATEST(mad, 10485760.0) END AS z FROM (
    SELECT *, median(rate) {past} AS med, mad(rate) {past} AS mad FROM {{{grown}}} WHERE prev_ts IS NOT NULL) v"""


ORACLE["verdicts"] = verdicts("grown")
ORACLE["one_target"] = "SELECT 'all' AS target_key, * EXCLUDE (target_key) FROM {snapshots}"
ORACLE["one_grown"] = grown("one_target")
ORACLE["one_verdicts"] = verdicts("one_grown")

add(
    "a12_load_history",
    lambda t: history.load_history([t.snapshots, t.snapshots.withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 MILLISECONDS"))]).select(
        "target_key", "snapshot_id", text_time("ts"), "total_bytes"),
    f"""SELECT target_key, snapshot_id, strftime(ts, '{STAMP}') AS ts, total_bytes FROM (
         SELECT *, row_number() OVER (PARTITION BY target_key, date_trunc('second', ts) ORDER BY ts, snapshot_id) AS rn FROM (
           SELECT * FROM {{snapshots}} UNION ALL SELECT target_key, snapshot_id, ts + INTERVAL 100 MILLISECOND, total_bytes, total_files FROM {{snapshots}})) WHERE rn = 1""",
)
add(
    "a13_append_snapshot",
    lambda t: (lambda pair: pair[0].select("target_key", F.lit("").alias("name"), F.col("total_bytes").alias("bytes"), F.col("total_files").alias("files"))
               .unionByName(pair[1].select("target_key", "name", F.col("size").alias("bytes"), F.lit(None).cast("long").alias("files"))))(
        history.append_snapshot(t.entries, F.lit("2002-01-01").cast("timestamp"))),
    """SELECT root_key AS target_key, '' AS name, bytes, files FROM {rolled} WHERE folder_key = '/estate'
       UNION ALL SELECT root_key, string_split(folder_key, '/')[-1], bytes, NULL FROM {rolled} WHERE len(string_split(folder_key, '/')) = 3""",
)
add(
    "a14_retain_newest",
    lambda t: history.retain_newest(t.snapshots, ["target_key"], ["ts", "snapshot_id"], 20).select("target_key", "snapshot_id", "total_bytes"),
    """SELECT target_key, snapshot_id, total_bytes FROM (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY ts DESC, snapshot_id DESC) AS rn
       FROM {snapshots}) WHERE rn <= 20""",
)
add(
    "d25_change_since_last",
    lambda t: history.change_since_last(
        t.snapshots.groupBy("target_key").agg(F.max("total_bytes").alias("total_bytes")), t.snapshots, F.lit("2024-01-15").cast("timestamp")
    ).select("target_key", "total_bytes", "diff_bytes", "status"),
    """SELECT c.target_key, c.total_bytes, COALESCE(c.total_bytes - l.total_bytes, 0) AS diff_bytes,
         CASE WHEN l.total_bytes IS NULL THEN 'Initial' WHEN c.total_bytes > l.total_bytes THEN 'Grown' WHEN c.total_bytes < l.total_bytes THEN 'Shrunk' ELSE 'Unchanged' END AS status
       FROM (SELECT target_key, MAX(total_bytes) AS total_bytes FROM {snapshots} GROUP BY ALL) c LEFT JOIN (
         SELECT target_key, arg_max(total_bytes, ts) AS total_bytes FROM {snapshots} WHERE ts < TIMESTAMP '2024-01-15' - INTERVAL 3 SECOND GROUP BY ALL) l USING (target_key)""",
)
add(
    "e5_growth",
    lambda t: history.growth(t.snapshots).select("target_key", "snapshot_id", "prev_snapshot_id", "delta_bytes", F.round("days_elapsed", 8).alias("days_elapsed")),
    "SELECT target_key, snapshot_id, prev_id AS prev_snapshot_id, delta AS delta_bytes, CASE WHEN prev_ts IS NOT NULL THEN round(days, 8) END AS days_elapsed FROM {grown}",
)
add(
    "e6_causal_anomalies",
    lambda t: history.anomalies(t.snapshots).select("target_key", "snapshot_id", "delta_bytes", "baseline_count", "insufficient_baseline",
                                                    "is_anomaly", F.round("z_score", 4).alias("z_score")),
    """SELECT target_key, snapshot_id, delta AS delta_bytes, base_n AS baseline_count, base_n < 5 AS insufficient_baseline,
         COALESCE(base_n >= 5 AND delta >= 524288000 AND rate > med AND z > 3.5, FALSE) AS is_anomaly, round(z, 4) AS z_score FROM {verdicts}""",
)
# Every snapshot in one target, in blocks far smaller than it.
add(
    "e6_one_target",
    lambda t: history.anomalies(t.snapshots.withColumn("target_key", F.lit("all")), block=1 << 10).select(
        "snapshot_id", "delta_bytes", "baseline_count", "insufficient_baseline", "is_anomaly", F.round(F.col("baseline_median") / 1e6, 2).alias("median_mb"),
        F.round(F.col("baseline_mad") / 1e6, 2).alias("mad_mb"), F.round("z_score", 4).alias("z_score")),
    """SELECT snapshot_id, delta AS delta_bytes, base_n AS baseline_count, base_n < 5 AS insufficient_baseline,
         COALESCE(base_n >= 5 AND delta >= 524288000 AND rate > med AND z > 3.5, FALSE) AS is_anomaly, CASE WHEN base_n >= 5 THEN round(med / 1e6, 2) END AS median_mb,
         CASE WHEN base_n >= 5 THEN round(GREATEST(mad, 10485760.0) / 1e6, 2) END AS mad_mb, round(z, 4) AS z_score FROM {one_verdicts}""",
)
add(
    "d22_history_with_anomalies",
    lambda t: history.mark_anomalies(history.history_rows(t.snapshots), history.anomalies(t.snapshots)).select(
        "target_key", "snapshot_id", "change", "is_anomaly"),
    """SELECT g.target_key, g.snapshot_id, CASE WHEN g.prev_ts IS NULL THEN 'Initial scan' WHEN g.delta > 0 THEN 'Growth' WHEN g.delta < 0 THEN 'Reduction' ELSE 'No change' END AS change,
         COALESCE(v.base_n >= 5 AND v.delta >= 524288000 AND v.rate > v.med AND v.z > 3.5, FALSE) AS is_anomaly
       FROM {grown} g LEFT JOIN {verdicts} v USING (target_key, snapshot_id)""",
)
add(
    "e10_history_rows",
    lambda t: history.history_rows(t.snapshots).groupBy("target_key", "change").agg(F.count("*").alias("n"), F.coalesce(F.sum("delta_bytes"), F.lit(0)).alias("delta")),
    """SELECT target_key, CASE WHEN prev_ts IS NULL THEN 'Initial scan' WHEN delta > 0 THEN 'Growth' WHEN delta < 0 THEN 'Reduction' ELSE 'No change' END AS change,
         COUNT(*) AS n, CAST(COALESCE(SUM(delta), 0) AS BIGINT) AS delta FROM {grown} GROUP BY ALL""",
)
add(
    "c23_rate_baseline",
    lambda t: history.rate_baseline(t.snapshots).select("target_key", F.round("median_rate", 2).alias("median_rate"), F.round("effective_mad", 2).alias("effective_mad")),
    """SELECT target_key, round(med, 2) AS median_rate, round(GREATEST(median(abs(rate - med)), 10485760.0), 2) AS effective_mad FROM (
         SELECT *, median(rate) OVER (PARTITION BY target_key) AS med FROM {grown} WHERE prev_ts IS NOT NULL) GROUP BY target_key, med""",
)
ORACLE["sub_growth"] = """
  SELECT s.target_key, s.snapshot_id, s.name, s.size AS current_size, COALESCE(p.size, 0) AS previous_size, s.size - COALESCE(p.size, 0) AS delta_bytes
  FROM {subfolders} s JOIN {grown} g USING (target_key, snapshot_id)
  LEFT JOIN {subfolders} p ON p.target_key = s.target_key AND p.snapshot_id = g.prev_id AND p.name = s.name"""
add(
    "d21_subfolder_growth",
    lambda t: history.subfolder_growth(t.snapshots, t.subfolders).select("target_key", "snapshot_id", "name", "current_size", "previous_size", "delta_bytes"),
    "SELECT * FROM {sub_growth}",
)
add(
    "e7_contributors",
    lambda t: history.contributors(t.snapshots, t.subfolders).select("target_key", "snapshot_id", "name", "delta_bytes", "contribution_percent", "rank"),
    """SELECT target_key, snapshot_id, name, delta_bytes, round(delta_bytes * 100.0 / SUM(delta_bytes) OVER w, 1) AS contribution_percent,
         row_number() OVER (PARTITION BY target_key, snapshot_id ORDER BY delta_bytes DESC, name) AS rank
       FROM {sub_growth} WHERE delta_bytes > 0 WINDOW w AS (PARTITION BY target_key, snapshot_id)
       QUALIFY row_number() OVER (PARTITION BY target_key, snapshot_id ORDER BY delta_bytes DESC, name) <= 5""",
)
ORACLE["points"] = """
  SELECT target_key, (epoch_us(ts) - MIN(epoch_us(ts)) OVER w) / 86400000000.0 AS x, total_bytes AS y, ts,
    row_number() OVER (PARTITION BY target_key ORDER BY ts, snapshot_id) AS i, COUNT(*) OVER w AS n
  FROM {snapshots} WINDOW w AS (PARTITION BY target_key)"""
ORACLE["fit"] = """
  SELECT target_key, COUNT(*) AS scans, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
    MAX(x) AS latest_day, arg_max(y, i) AS latest FROM {points} GROUP BY target_key HAVING COUNT(*) >= 3"""
add(
    "c22_regression",
    lambda t: history.regression(t.snapshots).where(F.col("scans") >= 3).select(
        "target_key", "scans", F.round(F.col("slope") / 1e6, 3).alias("slope_mb"), F.round("r_squared", 6).alias("r_squared"),
        F.round(F.col("intercept") / 1e6, 1).alias("intercept_mb"), "latest_bytes"),
    """SELECT target_key, scans, round(slope / 1e6, 3) AS slope_mb, round(r2, 6) AS r_squared, round(intercept / 1e6, 1) AS intercept_mb, latest AS latest_bytes FROM {fit}""",
)
add(
    "f29_threshold_status",
    lambda t: history.threshold_status(history.regression(t.snapshots)).where(F.col("scans") >= 3).select(
        "target_key", "threshold_bytes", "status", F.round("days_to_target", 4).alias("days_to_target")),
    """SELECT target_key, threshold_bytes, CASE WHEN latest >= threshold_bytes THEN 'AlreadyExceeded' WHEN slope <= 0 THEN 'DecreasingOrFlat' WHEN days >= 0 THEN 'Reachable' ELSE 'AlreadyExceeded' END AS status,
         CASE WHEN latest >= threshold_bytes THEN 0 WHEN slope > 0 AND days >= 0 THEN round(days, 4) END AS days_to_target FROM (
         SELECT *, (threshold_bytes - intercept) / slope - latest_day AS days FROM (
           SELECT *, GREATEST(latest + 10737418240, CAST(floor(latest * 1.2::DOUBLE) AS BIGINT)) AS threshold_bytes FROM {fit}))""",
)
add(
    "f30_model_confidence",
    lambda t: history.model_confidence(history.regression(t.snapshots)).where(F.col("scans") >= 3).select(
        "target_key", "confidence", F.round(F.col("monthly_bytes") / 1e6, 2).alias("monthly_mb")),
    """SELECT target_key, CASE WHEN r2 >= 0.8 THEN 'High' WHEN r2 >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence, round(slope * 30.4375 / 1e6, 2) AS monthly_mb FROM {fit}""",
)
ORACLE["holt_steps"] = """
  SELECT p.target_key, p.i, p.n, p.x, p.y::DOUBLE AS level, (q.y - p.y) / GREATEST(q.x - p.x, 0.001) AS trend
  FROM {points} p JOIN {points} q ON q.target_key = p.target_key AND q.i = 2 WHERE p.i = 1 AND p.n >= 3
  UNION ALL
  SELECT target_key, i, n, x, new_level, 0.1 * ((new_level - level) / dt) + 0.9 * trend FROM (
    SELECT p.target_key, p.i, p.n, p.x, h.level, h.trend, GREATEST(p.x - h.x, 0.001) AS dt,
      0.3 * p.y + 0.7 * (h.level + h.trend * GREATEST(p.x - h.x, 0.001)) AS new_level
    FROM holt_steps h JOIN {points} p ON p.target_key = h.target_key AND p.i = h.i + 1) s"""
add(
    "e8_holt",
    lambda t: history.holt(t.snapshots).select("target_key", F.round(F.col("level") / 1e6, 2).alias("level_mb"), F.round(F.col("trend") / 1e6, 2).alias("trend_mb")),
    """SELECT target_key, round(level / 1e6, 2) AS level_mb, round(trend / 1e6, 2) AS trend_mb FROM {holt_steps} WHERE i = n""",
)
add(
    "j7_forecast",
    lambda t: forecast(t.snapshots, t.subfolders)["contributors"].select("target_key", "snapshot_id", "name", "delta_bytes", "rank"),
    """SELECT s.target_key, s.snapshot_id, s.name, s.delta_bytes, row_number() OVER (PARTITION BY s.target_key, s.snapshot_id ORDER BY s.delta_bytes DESC, s.name) AS rank
       FROM {sub_growth} s JOIN {verdicts} v USING (target_key, snapshot_id) WHERE s.delta_bytes > 0
         AND v.base_n >= 5 AND v.delta >= 524288000 AND v.rate > v.med AND v.z > 3.5
       QUALIFY row_number() OVER (PARTITION BY s.target_key, s.snapshot_id ORDER BY s.delta_bytes DESC, s.name) <= 5""",
)
add(
    "j1_storage_report",
    lambda t: reports.storage_report(storage_report(t.entries, t.scan_errors)["folders"], t.scan_errors).select(
        "row_kind", "name", "folder_key", "share_text", "files", "folders"),
    """SELECT 'Folder' AS row_kind, string_split(r.folder_key, '/')[-1] AS name, r.folder_key,
         CASE WHEN r.folder_key = '/estate' THEN '-' ELSE printf('%.1f%%', r.bytes * 100.0 / t.bytes) END AS share_text, r.files, r.folders
       FROM {rolled} r JOIN {rolled} t ON t.folder_key = '/estate'
       UNION ALL SELECT DISTINCT 'Unavailable', string_split(folder_path, '/')[-1], folder_path, '', NULL, NULL FROM {scan_errors}""",
)

# --- path and format functions -------------------------------------------------

add(
    "f1_canonical_path",
    lambda t: t.customer.select(
        F.concat(F.lit("//?/UNC/Server/Share/"), F.translate("c_name", "#", "/"), F.lit("/")).alias("raw")).select(
        "raw", paths.canonical_path("raw").alias("canonical"), paths.path_key("raw").alias("path_key")),
    """SELECT raw, replace(canonical, '/', chr(92)) AS canonical, lower(canonical) AS path_key FROM (
         SELECT '//?/UNC/Server/Share/' || replace(c_name, '#', '/') || '/' AS raw, '//Server/Share/' || replace(c_name, '#', '/') AS canonical FROM {customer})""",
)
add(
    "f1_map_drives",
    lambda t: paths.map_drives(
        t.customer.select(F.concat(F.when(F.col("c_nationkey") < 10, "Z:/").otherwise("y:/"), F.col("c_name")).alias("path")),
        t.region.where("r_regionkey = 0").select(F.lit("z:").alias("drive"), F.concat(F.lit("\\\\nas\\"), "r_name").alias("remote"))),
    """SELECT CASE WHEN c_nationkey < 10 THEN chr(92) || chr(92) || 'nas' || chr(92) || 'AFRICA' ELSE 'y:' END || chr(92) || c_name AS path FROM {customer}""",
)
add(
    "f2_volume_root",
    lambda t: t.customer.select(
        F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("\\\\srv\\"), F.col("c_mktsegment"), F.lit("\\"), F.col("c_name")))
        .when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("d:/"), F.col("c_name"))).otherwise(F.col("c_name")).alias("p")
    ).groupBy(paths.volume_root("p").alias("root"), paths.is_network_path("p").alias("network")).agg(F.count("*").alias("n")),
    """SELECT CASE c_nationkey % 3 WHEN 0 THEN chr(92) || chr(92) || 'srv' || chr(92) || c_mktsegment WHEN 1 THEN 'D:' ELSE 'DEFAULT' END AS root,
         c_nationkey % 3 = 0 AS network, COUNT(*) AS n FROM {customer} GROUP BY ALL""",
)
add(
    "f3_path_parts",
    lambda t: t.estate.where(~F.col("is_dir")).select(
        "path_key", paths.extension("name").alias("ext"), paths.base_of("name").alias("base"), paths.parent_key("path_key").alias("parent"),
        paths.components("path_key").alias("parts"), F.array_join(paths.ancestor_array("path_key"), "|").alias("ancestors")),
    """SELECT path_key, regexp_extract(lower(name), '(\\.[^.]+)$', 1) AS ext, regexp_replace(name, '\\.[^.]*$', '') AS base,
         regexp_replace(path_key, '/[^/]*$', '') AS parent, len(string_split(path_key, '/')) AS parts,
         array_to_string(list_transform(range(1, len(string_split(path_key, '/'))), lambda i: array_to_string(string_split(path_key, '/')[1:i], '/')), '|') AS ancestors
       FROM {estate} WHERE NOT is_dir""",
)
add(
    "f14_formats",
    lambda t: t.entries.where(~F.col("is_dir")).select(
        "path_key", formats.format_bytes(F.col("size") * 1000, 2).alias("size_text"), formats.format_duration("size").alias("duration"),
        formats.format_count(F.when(F.col("ext") != ".tmp", F.col("size"))).alias("count_text")),
    """SELECT path_key, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KB', round_even(b / 1024.0, 2))
           WHEN b < 1073741824 THEN printf('%.2f MB', round_even(b / 1048576.0, 2)) ELSE printf('%.2f GB', round_even(b / 1073741824.0, 2)) END AS size_text,
         CASE WHEN size >= 86400 THEN (size // 86400) || 'd ' || (size // 3600 % 24) || 'h ' || (size // 60 % 60) || 'm'
           WHEN size >= 3600 THEN (size // 3600) || 'h ' || (size // 60 % 60) || 'm' WHEN size >= 60 THEN (size // 60) || 'm ' || (size % 60) || 's'
           ELSE GREATEST(size, 1) || 's' END AS duration,
         CASE WHEN ext = '.tmp' THEN 'Unmeasured (-)' ELSE format('{:,}', size) || ' files' END AS count_text
       FROM (SELECT *, size * 1000 AS b FROM {entries} WHERE NOT is_dir)""",
)
