"""Effective access, access-list changes, principals."""

from pyspark.sql import functions as F

from filetide.functions import rights
from filetide.operators import access, acl_diff, directory
from filetide.plans.access import access_counts, acl_change_plan, acl_verify, effective_access
from filetide.sources import reports

from .registry import ORACLE, add, once

# --- memberships ------------------------------------------------------------------


@once
def closure(t):
    return access.group_closure(t.member_of)


def matched(t, accounts):
    return access.matched_aces(t.aces, access.tokens(accounts, closure(t), t.principals))


@once
def group_rights(t):
    return access.effective_rights(matched(t, t.group_accounts))


ORACLE["reach"] = """
  SELECT member_sid, group_sid, 1 AS depth FROM {member_of}
  UNION ALL SELECT r.member_sid, m.group_sid, r.depth + 1 FROM reach r JOIN {member_of} m ON m.member_sid = r.group_sid WHERE r.depth < 6"""
ORACLE["closure"] = "SELECT member_sid, group_sid, MIN(depth) AS depth FROM {reach} GROUP BY ALL"
add("d7_group_closure", lambda t: closure(t), "SELECT member_sid, group_sid, depth FROM {closure}")
add("d8_primary_groups", lambda t: access.with_primary_groups(t.member_of, t.primary_groups),
    "SELECT member_sid, group_sid FROM {member_of} UNION SELECT sid, 'S-1-5-21-7-513' FROM {primary_groups} WHERE primary_group_id IS NOT NULL")
add("k11_memberships", lambda t: access.memberships(t.group_accounts, closure(t), t.principals).select("target", "group_account", "depth", "is_direct"),
    """SELECT a.target, p.account AS group_account, c.depth, c.depth = 1 AS is_direct FROM {group_accounts} a JOIN {closure} c ON c.member_sid = a.sid
       LEFT JOIN {principals} p ON p.sid = c.group_sid""")

# --- matching and evaluation --------------------------------------------------------

_MATCH = """
  SELECT target, path_key, ace_order, rights, access_type, is_inherited, prop_flags, MIN(rank) AS rank FROM (
    SELECT a.target, e.*, 0 AS rank FROM {aces} e JOIN {%(who)s} a ON lower(e.sid) = lower(a.sid) OR lower(e.account) = lower(a.account)
      OR (NOT contains(a.account, chr(92)) AND lower(string_split(e.account, chr(92))[-1]) = lower(a.account))
    UNION ALL SELECT a.target, e.*, 1 FROM {%(who)s} a JOIN {closure} c ON c.member_sid = a.sid JOIN {principals} p ON p.sid = c.group_sid
      JOIN {aces} e ON lower(e.sid) = lower(p.sid) OR lower(e.account) = lower(p.account)
    UNION ALL SELECT a.target, e.*, 2 FROM {aces} e, {%(who)s} a WHERE lower(string_split(e.account, chr(92))[-1]) IN ('everyone', 'authenticated users'))
  GROUP BY ALL"""
_BITS = """
  SELECT target, path_key, bit, arg_min(access_type, ace_order) AS kind, arg_min(is_inherited, ace_order) AS inh FROM {%(m)s},
    (SELECT unnest(range(0, 31)) AS bit) b WHERE prop_flags & 2 = 0 AND (rights >> bit) & 1 = 1 GROUP BY ALL"""
_RIGHTS = """
  SELECT * FROM (SELECT *, CASE WHEN allowed & 2032127 = 2032127 THEN 'FullControl' WHEN allowed & 197055 = 197055 THEN 'Modify'
      WHEN allowed & 852310 <> 0 THEN 'Custom' WHEN allowed & 131241 = 131241 THEN 'ReadAndExecute' WHEN allowed & 131209 = 131209 OR allowed & 1 = 1 THEN 'Read'
      WHEN allowed & ~1048576 <> 0 THEN 'Custom' ELSE 'None' END AS level FROM (
    SELECT target, path_key, CAST(SUM(CASE WHEN kind = 'Allow' THEN 1 << bit ELSE 0 END) AS INT) AS allowed, CAST(SUM(CASE WHEN kind = 'Deny' THEN 1 << bit ELSE 0 END) AS INT) AS denied,
      SUM(CASE WHEN kind = 'Allow' AND NOT inh THEN 1 ELSE 0 END) = 0 AS is_inherited FROM {%(b)s} GROUP BY ALL)) WHERE allowed <> 0 AND level <> 'None'"""
for _who, _tag in (("group_accounts", "g"), ("accounts", "u")):
    ORACLE[f"match_{_tag}"] = _MATCH % {"who": _who}
    ORACLE[f"bits_{_tag}"] = _BITS % {"m": f"match_{_tag}"}
    ORACLE[f"rights_{_tag}"] = _RIGHTS % {"b": f"bits_{_tag}"}
add("d6_matched_entries", lambda t: matched(t, t.group_accounts).select("target", "path_key", "ace_order", "rank"),
    "SELECT target, path_key, ace_order, rank FROM {match_g}")
add("f23_world_principals", lambda t: matched(t, t.group_accounts).where("rank = 2").groupBy("target").agg(F.count("*").alias("n")),
    "SELECT target, COUNT(*) AS n FROM {match_g} WHERE rank = 2 GROUP BY ALL")
add("f22_effective_rights", lambda t: group_rights(t).select("target", "path_key", "level", "allowed", "denied", "is_inherited"),
    "SELECT target, path_key, level, allowed, denied, is_inherited FROM {rights_g}")
add("f22_rights_by_fold", lambda t: access.rights_by_fold(matched(t, t.group_accounts)).where("allowed <> 0").select("target", "path_key", "allowed", "denied"),
    "SELECT target, path_key, allowed, denied FROM {rights_g}")
add("f24_grant_trace", lambda t: group_rights(t).select("target", "path_key", F.size(F.split("grant_trace", " / ")).alias("traces"),
    F.substring_index("grant_source", ":", 1).alias("source")),
    """SELECT target, path_key, n AS traces, CASE first_rank WHEN 0 THEN 'Direct' WHEN 1 THEN 'Group' ELSE 'Special' END AS source FROM (
         SELECT r.target, r.path_key, COUNT(DISTINCT (e.account, m.is_inherited)) AS n, arg_min(m.rank, m.ace_order) AS first_rank FROM {rights_g} r
           JOIN (SELECT DISTINCT target, path_key, ace FROM (SELECT target, path_key, bit, arg_min(access_type, ace_order) AS kind, MIN(ace_order) AS ace FROM {match_g},
             (SELECT unnest(range(0, 31)) AS bit) b WHERE prop_flags & 2 = 0 AND (rights >> bit) & 1 = 1 GROUP BY ALL) WHERE kind = 'Allow') w
             ON w.target = r.target AND w.path_key = r.path_key
           JOIN {match_g} m ON m.target = r.target AND m.path_key = r.path_key AND m.ace_order = w.ace
           JOIN {aces} e ON e.path_key = r.path_key AND e.ace_order = w.ace GROUP BY ALL)""")
_ITEMS = """
  SELECT r.target, r.path_key, r.level, r.allowed, CASE WHEN f.depth = 0 THEN 'Baseline' WHEN NOT p.readable THEN 'Unknown' WHEN q.level IS NULL THEN 'EnclaveGranted'
      WHEN r.level = q.level AND r.allowed = q.allowed THEN CASE WHEN r.is_inherited THEN 'InheritedSame' ELSE 'ExplicitBoundary' END ELSE 'PermissionChanged' END AS change_type
  FROM {%(r)s} r JOIN {folder_acl} f ON f.path_key = r.path_key AND f.readable LEFT JOIN {folder_acl} p ON p.path_key = f.parent_key
    LEFT JOIN {%(r)s} q ON q.target = r.target AND q.path_key = f.parent_key
  UNION ALL SELECT q.target, f.path_key, 'None', 0, 'InheritanceSevered' FROM {folder_acl} f JOIN {%(r)s} q ON q.path_key = f.parent_key
    WHERE f.readable AND NOT EXISTS (SELECT 1 FROM {%(r)s} r WHERE r.target = q.target AND r.path_key = f.path_key)
  UNION ALL SELECT a.target, f.path_key, 'None', 0, 'ScanUnavailable' FROM {folder_acl} f JOIN {%(a)s} a ON a.root_key = f.root_key WHERE NOT f.readable"""
ORACLE["items_g"] = _ITEMS % {"r": "rights_g", "a": "group_accounts"}
ORACLE["items_u"] = _ITEMS % {"r": "rights_u", "a": "accounts"}


def items(t):
    return access.change_points(group_rights(t), t.folder_acl, t.group_accounts)


add("d9_parent_access", lambda t: items(t).where("change_type IN ('InheritedSame', 'PermissionChanged')").select("target", "path_key", "change_type"),
    "SELECT target, path_key, change_type FROM {items_g} WHERE change_type IN ('InheritedSame', 'PermissionChanged')")
add("f25_change_points", lambda t: items(t).select("target", "path_key", "level", "allowed", "change_type"), "SELECT * FROM {items_g}")
add("u1_all_items", lambda t: items(t).groupBy("change_type").agg(F.count("*").alias("n")), "SELECT change_type, COUNT(*) AS n FROM {items_g} GROUP BY ALL")
add("b23_access_filter", lambda t: items(t).where(access.item_filter("Asia", changes_only=True)).select("target", "path_key", "change_type"),
    "SELECT target, path_key, change_type FROM {items_g} WHERE change_type NOT IN ('InheritedSame', 'Baseline') AND contains(path_key, 'asia')")
add("c17_report_counts", lambda t: access_counts(t.folder_acl, t.aces, t.member_of, t.principals, t.accounts).select(
    "target", "full_control", "modify", "custom", "read_only", "enclave", "severed", "unavailable", "accessible"),
    """SELECT target, COUNT(*) FILTER (WHERE level = 'FullControl') AS full_control, COUNT(*) FILTER (WHERE level = 'Modify') AS modify, COUNT(*) FILTER (WHERE level = 'Custom') AS custom,
         COUNT(*) FILTER (WHERE level IN ('Read', 'ReadAndExecute')) AS read_only, COUNT(*) FILTER (WHERE change_type = 'EnclaveGranted') AS enclave,
         COUNT(*) FILTER (WHERE change_type = 'InheritanceSevered') AS severed, COUNT(*) FILTER (WHERE change_type = 'ScanUnavailable') AS unavailable,
         COUNT(*) FILTER (WHERE level <> 'None') AS accessible FROM {items_u} GROUP BY ALL""")
add("j5_effective_access", lambda t: reports.access_ledger(effective_access(t.folder_acl, t.aces, t.member_of, t.principals, t.group_accounts)["items"]).select(
    "target", "path_key", "level", "change_type"), "SELECT target, path_key, level, change_type FROM {items_g}")
add("c18_rights_union", lambda t: access.rights_union(t.aces),
    """SELECT path_key, sid, COALESCE(bit_or(rights) FILTER (WHERE access_type = 'Allow'), 0) AS allow_bits,
         COALESCE(bit_or(rights) FILTER (WHERE access_type = 'Deny'), 0) AS deny_bits FROM {aces} GROUP BY ALL""")
add("f16_rights_level", lambda t: t.aces.select("path_key", "ace_order", rights.level("rights").alias("level")),
    """SELECT path_key, ace_order, CASE rights WHEN 1179817 THEN 'ReadAndExecute' WHEN 1245631 THEN 'Modify' WHEN 278 THEN 'Custom' WHEN 2032127 THEN 'FullControl'
         WHEN 197055 THEN 'Modify' WHEN 131241 THEN 'ReadAndExecute' WHEN 131209 THEN 'Read' END AS level FROM {aces}""")
add("f17_rights_labels", lambda t: t.aces.groupBy("rights", rights.friendly("rights").alias("friendly"), rights.basic("rights").alias("basic"), *rights.flags("rights")).agg(F.count("*").alias("n")),
    """SELECT rights, CASE rights WHEN 1179817 THEN 'Read & Execute' WHEN 1245631 THEN 'Modify (Read/Write/Delete)' WHEN 278 THEN 'Write Only' WHEN 2032127 THEN 'Full Control'
         WHEN 197055 THEN 'Modify (Read/Write/Delete)' WHEN 131241 THEN 'Read & Execute' ELSE 'Read Only' END AS friendly,
       CASE rights WHEN 1179817 THEN 'Read & Execute' WHEN 1245631 THEN 'Modify' WHEN 278 THEN 'Write' WHEN 2032127 THEN 'Full Control' WHEN 197055 THEN 'Modify' WHEN 131241 THEN 'Read & Execute' ELSE 'Read' END AS basic, """
    + ", ".join(f"rights & {bit} = {bit} AS {name}" for name, bit in rights.BITS.items()) + ", COUNT(*) AS n FROM {aces} GROUP BY ALL")
add("f18_applies_to",
    lambda t: t.aces.select("path_key", "ace_order", rights.applies_to("inherit_flags", "prop_flags").alias("scope")).withColumn("back", rights.from_applies_to("scope")).select(
        "path_key", "ace_order", "scope", F.col("back.inherit_flags").alias("inherit_back"), F.col("back.prop_flags").alias("prop_back")),
    """SELECT path_key, ace_order, CASE prop_flags WHEN 0 THEN 'This folder, subfolders and files' ELSE 'Subfolders and files only' END AS scope, 3 AS inherit_back, prop_flags AS prop_back FROM {aces}""")
add("f19_rights_without_synchronize", lambda t: t.aces.groupBy(rights.without_synchronize("rights").alias("plain"), rights.same_rights("rights", F.lit(131241)).alias("is_rx")).agg(F.count("*").alias("n")),
    "SELECT rights & ~1048576 AS plain, rights & ~1048576 = 131241 AS is_rx, COUNT(*) AS n FROM {aces} GROUP BY ALL")

# --- access lists as tables, changes ---------------------------------------------------

add("a17_flatten_acl", lambda t: reports.acl_matrix(access.flatten_acl(t.folder_acl, t.aces, 3)).select("path_key", "account", "access_type", "rights_bits"),
    """SELECT f.path_key, a.account, a.access_type, a.rights AS rights_bits FROM {folder_acl} f LEFT JOIN {aces} a USING (path_key) WHERE readable
       UNION ALL SELECT path_key, '[UNAVAILABLE]', 'Error', 0 FROM {folder_acl} WHERE NOT readable""")
add("a18_acl_history", lambda t: access.acl_history(t.acl_snapshots.unionByName(t.acl_snapshots)).select("path_key", "snapshot_id", "sddl"),
    "SELECT path_key, snapshot_id, sddl FROM {acl_snapshots}")
_KEYED = "COALESCE(lower(e.sid), lower(p.sid), lower(e.account))"
for _t in ("aces", "aces_after"):
    ORACLE[f"{_t}_keyed"] = f"""SELECT e.*, {_KEYED} AS k, e.rights & ~1048576 AS plain, f.inherit_before AND NOT f.inherit_after AS off FROM {{{_t}}} e JOIN {{acl_flags}} f USING (path_key)
      LEFT JOIN {{principals}} p ON lower(p.account) = lower(e.account)"""
    ORACLE[f"{_t}_comp"] = (f"SELECT *, row_number() OVER (PARTITION BY path_key, k, access_type, inherit_flags, prop_flags, plain ORDER BY ace_order) AS no FROM {{{_t}_keyed}} WHERE off OR NOT is_inherited")
ORACLE["acl_pairs"] = """
  SELECT COALESCE(b.path_key, a.path_key) AS path_key, COALESCE(b.k, a.k) AS k, COALESCE(b.access_type, a.access_type) AS access_type, COALESCE(b.prop_flags, a.prop_flags) AS prop_flags,
    b.rights AS br, a.rights AS ar, b.ace_order AS bo, a.ace_order AS ao FROM {aces_comp} b FULL JOIN {aces_after_comp} a ON a.path_key = b.path_key AND a.k = b.k AND a.access_type = b.access_type
    AND a.inherit_flags = b.inherit_flags AND a.prop_flags = b.prop_flags AND a.plain = b.plain AND a.no = b.no"""
ORACLE["acl_changes"] = """
  SELECT path_key, k AS account_key, 'Untouched' AS diff_type, br AS before_rights, ar AS after_rights FROM {acl_pairs} WHERE bo IS NOT NULL AND ao IS NOT NULL
  UNION ALL SELECT COALESCE(x.path_key, y.path_key), COALESCE(x.k, y.k), CASE WHEN x.br IS NULL THEN 'Added' WHEN y.ar IS NULL THEN 'Removed' ELSE 'Modified' END, x.br, y.ar FROM
    (SELECT *, row_number() OVER (PARTITION BY path_key, k, access_type, prop_flags ORDER BY bo) AS n FROM {acl_pairs} WHERE ao IS NULL) x FULL JOIN
    (SELECT *, row_number() OVER (PARTITION BY path_key, k, access_type, prop_flags ORDER BY ao DESC) AS n FROM {acl_pairs} WHERE bo IS NULL) y
    ON x.path_key = y.path_key AND x.k = y.k AND x.access_type = y.access_type AND x.prop_flags = y.prop_flags AND x.n = y.n"""


def changes(t):
    return acl_change_plan(t.aces, t.aces_after, t.acl_flags, t.principals)["changes"]


add("d10_acl_multiset_diff", lambda t: changes(t).select("path_key", "account_key", "diff_type", "before_rights", "after_rights"), "SELECT * FROM {acl_changes}")
add("d13_account_keys", lambda t: acl_diff.with_account_key(t.aces, t.principals).select("path_key", "ace_order", "account_key"),
    f"SELECT e.path_key, e.ace_order, {_KEYED} AS account_key FROM {{aces}} e LEFT JOIN {{principals}} p ON lower(p.account) = lower(e.account)")
add("f20_rights_delta", lambda t: changes(t).where("diff_type = 'Modified'").select("path_key", "account_key", "detail"),
    "SELECT path_key, account_key, '+Delete, +Write' AS detail FROM {acl_changes} WHERE diff_type = 'Modified' AND before_rights = 131209 AND after_rights = 197055")
add("f21_promoted_entries", lambda t: acl_diff.promoted_counts(t.aces, t.acl_flags),
    """SELECT path_key, CASE WHEN inherit_before AND NOT inherit_after THEN (SELECT COUNT(*) FROM {aces} a WHERE a.path_key = f.path_key AND is_inherited) ELSE 0 END AS promoted FROM {acl_flags} f""")
_FLAG = lambda t: t.acl_flags.select("path_key", F.col("inherit_after").alias("inherit"))
_HAVE = lambda t: t.acl_flags.select("path_key", F.col("inherit_before").alias("inherit"))
add("d11_acl_verify", lambda t: acl_verify(changes(t), t.aces, _FLAG(t), _HAVE(t), t.principals).groupBy("path_key", "problem").agg(F.count("*").alias("n")),
    """SELECT path_key, problem, COUNT(*) AS n FROM (
         SELECT path_key, 'Missing' AS problem FROM ({want} EXCEPT ALL {have}) UNION ALL SELECT path_key, 'Unexpected' FROM ({have} EXCEPT ALL {want})
         UNION ALL SELECT path_key, 'InheritanceMismatch' FROM {acl_flags} WHERE inherit_before <> inherit_after) GROUP BY ALL"""
    .replace("{want}", "SELECT path_key, k, access_type, inherit_flags, prop_flags, plain FROM {aces_after_comp}")
    .replace("{have}", f"SELECT e.path_key, {_KEYED} AS k, access_type, inherit_flags, prop_flags, rights & ~1048576 AS plain FROM {{aces}} e LEFT JOIN {{principals}} p ON lower(p.account) = lower(e.account) WHERE NOT is_inherited"))
add("u3_multiset_difference", lambda t: t.aces.select("path_key", "sid", "rights").exceptAll(t.aces_after.select("path_key", "sid", "rights")).groupBy("rights").agg(F.count("*").alias("n")),
    "SELECT rights, COUNT(*) AS n FROM (SELECT path_key, sid, rights FROM {aces} EXCEPT ALL SELECT path_key, sid, rights FROM {aces_after}) GROUP BY ALL")
add("j6_acl_change_counts", lambda t: changes(t).groupBy("diff_type").agg(F.count("*").alias("n")), "SELECT diff_type, COUNT(*) AS n FROM {acl_changes} GROUP BY ALL")
add("d12_conflicts",
    lambda t: acl_diff.conflicts(
        t.acl_snapshots.groupBy("path_key").agg(F.min_by("sddl", F.struct("ts", "snapshot_id")).alias("sddl")),
        t.acl_snapshots.groupBy("path_key").agg(F.max_by("sddl", F.struct("ts", "snapshot_id")).alias("sddl"))).select("path_key", "sddl", "current_sddl"),
    """SELECT * FROM (SELECT path_key, first(sddl ORDER BY ts, snapshot_id) AS sddl, last(sddl ORDER BY ts, snapshot_id) AS current_sddl FROM {acl_snapshots} GROUP BY ALL)
       WHERE lower(sddl) <> lower(current_sddl)""")

# --- principals ---------------------------------------------------------------------------

add("f39_principal_search", lambda t: directory.search_principals(t.principals, "NATION_1", users=False).select("sid", "display"),
    "SELECT sid, display FROM {principals} WHERE kind = 'group' AND (contains(lower(account), 'nation_1') OR contains(lower(display), 'nation_1'))")
add("f39_principals_in_unit", lambda t: directory.principals_in_ou(t.principals, "OU=ASIA,DC=corp", subtree=True).select("sid"),
    "SELECT sid FROM {principals} WHERE contains(dn, ',OU=ASIA,DC=corp')")
add("f39_unit_tree", lambda t: directory.ou_tree(t.ous), "SELECT dn, name, regexp_replace(dn, '^[^,]*,', '') AS parent_dn, len(string_split(dn, ',')) AS depth FROM {ous}")
