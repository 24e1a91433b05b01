"""Canonical tables made from the given ones, in SQL that Spark and DuckDB both accept.

``{name}`` is a table: a given one or another of this file. Spark gets each as a
DataFrame, DuckDB as a common table expression. Sizes from doubles are floored
per row because the engines cast differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from filetide.session import SCAN_BYTES, cut_lineage

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

ESTATE_COLUMNS = (
    "root_key, snapshot_id, path, path_key, parent_key, name, ext, is_dir, size, created_at, modified_at, accessed_at, "
    "attributes, physical_id, level, sha256"
)


def _entry(root: str, path: str, parent: str, name: str, ext: str, size: str, created: str, modified: str, accessed: str,
           level: int, physical: str = "NULL", sha: str = "NULL", is_dir: bool = False, attributes: str = "32") -> str:
    return f"""
    SELECT '{root}' AS root_key, 's1' AS snapshot_id, {path} AS path, lower({path}) AS path_key, lower({parent}) AS parent_key,
      {name} AS name, {ext} AS ext, {str(is_dir).upper()} AS is_dir, CAST({size} AS BIGINT) AS size,
      CAST({created} AS TIMESTAMP) AS created_at, CAST({modified} AS TIMESTAMP) AS modified_at,
      CAST({accessed} AS TIMESTAMP) AS accessed_at, CAST({attributes} AS INT) AS attributes,
      CAST({physical} AS STRING) AS physical_id, CAST({level} AS INT) AS level, CAST({sha} AS STRING) AS sha256"""


def _folder(path: str, parent: str, name: str, level: int, attributes: str = "16") -> str:
    stamp = f"TIMESTAMP '2001-01-01 00:00:00' + (length({path}) % 100) * INTERVAL '1' DAY"
    return _entry("/estate", path, parent, name, "''", "0", stamp, stamp, stamp, level, is_dir=True, attributes=attributes)


_R = "'/estate/' || r_name"
_N = f"{_R} || '/' || n_name"
_C = f"{_N} || '/' || c_name"
_O = f"{_C} || '/order_' || CAST(o_orderkey AS STRING)"
_PLACES = "{customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_SID = "'S-1-5-21-7-' || CAST({} AS STRING)"
_USER, _NATION, _REGION = (_SID.format(x) for x in ("100000 + c_custkey", "5000 + n_nationkey", "1000 + r_regionkey"))
_ALL = "'S-1-5-21-7-513'"
_CORP = "'CORP' || chr(92) || "


def _ace(path: str, order: int, sid: str, account: str, rights: str, kind: str = "Allow", inherited: str = "FALSE", prop: str = "0") -> str:
    return f"""
    SELECT lower({path}) AS path_key, CAST({order} AS INT) AS ace_order, {sid} AS sid, {account} AS account,
      CAST({rights} AS INT) AS rights, '{kind}' AS access_type, {inherited} AS is_inherited, CAST(3 AS INT) AS inherit_flags,
      CAST({prop} AS INT) AS prop_flags"""


_RX, _MOD, _WRITE = "1179817", "1245631", "278"
_OWN = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 2032127 WHEN 'AUTOMOBILE' THEN 197055 WHEN 'MACHINERY' THEN 131241 "
    "WHEN 'HOUSEHOLD' THEN 131209 ELSE 278 END"
)
_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

SHARED: dict[str, str] = {
    # --- the estate: region / nation / customer / order / line -------------
    "lines": """
    SELECT r_name, n_name, c_custkey, c_name, o_orderkey, o_orderdate, l_linenumber, l_partkey, l_suppkey, l_returnflag,
      CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes, MAX(l_shipdate) AS shipped,
      MAX(CAST(l_quantity AS INT)) AS quantity
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
      JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name, c_custkey, c_name, o_orderkey, o_orderdate, l_linenumber, l_partkey, l_suppkey, l_returnflag""",
    "estate_files": """
    SELECT *, 'line_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING)
        || CASE l_returnflag WHEN 'A' THEN '.zip' WHEN 'N' THEN '.txt' ELSE '.tmp' END AS fname,
      CASE l_returnflag WHEN 'A' THEN '.zip' WHEN 'N' THEN '.txt' ELSE '.tmp' END AS fext
    FROM {lines}""",
    "entries": "\nUNION ALL".join([
        _folder("'/estate'", "CAST(NULL AS STRING)", "'estate'", 0),
        _folder(_R, "'/estate'", "r_name", 1) + " FROM {region}",
        _folder(_N, _R, "n_name", 2) + " FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
        _folder(_C, _N, "c_name", 3, "CASE WHEN c_custkey % 37 = 5 THEN 1040 ELSE 16 END") + " FROM " + _PLACES,
        _folder(_O, _C, "'order_' || CAST(o_orderkey AS STRING)", 4)
        + " FROM (SELECT DISTINCT r_name, n_name, c_name, o_orderkey FROM {lines}) o",
        _entry("/estate", f"{_O} || '/' || fname", _O, "fname", "fext", "bytes", "o_orderdate", "shipped",
               "shipped + quantity * INTERVAL '1' DAY", 5,
               sha="CASE WHEN l_partkey % 3 = 0 THEN md5(CAST(l_partkey AS STRING)) END") + " FROM {estate_files}",
    ]),
    # One archive beside each order folder; half of them with a double extension.
    "archives": _entry(
        "/estate", f"{_O} || ext", _C, "'order_' || CAST(o_orderkey AS STRING) || ext",
        "CASE WHEN ext = '.zip' THEN '.zip' ELSE '.xz' END", "floor(o_totalprice)", "o_orderdate", "o_orderdate", "o_orderdate", 4,
    ) + " FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '.zip' ELSE '.tar.xz' END AS ext FROM {orders} JOIN "
    + _PLACES.replace("{customer}", "{customer} ON o_custkey = c_custkey", 1) + ") a",
    "estate": f"SELECT {ESTATE_COLUMNS} FROM {{entries}} UNION ALL SELECT {ESTATE_COLUMNS} FROM {{archives}}",
    "previous": """
    SELECT root_key, 's0' AS snapshot_id, path, path_key, parent_key, name, ext, is_dir,
      CASE WHEN is_dir THEN size ELSE size - (length(name) % 7) END AS size, created_at,
      CASE WHEN length(name) % 5 = 0 THEN modified_at + INTERVAL '1' DAY ELSE modified_at END AS modified_at, accessed_at,
      attributes, physical_id, level, CASE WHEN is_dir THEN NULL ELSE md5(path) END AS sha256
    FROM {entries} WHERE is_dir OR name NOT LIKE 'line_1_%'""",
    "scan_errors": f"""
    SELECT '/estate' AS root_key, 's1' AS snapshot_id, {_C} AS folder_path, 'denied' AS error FROM {_PLACES} WHERE c_acctbal < 0
    UNION ALL SELECT '/estate', 's1', {_C}, 'timeout' FROM {_PLACES} WHERE c_acctbal < -500""",
    "scans": """
    SELECT root_key, snapshot_id, MAX(modified_at) AS ts FROM {entries} GROUP BY root_key, snapshot_id
    UNION ALL SELECT root_key, snapshot_id, MAX(modified_at) - INTERVAL '9' DAY FROM {previous} GROUP BY root_key, snapshot_id""",
    "ignores": """
    SELECT path_key, CASE WHEN length(name) % 2 = 0 THEN size ELSE size + 1 END AS size, modified_at
    FROM {entries} WHERE NOT is_dir AND ext = '.txt'""",
    "volumes": """
    SELECT 'vol_' || CAST(s_suppkey AS STRING) AS volume, CAST(1000 + s_suppkey * 7 AS BIGINT) AS total_bytes,
      CAST(floor(abs(s_acctbal)) AS BIGINT) % 400 AS available_bytes FROM {supplier}""",
    # --- documents ----------------------------------------------------------
    "docs": _entry(
        "/docs", "folder || '/' || dname", "folder", "dname", "'.txt'", "bit_length(text) / 8",
        "TIMESTAMP '2014-01-01 00:00:00' + (doc_id * 31 % 3000) * INTERVAL '1' DAY",
        "TIMESTAMP '2015-01-01 00:00:00' + (doc_id * 37 % 3300) * INTERVAL '1' DAY",
        "TIMESTAMP '2015-06-01 00:00:00' + (doc_id * 41 % 3300) * INTERVAL '1' DAY", 3,
        physical="CASE WHEN doc_id % 3 = 0 THEN 'V1-' || CAST(n_chars AS STRING) END",
    ) + """ FROM (SELECT *, '/docs/' || lang || '/' || source AS folder, 'doc_' || CAST(doc_id AS STRING)
        || CASE doc_id % 4 WHEN 1 THEN ' - コピー' WHEN 2 THEN ' (1)' ELSE '' END || '.txt' AS dname FROM {documents}) d""",
    "file_text": """
    SELECT lower('/docs/' || lang || '/' || source || '/doc_' || CAST(doc_id AS STRING)
        || CASE doc_id % 4 WHEN 1 THEN ' - コピー' WHEN 2 THEN ' (1)' ELSE '' END || '.txt') AS path_key, text FROM {documents}""",
    # --- version families ---------------------------------------------------
    "parts": _entry(
        "/parts", "folder || '/' || pname", "folder", "pname", "'.txt'", "p_size * 1000",
        "TIMESTAMP '2000-01-01 00:00:00'", "TIMESTAMP '2000-01-01 00:00:00' + CAST(floor(p_retailprice) AS INT) * INTERVAL '1' DAY",
        "TIMESTAMP '2000-01-01 00:00:00' + CAST(floor(p_retailprice) AS INT) * INTERVAL '1' DAY", 2,
    ) + """ FROM (SELECT *, '/parts/' || p_type AS folder, 'part_' || p_brand || CASE p_partkey % 6
          WHEN 0 THEN 'x' || CAST(p_partkey AS STRING) WHEN 1 THEN '_v' || CAST(p_size AS STRING) || '.' || CAST(p_partkey AS STRING)
          WHEN 2 THEN '_20240105_' || CAST(p_partkey AS STRING) WHEN 3 THEN ' - コピー (' || CAST(p_partkey AS STRING) || ')'
          WHEN 4 THEN '_最終_rev' || CAST(p_partkey AS STRING) ELSE '-' || CAST(p_partkey AS STRING) || '-old_fix' END || '.txt' AS pname
        FROM {part}) p""",
    # --- media --------------------------------------------------------------
    "media": _entry(
        "/media", "folder || '/' || mname", "folder", "mname", "mext", "floor(p_retailprice * 3000)",
        "TIMESTAMP '2000-01-01 00:00:00'", "TIMESTAMP '2010-01-01 00:00:00' + p_size * INTERVAL '1' DAY", "TIMESTAMP '2010-01-01 00:00:00'", 2,
    ) + """ FROM (SELECT *, 'm_' || CAST(p_partkey AS STRING) || mext AS mname FROM (
          SELECT *, '/media/' || p_type || CASE WHEN p_size % 9 = 0 THEN '_Master' ELSE '' END AS folder,
            CASE p_partkey % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' WHEN 3 THEN '.mov' WHEN 4 THEN '.psd'
              WHEN 5 THEN '.jpeg' WHEN 6 THEN '.doc' ELSE '.nef' END AS mext FROM {part}) a) m""",
    "optimised": """
    SELECT path_key, CAST(floor(size * 0.6) AS BIGINT) AS optimised_size FROM {media} WHERE ext IN ('.jpg', '.png', '.jpeg')""",
    # --- history ------------------------------------------------------------
    "snapshots": """
    SELECT 'target_' || CAST(user_id AS STRING) AS target_key, 'ev_' || CAST(event_id AS STRING) AS snapshot_id,
      CAST(ts AS TIMESTAMP) AS ts,
      CAST(SUM(CAST(floor(value * 100000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS total_bytes,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS total_files
    FROM {events}""",
    "subfolders": "\nUNION ALL".join(
        f"""
    SELECT 'target_' || CAST(user_id AS STRING) AS target_key, 'ev_' || CAST(event_id AS STRING) AS snapshot_id, '{t}' AS name,
      CAST(SUM(CASE WHEN event_type = '{t}' THEN CAST(floor(value * 100000000) AS BIGINT) ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS size FROM {{events}}""" for t in _EVENT_TYPES),
    # --- access -------------------------------------------------------------
    "folder_acl": f"""
    SELECT '/estate' AS root_key, '/estate' AS path_key, CAST(NULL AS STRING) AS parent_key, 'estate' AS folder_name,
      CAST(0 AS INT) AS depth, FALSE AS protected, TRUE AS readable
    UNION ALL SELECT '/estate', lower({_R}), '/estate', r_name, 1, FALSE, TRUE FROM {{region}}
    UNION ALL SELECT '/estate', lower({_N}), lower({_R}), n_name, 2, FALSE, n_nationkey % 10 <> 4
      FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
    UNION ALL SELECT '/estate', lower({_C}), lower({_N}), c_name, 3, c_custkey % 11 = 0, c_custkey % 17 <> 3 FROM {_PLACES}""",
    "aces": "\nUNION ALL".join([
        _ace(_R, 0, _REGION, _CORP + "'region_' || CAST(r_regionkey AS STRING)", _RX) + " FROM {region}",
        _ace(_N, 0, _NATION, _CORP + "'nation_' || CAST(n_nationkey AS STRING)", _MOD)
        + " FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 10 <> 4",
        _ace(_N, 1, _REGION, _CORP + "'region_' || CAST(r_regionkey AS STRING)", _RX, inherited="TRUE")
        + " FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 10 NOT IN (4, 7)",
        _ace(_C, 0, _NATION, _CORP + "'nation_' || CAST(n_nationkey AS STRING)", _WRITE, "Deny")
        + f" FROM {_PLACES} WHERE c_custkey % 7 = 0 AND c_custkey % 17 <> 3",
        _ace(_C, 1, _USER, _CORP + "'cust_' || CAST(c_custkey AS STRING)", _OWN, prop="CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END")
        + f" FROM {_PLACES} WHERE c_custkey % 17 <> 3",
        _ace(_C, 2, _NATION, _CORP + "'nation_' || CAST(n_nationkey AS STRING)", _MOD, inherited="TRUE")
        + f" FROM {_PLACES} WHERE c_custkey % 11 <> 0 AND c_custkey % 17 <> 3",
        _ace(_C, 3, "'S-1-1-0'", "'Everyone'", _RX) + f" FROM {_PLACES} WHERE c_custkey % 113 = 0 AND c_custkey % 17 <> 3",
        _ace(_C, 4, "CAST(NULL AS STRING)", "'cust_' || CAST(c_custkey AS STRING)", "131209")
        + f" FROM {_PLACES} WHERE c_custkey % 19 = 0 AND c_custkey % 17 <> 3",
        _ace(_C, 5, _REGION, _CORP + "'region_' || CAST(r_regionkey AS STRING)", _MOD) + f" FROM {_PLACES} WHERE c_custkey % 23 = 0 AND c_custkey % 17 <> 3",
    ]),
    "member_of": f"""
    SELECT {_USER} AS member_sid, {_NATION} AS group_sid FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
    UNION ALL SELECT {_NATION}, {_REGION} FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
    UNION ALL SELECT {_REGION}, {_ALL} FROM {{region}}
    UNION ALL SELECT {_ALL}, 'S-1-5-21-7-1000'""",
    "primary_groups": f"SELECT {_USER} AS sid, CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 513 END AS INT) AS primary_group_id FROM {{customer}}",
    "principals": f"""
    SELECT {_USER} AS sid, {_CORP}'cust_' || CAST(c_custkey AS STRING) AS account, 'CORP' AS domain, 'user' AS kind, c_name AS display,
      'CN=' || c_name || ',OU=' || n_name || ',OU=' || r_name || ',DC=corp' AS dn FROM {_PLACES}
    UNION ALL SELECT {_NATION}, {_CORP}'nation_' || CAST(n_nationkey AS STRING), 'CORP', 'group', n_name,
      'CN=' || n_name || ',OU=' || r_name || ',DC=corp' FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
    UNION ALL SELECT {_REGION}, {_CORP}'region_' || CAST(r_regionkey AS STRING), 'CORP', 'group', r_name, 'CN=' || r_name || ',DC=corp' FROM {{region}}
    UNION ALL SELECT {_ALL}, {_CORP}'all_staff', 'CORP', 'group', 'All staff', 'CN=All staff,DC=corp'""",
    "ous": """
    SELECT 'OU=' || r_name || ',DC=corp' AS dn, r_name AS name FROM {region}
    UNION ALL SELECT 'OU=' || n_name || ',OU=' || r_name || ',DC=corp', n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "group_accounts": "SELECT account AS target, account, sid, '/estate' AS root_key FROM {principals} WHERE kind = 'group'",
    "accounts": f"""
    SELECT account AS target, account, sid, '/estate' AS root_key FROM {{principals}} WHERE kind = 'group'
    UNION ALL SELECT 'cust_' || CAST(c_custkey AS STRING),
      CASE WHEN c_custkey % 19 = 0 THEN 'cust_' || CAST(c_custkey AS STRING) ELSE {_CORP}'cust_' || CAST(c_custkey AS STRING) END,
      {_USER}, '/estate' FROM {{customer}}""",
    "aces_after": f"""
    SELECT a.path_key, ace_order, sid, account, CASE WHEN ace_order = 1 AND rights = 131209 THEN 197055 ELSE rights END AS rights,
      access_type, is_inherited, inherit_flags, prop_flags FROM {{aces}} a WHERE NOT (access_type = 'Deny' AND length(account) % 2 = 0)
    UNION ALL
    SELECT lower({_C}), CAST(6 AS INT), {_ALL}, {_CORP}'all_staff', CAST({_RX} AS INT), 'Allow', FALSE, CAST(3 AS INT), CAST(0 AS INT)
    FROM {_PLACES} WHERE c_custkey % 4 = 0 AND c_custkey % 17 <> 3""",
    "acl_flags": f"""
    SELECT lower({_C}) AS path_key, c_custkey % 11 <> 0 AS inherit_before, c_custkey % 11 <> 0 AND c_custkey % 9 <> 0 AS inherit_after
    FROM {_PLACES} WHERE c_custkey % 17 <> 3
    UNION ALL SELECT lower({_N}), TRUE, n_nationkey % 5 <> 0 FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey WHERE n_nationkey % 10 <> 4""",
    "acl_snapshots": f"""
    SELECT 'a' || CAST(o_orderkey AS STRING) AS snapshot_id, lower({_C}) AS path_key, CAST(o_orderdate AS TIMESTAMP) AS ts,
      o_orderpriority AS note, 'D:(' || o_orderstatus || ')' AS sddl FROM {{orders}} JOIN {_PLACES.replace("{customer}", "{customer} ON o_custkey = c_custkey", 1)}""",
    # --- migration ----------------------------------------------------------
    "plan_nodes": f"""
    SELECT 'plan_' || r_name AS plan_id, 'r' || CAST(r_regionkey AS STRING) AS node_id, CAST(NULL AS STRING) AS parent_id,
      CAST(0 AS INT) AS ord, r_name AS name, CAST(0 AS INT) AS level, CAST(90000000000 AS BIGINT) AS est_size,
      CAST(NULL AS BIGINT) AS est_files, TRUE AS inherit_acl FROM {{region}}
    UNION ALL SELECT 'plan_' || r_name, 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(r_regionkey AS STRING), n_nationkey, n_name, 1,
      CAST(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 10000000000 END AS BIGINT),
      CAST(CASE WHEN n_nationkey % 4 = 0 THEN 100 END AS BIGINT), TRUE FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
    UNION ALL SELECT 'plan_' || r_name, 'c' || CAST(c_custkey AS STRING), 'n' || CAST(n_nationkey AS STRING), CAST(c_custkey AS INT), c_name, 2,
      CAST(floor(abs(c_acctbal) * 100000) AS BIGINT), CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 5000 END AS BIGINT),
      c_custkey % 2 = 0 FROM {_PLACES}""",
    "plan_sources": f"""
    SELECT 'plan_' || r_name AS plan_id, 'r' || CAST(r_regionkey AS STRING) AS node_id, {_R} AS source_path FROM {{region}}
    UNION ALL SELECT 'plan_' || r_name, 'c' || CAST(c_custkey AS STRING), {_C} FROM {_PLACES}
    UNION ALL SELECT 'plan_' || r_name, 'c' || CAST(c_custkey AS STRING), '/archive/' || c_name FROM {_PLACES} WHERE c_mktsegment = 'BUILDING'""",
    "plan_aces": f"""
    SELECT 'plan_' || r_name AS plan_id, 'c' || CAST(c_custkey AS STRING) AS node_id, CAST(0 AS INT) AS ace_order,
      {_CORP}'cust_' || CAST(c_custkey AS STRING) AS account, CAST({_OWN} AS INT) AS rights, 'Allow' AS access_type
    FROM {_PLACES} WHERE c_mktsegment <> 'HOUSEHOLD'""",
    "target_entries": f"""
    SELECT root_key, snapshot_id, replace(path, '/estate/', '/target/') AS path, replace(path_key, '/estate/', '/target/') AS path_key,
      replace(parent_key, '/estate/', '/target/') AS parent_key, name, ext, is_dir,
      CASE WHEN NOT is_dir AND length(name) % 13 = 0 THEN size + 1 ELSE size END AS size, created_at, modified_at, accessed_at,
      attributes, physical_id, level, sha256
    FROM {{estate}} WHERE path <> '/estate' AND name NOT LIKE '%7.txt'
    UNION ALL SELECT '/target', 's1', path || '/surplus.dat', path_key || '/surplus.dat', path_key, 'surplus.dat', '.dat', FALSE, CAST(1 AS BIGINT),
      created_at, modified_at, accessed_at, 32, NULL, level, NULL
    FROM (SELECT *  FROM {{estate}} WHERE is_dir AND level IN (2, 3)) s""".replace(
        "SELECT *  FROM", "SELECT replace(path, '/estate/', '/target/') AS path, replace(path_key, '/estate/', '/target/') AS path_key, created_at, modified_at, accessed_at, level, is_dir FROM"),
    # Several nations merged into one folder, with equal, different and mixed-type items.
    "depot": """
    SELECT '/depot' AS root_key, 's1' AS snapshot_id, '/depot/' || n_name || '/file_' || CAST(k AS STRING) || '.txt' AS path,
      lower('/depot/' || n_name || '/file_' || CAST(k AS STRING) || '.txt') AS path_key, lower('/depot/' || n_name) AS parent_key,
      'file_' || CAST(k AS STRING) || '.txt' AS name, '.txt' AS ext, s % 25 = 7 AS is_dir,
      CASE WHEN k % 3 = 0 THEN CAST(s AS BIGINT) ELSE CAST(k AS BIGINT) END AS size, TIMESTAMP '2001-01-01 00:00:00' AS created_at,
      TIMESTAMP '2001-01-01 00:00:00' AS modified_at, TIMESTAMP '2001-01-01 00:00:00' AS accessed_at, CAST(32 AS INT) AS attributes,
      CAST(NULL AS STRING) AS physical_id, CAST(2 AS INT) AS level,
      CASE WHEN k % 5 = 1 THEN NULL ELSE md5(CAST(k AS STRING)) END AS sha256
    FROM (SELECT n_name, s_suppkey % 20 AS k, MIN(s_suppkey) AS s FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
      GROUP BY n_name, s_suppkey % 20) g""",
    "depot_units": """
    SELECT 'merge' AS plan_id, CAST(1 AS INT) AS wave, lower('/depot/' || n_name) AS source_key, '/merged' AS destination_key,
      '/depot/' || n_name AS source, '/merged' AS destination FROM {nation}""",
    # --- texts, links -------------------------------------------------------
    "doc_pages": "SELECT 'conv_' || CAST(conv_id AS STRING) AS path, turn AS page_no, text FROM {conversations}",
    "keywords": "SELECT DISTINCT CAST(item_id AS INT) AS group_id, lower(split_part(text, ' ', 2)) AS keyword FROM {benchmark}",
    "page_files": "\nUNION ALL".join([
        _entry("/pages", "'/pages/' || pname", "'/pages'", "pname", "pext", "length(html)", "TIMESTAMP '2010-01-01 00:00:00'",
               "TIMESTAMP '2010-01-01 00:00:00'", "TIMESTAMP '2010-01-01 00:00:00'", 1)
        + " FROM (SELECT *, prefix || 'page_' || CAST(page_id AS STRING) || pext AS pname FROM (SELECT *, '' AS prefix, "
          "CASE page_id % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' WHEN 2 THEN '.xls' ELSE '.xlsm' END AS pext FROM {pages}) a) p",
        _entry("/pages", "'/pages/' || pname", "'/pages'", "pname", "pext", "length(html)", "TIMESTAMP '2010-01-01 00:00:00'",
               "TIMESTAMP '2010-01-01 00:00:00'", "TIMESTAMP '2010-01-01 00:00:00'", 1)
        + " FROM (SELECT *, '~$page_' || CAST(page_id AS STRING) || pext AS pname FROM (SELECT *, "
          "CASE page_id % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' WHEN 2 THEN '.xls' ELSE '.xlsm' END AS pext FROM {pages}) a "
          "WHERE length(html) % 6 = 0) p",
    ]),
    "links": """
    SELECT '/pages/page_' || CAST(page_id AS STRING) || CASE page_id % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' WHEN 2 THEN '.xls' ELSE '.xlsm' END AS file_path,
      CASE length(href) % 4 WHEN 0 THEN 'xl/externalLinks/_rels/x.rels' WHEN 1 THEN 'xl/worksheets/sheet1.xml'
        WHEN 2 THEN 'word/_rels/document.xml.rels' ELSE 'xl/vbaProject.bin' END AS part,
      CASE WHEN length(href) % 4 = 1 THEN 'formula' ELSE 'relationship' END AS kind,
      CASE WHEN length(href) % 4 = 1 THEN '''' || href || '''!A1' ELSE href END AS target
    FROM {full_hrefs}""",
    # Links of a page made absolute with its own host.
    "full_hrefs": """
    SELECT page_id, CASE WHEN raw LIKE '/%' THEN regexp_replace(url, '^(https?://[^/]+).*$', '{slot}') || raw ELSE raw END AS href FROM {hrefs}""",
    # Some hosts as a whole, and deeper prefixes that win over them.
    "link_map": """
    SELECT DISTINCT upper(regexp_replace(url, '^(https?://[^/]+).*$', '{slot}')) AS old_prefix,
      'https://new.example.org/' || md5(regexp_replace(url, '^(https?://[^/]+).*$', '{slot}')) AS new_prefix
    FROM {pages} WHERE url NOT LIKE '%a%.example%'
    UNION SELECT DISTINCT href, 'https://deep.example.org/' || md5(href) FROM {full_hrefs} WHERE href LIKE '%a%a%'""",
}

# The few tables the two dialects write differently.
SPARK: dict[str, str] = {
    "hrefs": "SELECT page_id, url, explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS raw FROM {pages}",
    "file_content": "SELECT path_key, encode(text, 'UTF-8') AS content FROM {file_text}",
}
DUCK: dict[str, str] = {
    "hrefs": "SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS raw FROM {pages}",
}
# Joined and grouped once; the estate alone names it twice, a query up to ten times.
WRITTEN = {"lines"}
SLOTS = {"spark": "$1", "duck": r"\1"}
_NAME = re.compile(r"\{([a-z][a-z_0-9]*)\}")


def _text(name: str, engine: str) -> str:
    own = SPARK if engine == "spark" else DUCK
    return (own.get(name) or SHARED[name]).replace("{slot}", SLOTS[engine])


def duck_sql(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` with every table it names, directly or not, as a common table expression."""
    extra = extra or {}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in GIVEN or name in ordered:
                continue
            visit(extra[name] if name in extra else _text(name, "duck"))
            if name not in ordered:
                ordered.append(name)

    visit(query)
    plain = lambda text: _NAME.sub(lambda m: m.group(1), text)
    parts = [f"{n} AS ({plain(extra[n] if n in extra else _text(n, 'duck'))})" for n in ordered]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + plain(query)


class Tables:
    """The same tables as DataFrames, built when first used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        made = self.__dict__["_made"]
        if name not in made:
            if name in GIVEN:
                made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = _text(name, "spark")
                parts = {n: getattr(self, n) for n in dict.fromkeys(_NAME.findall(text))}
                made[name] = self.spark.sql(text, **parts)
                if name in WRITTEN:
                    made[name] = cut_lineage(made[name], SCAN_BYTES // 4)
        return made[name]
