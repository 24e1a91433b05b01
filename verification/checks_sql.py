"""The SQL functions, called from SQL text: one query for each family."""

from filetide.functions import sql

from . import checks_access, checks_audit, checks_other, checks_tree  # noqa: F401  (their queries are looked up below)
from .registry import CHECKS as _known
from .registry import add


def run(t, query, **tables):
    sql.register(t.spark, "ft_")
    return t.spark.sql(query, **tables)


def same_as(name: str) -> str:
    """The SQL of the query that calls the same expressions from Python."""
    return _known[name].query


add("s11_paths", lambda t: run(t,
    r"SELECT raw, ft_canonical_path(raw) AS canonical, ft_path_key(raw) AS path_key FROM (SELECT '//?/UNC/Server/Share/' || translate(c_name, '#', '/') || '/' AS raw FROM {customer})",
    customer=t.customer), same_as("f1_canonical_path"))
add("s11_tree_paths", lambda t: run(t,
    """SELECT path_key, ft_parent_key(path_key) AS parent, ft_path_leaf(path_key) AS leaf, ft_path_components(path_key) AS parts, ft_is_below(path_key, '/estate') AS below
       FROM {entries} WHERE parent_key IS NOT NULL""", entries=t.entries),
    """SELECT path_key, parent_key AS parent, string_split(path_key, '/')[-1] AS leaf, len(string_split(path_key, '/')) AS parts, starts_with(path_key, '/estate/') AS below
       FROM {entries} WHERE parent_key IS NOT NULL""")
add("s11_names", lambda t: run(t, "SELECT path_key, ft_has_copy_word(name) AS is_copy FROM {files}", files=t.docs.unionByName(t.parts)), same_as("f10_copy_words"))
add("s11_formats", lambda t: run(t,
    "SELECT path_key, ft_format_bytes(size * 1000) AS size_text, ft_format_duration(size) AS duration, ft_format_count(CASE WHEN ext <> '.tmp' THEN size END) AS count_text FROM {entries} WHERE NOT is_dir",
    entries=t.entries),
    r"""SELECT path_key, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN regexp_replace(printf('%.1f', round_even(b / 1024.0, 1)), '\.0$', '') || ' KB'
           WHEN b < 1073741824 THEN regexp_replace(printf('%.1f', round_even(b / 1048576.0, 1)), '\.0$', '') || ' MB'
           ELSE regexp_replace(printf('%.1f', round_even(b / 1073741824.0, 1)), '\.0$', '') || ' GB' END AS size_text,
         CASE WHEN size >= 86400 THEN (size // 86400) || 'd ' || (size // 3600 % 24) || 'h ' || (size // 60 % 60) || 'm'
           WHEN size >= 3600 THEN (size // 3600) || 'h ' || (size // 60 % 60) || 'm' WHEN size >= 60 THEN (size // 60) || 'm ' || (size % 60) || 's'
           ELSE GREATEST(size, 1) || 's' END AS duration,
         CASE WHEN ext = '.tmp' THEN 'Unmeasured (-)' ELSE format('{:,}', size) || ' files' END AS count_text
       FROM (SELECT *, size * 1000 AS b FROM {entries} WHERE NOT is_dir)""")
add("s11_rights", lambda t: run(t, "SELECT path_key, ace_order, ft_rights_level(rights) AS level FROM {aces}", aces=t.aces), same_as("f16_rights_level"))
add("s11_scopes", lambda t: run(t, "SELECT prop_flags, ft_rights_applies_to(inherit_flags, prop_flags) AS scope, COUNT(*) AS n FROM {aces} GROUP BY ALL", aces=t.aces),
    "SELECT prop_flags, CASE prop_flags WHEN 0 THEN 'This folder, subfolders and files' ELSE 'Subfolders and files only' END AS scope, COUNT(*) AS n FROM {aces} GROUP BY ALL")
add("s11_links", lambda t: run(t, "SELECT kind, COUNT(*) AS n FROM {links} WHERE ft_is_external_link(kind, target) GROUP BY ALL", links=t.links), same_as("f36_external_links"))
