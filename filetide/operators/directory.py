"""Principals and organisational units as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_principals(principals: DataFrame, keyword: str = "", *, users: bool = True, groups: bool = True) -> DataFrame:
    """Accounts whose account or display name contains a keyword; groups first, then by name."""
    kinds = [k for k, wanted in (("user", users), ("group", groups)) if wanted]
    found = principals.where(F.lower("kind").isin(kinds))
    if keyword.strip():
        needle = F.lit(keyword.strip().lower())
        found = found.where(F.contains(F.lower("account"), needle) | F.contains(F.lower(F.coalesce("display", F.lit(""))), needle))
    return found.orderBy(F.when(F.lower("kind") == "group", 0).otherwise(1), F.lower("display"), "sid")


def dn_parent(dn: Column | str) -> Column:
    """Distinguished name of the parent, respecting escaped commas."""
    name = F.col(dn) if isinstance(dn, str) else dn
    return F.regexp_replace(name, r"^(?:\\.|[^,\\])*,?\s*", "")


def dn_depth(dn: Column | str) -> Column:
    """Number of components of a distinguished name."""
    return F.size(F.split(F.regexp_replace(dn, r"\\.", "x"), ","))


def principals_in_ou(principals: DataFrame, ou: str, *, subtree: bool = False) -> DataFrame:
    """Principals directly in a unit, or anywhere below it. ``principals`` needs ``dn``."""
    parent = F.lower(dn_parent("dn"))
    inside = parent == ou.lower()
    if subtree:
        inside = inside | F.endswith(parent, F.lit("," + ou.lower()))
    return search_principals(principals.where(inside))


def ou_tree(ous: DataFrame) -> DataFrame:
    """Units with parent and depth, parents before children."""
    keyed = ous.select("dn", "name", dn_parent("dn").alias("parent_dn"), dn_depth("dn").alias("depth"))
    return keyed.orderBy("depth", F.lower("dn"))
