"""Effective access and access-list changes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import access, acl_diff
from ..session import cut_lineage


def effective_access(
    folders: DataFrame, aces: DataFrame, member_of: DataFrame, principals: DataFrame, accounts: DataFrame
) -> dict[str, DataFrame]:
    """What each of ``accounts(target, account, sid, root_key)`` can reach and where that changes."""
    closure = access.group_closure(member_of)
    known = access.tokens(accounts, closure, principals)
    # Change points read the rights four times: written once, they are worked out once.
    rights = cut_lineage(access.effective_rights(access.matched_aces(aces, known)))
    items = access.change_points(rights, folders, accounts)
    return {
        "memberships": access.memberships(accounts, closure, principals),
        "access": rights,
        "items": items,
        "counts": access.report_counts(items),
    }


def access_counts(
    folders: DataFrame, aces: DataFrame, member_of: DataFrame, principals: DataFrame, accounts: DataFrame
) -> DataFrame:
    """The ``counts`` of ``effective_access`` for any number of accounts, without its rows."""
    known = access.tokens(accounts, access.group_closure(member_of), principals)
    return access.counts_by_class(folders, aces, known, accounts)


def acl_change_plan(before: DataFrame, after: DataFrame, folders: DataFrame, principals: DataFrame) -> dict[str, DataFrame]:
    b = acl_diff.with_account_key(before, principals)
    a = acl_diff.with_account_key(after, principals)
    return {"changes": acl_diff.change_plan(b, a, folders), "promoted": acl_diff.promoted_counts(before, folders)}


def acl_verify(
    planned: DataFrame, actual: DataFrame, expected_folders: DataFrame, actual_folders: DataFrame, principals: DataFrame
) -> DataFrame:
    keyed = acl_diff.with_account_key(actual, principals)
    return acl_diff.verify(acl_diff.expected_after(planned), keyed, expected_folders, actual_folders)
