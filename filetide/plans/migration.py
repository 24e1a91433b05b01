"""Waves and the transfer check."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import migrate


def plan_waves(
    nodes: DataFrame, sources: DataFrame, target_root: str, policy: str = migrate.TOP_LEVEL,
    budget: int = 500 * 1024 * migrate.MIB, rate_mbps: float = 50.0, delta_percent: float = 5.0,
) -> dict[str, DataFrame]:
    paths = migrate.with_paths(nodes)
    pieces = migrate.assign_waves(migrate.units(nodes, migrate.recursive_totals(nodes), sources, policy), policy, budget)
    waved = migrate.node_waves(paths, pieces)
    copy = migrate.copy_units(waved, sources, target_root)
    return {
        "units": pieces,
        "waves": migrate.wave_totals(pieces, waved, sources, rate_mbps=rate_mbps, delta_percent=delta_percent),
        "copy_units": copy,
        "exclusions": migrate.exclusions(copy),
        "overlaps": migrate.overlaps(copy),
        "bad_names": migrate.bad_folder_names(nodes),
        "planned_directories": migrate.planned_directories(paths, target_root),
    }


def transfer_check(
    entries: DataFrame, copy: DataFrame, actual: DataFrame, sources_now: DataFrame | None = None, wave: int | None = None
) -> dict[str, DataFrame]:
    """Expected union, collisions, planned removals and verification of every file."""
    items = migrate.expected_items(entries, copy)
    once = migrate.expected_once(items)
    return {
        "expected": once,
        "collisions": migrate.collisions(items),
        "removals": migrate.removals(actual, once, copy, wave),
        "verify": migrate.verify(once, actual, entries if sources_now is None else sources_now, wave),
    }
