"""Storage report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import tree


def storage_report(entries: DataFrame, scan_errors: DataFrame, previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of the storage view from one roll-up."""
    rolled = tree.rollup(entries)
    nodes = tree.node_sizes(entries, rolled)
    report = {
        "coverage": tree.coverage(entries, scan_errors),
        "folders": tree.root_share(rolled),
        "extensions": tree.extension_totals(entries),
        "categories": tree.category_totals(entries),
        "largest_files": tree.largest_per_root(entries),
        "cleanup_hints": tree.cleanup_hints(entries),
    }
    if previous is not None:
        report["diff"] = tree.tree_diff(nodes, tree.node_sizes(previous))
    return report
