"""Headline queries, timed. Prints one JSON line.

One scan warms the session up and the tables a query starts from are written;
then each query runs once into the ``noop`` sink, so that every row is produced
and none is collected. ``BENCH_RUNS`` asks for more
runs, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from filetide.operators import dedupe, history, migrate, search, text, tree
from filetide.plans.access import effective_access
from filetide.plans.forecast import forecast
from filetide.session import DEFAULTS, cut_lineage
from verification import checks_audit, checks_other
from verification.tables import Tables

class Written:
    """The canonical tables, each written once when first asked for, so that no query rebuilds them."""

    def __init__(self, tables: Tables) -> None:
        self._tables, self._made = tables, {}
        self.spark, self.folder = tables.spark, tables.folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = cut_lineage(getattr(self._tables, name))
        return self._made[name]


HEADLINES = {
    "folder_rollup": lambda t: tree.rollup(t.entries),
    "tree_diff": lambda t: tree.tree_diff(tree.node_sizes(t.entries), tree.node_sizes(t.previous)),
    "largest_per_folder": lambda t: tree.largest_per_folder(t.entries, 10),
    "search_names": lambda t: search.totals(search.name_hits(t.estate, search.SearchSpec(
        keyword_groups=[["line_3", "line_5"]], excluded=["europe/"], min_size=10_000))),
    "search_content": lambda t: search.content_hits(t.docs, t.file_text, search.SearchSpec(
        keyword_groups=[["que", "der"], ["the", "pour"]], content_mode=True)),
    "duplicates": lambda t: dedupe.confirmed(dedupe.size_groups(t.docs, 1), t.file_content, sample_from=512),
    "hygiene_audit": lambda t: checks_audit.audit.combine(checks_audit.collect_reasons(
        t.docs.unionByName(t.parts), t.file_content, checks_audit._no_ignores(t), checks_audit.DOCS_AS_OF, checks_audit.OPTIONS)),
    "forecast_trend": lambda t: forecast(t.snapshots, t.subfolders)["trend"],
    "anomalies": lambda t: history.anomalies(t.snapshots),
    "effective_access": lambda t: effective_access(t.folder_acl, t.aces, t.member_of, t.principals, t.group_accounts)["counts"],
    "expected_union": lambda t: migrate.expected_items(t.estate, checks_other.copy(t)),
    "trigram_index": lambda t: text.trigram_index(t.file_text),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("filetide-bench")
    for key, value in {
        **DEFAULTS, "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    t = Written(Tables(spark, folder))
    times: dict[str, float] = {}
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    t.lineitem.groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    for name, build in HEADLINES.items():
        if wanted and name not in wanted:
            continue
        build(t)  # writes the tables it reads; not timed
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            build(t).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
