"""Register a query over the given tables together with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filetide.session import cut_lineage

from .tables import Tables, duck_sql


@dataclass(frozen=True)
class Check:
    run: Callable[[Tables], DataFrame]
    query: str | None

    @property
    def sql(self) -> str | None:
        return None if self.query is None else duck_sql(self.query, ORACLE)


CHECKS: dict[str, Check] = {}
# Common table expressions only the oracle side uses.
ORACLE: dict[str, str] = {}


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in CHECKS:
        raise ValueError(f"{name} is registered twice")
    CHECKS[name] = Check(run, sql)


def positioned(ordered: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of a sorted frame with the place of each row, from 1.

    Rows are numbered within the sorted partitions; the sizes of the partitions
    before, one number each, shift them.
    """
    rows = cut_lineage(ordered.select(*columns, F.monotonically_increasing_id().alias("_at")))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.col("_at") - F.shiftleft("_part", 33) + F.col("_shift") + 1
    return rows.join(F.broadcast(shift), "_part").select(*columns, place.alias("position"))


def once(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Write a table several queries start from once per session and folder."""
    made: dict[tuple[str, str], DataFrame] = {}

    def get(t: Tables) -> DataFrame:
        key = (t.spark.sparkContext.applicationId, t.folder)
        if key not in made:
            made[key] = cut_lineage(build(t))
        return made[key]

    return get


def up(table: str) -> str:
    """Every row of ``table`` once per strict ancestor of its key, as ``anc``."""
    parts = "string_split(path_key, '/')"
    return (
        f"SELECT e.*, unnest(list_transform(range(2, len({parts})), lambda i: array_to_string({parts}[1:i], '/'))) AS anc "
        f"FROM {{{table}}} e"
    )


def rolled(table: str) -> str:
    """Bytes, files and folders below every folder: summed per parent first, so that only parents are repeated for their ancestors."""
    return f"""
    SELECT d.root_key, d.snapshot_id, d.path_key AS folder_key, CAST(COALESCE(a.bytes, 0) AS BIGINT) AS bytes,
      CAST(COALESCE(a.files, 0) AS BIGINT) AS files, CAST(COALESCE(a.folders, 0) AS BIGINT) AS folders
    FROM (SELECT * FROM {{{table}}} WHERE is_dir) d LEFT JOIN (
      SELECT anc, SUM(bytes) AS bytes, SUM(files) AS files, SUM(folders) AS folders FROM (
        SELECT *, unnest(list_transform(range(2, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS anc FROM (
          SELECT string_split(parent_key, '/') AS parts, SUM(CASE WHEN is_dir THEN 0 ELSE size END) AS bytes, COUNT(*) FILTER (WHERE NOT is_dir) AS files,
            COUNT(*) FILTER (WHERE is_dir) AS folders FROM {{{table}}} WHERE parent_key IS NOT NULL GROUP BY parent_key)) GROUP BY anc) a ON a.anc = d.path_key"""


ORACLE["up"] = up("entries")
ORACLE["rolled"] = rolled("entries")
ORACLE["up_previous"] = up("previous")
ORACLE["rolled_previous"] = rolled("previous")
ORACLE["up_estate"] = up("estate")
ORACLE["nodes"] = """
    SELECT root_key, path_key, TRUE AS is_dir, bytes AS size FROM (SELECT folder_key AS path_key, * FROM {rolled})
    UNION ALL SELECT root_key, path_key, FALSE, size FROM {entries} WHERE NOT is_dir"""
ORACLE["nodes_previous"] = """
    SELECT root_key, path_key, TRUE AS is_dir, bytes AS size FROM (SELECT folder_key AS path_key, * FROM {rolled_previous})
    UNION ALL SELECT root_key, path_key, FALSE, size FROM {previous} WHERE NOT is_dir"""
