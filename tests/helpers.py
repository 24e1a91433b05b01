"""Small literal inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from filetide import schemas
from filetide.sources.inventory import entries_from_listing

NOW = datetime(2024, 6, 1)
GB = 1024**3


def listing(spark: SparkSession, rows: list[tuple], root: str = "C:\\Data") -> DataFrame:
    """``(path, size, modified, accessed[, is_dir])`` rows as entries."""
    full = []
    for path, size, modified, accessed, *rest in rows:
        is_dir = bool(rest and rest[0])
        full.append((path, is_dir, size, modified, modified, accessed, 16 if is_dir else 32, None))
    return entries_from_listing(spark.createDataFrame(full, schemas.LISTING), root, "s1")


def ago(days: float) -> datetime:
    return NOW - timedelta(days=days)


def history(spark: SparkSession, totals: list[tuple[float, int]], target: str = "t") -> DataFrame:
    start = datetime(2024, 1, 1)
    rows = [(target, f"s{i:03d}", start + timedelta(days=day), size, i) for i, (day, size) in enumerate(totals)]
    return spark.createDataFrame(rows, schemas.SNAPSHOTS)
