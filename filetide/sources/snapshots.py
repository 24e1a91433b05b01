"""Published snapshots: one Parquet partition per root and snapshot."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import tree
from ..operators.skew import measured_join
from ..session import cut_lineage

LAYOUT = ["root_part", "snapshot_id"]
JSON_ROWS = 1_000_000


def _with_part(entries: DataFrame) -> DataFrame:
    """Roots hold separators, so the partition name is a hash of the root key."""
    return entries.withColumn("root_part", F.sha2(F.lower("root_key"), 256).substr(1, 16))


def publish(entries: DataFrame, folder: str) -> None:
    """Replace the partitions present in ``entries``; others stay.

    The replacement is not atomic for a reader that lists the folder meanwhile.
    Rows are ranged by key and sorted, so a subtree is a narrow key range in the
    Parquet statistics and one big root is still written by many tasks.
    """
    (
        _with_part(entries).repartitionByRange(*LAYOUT, "path_key").sortWithinPartitions(*LAYOUT, "path_key")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(folder)
    )


def split_by_coverage(entries: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of complete scans, and those of scans that must not replace a good snapshot."""
    complete = cut_lineage(coverage.where("is_complete").select(*tree.TREE))
    counts = cut_lineage(entries.groupBy(*tree.TREE).agg(F.count("*").alias("_rows")))
    return measured_join(entries, complete, tree.TREE, "left_semi", counts=counts), measured_join(entries, complete, tree.TREE, "left_anti", counts=counts)


def publish_if_complete(entries: DataFrame, coverage: DataFrame, folder: str, partial_folder: str) -> None:
    """Complete scans are published; incomplete ones are kept apart.

    Counting, ranging and writing read ``entries`` five times: pass a written table.
    """
    whole, partial = split_by_coverage(entries, coverage)
    publish(whole, folder)
    publish(partial, partial_folder)


def read(spark: SparkSession, folder: str, root_key: str | None = None, snapshot_id: str | None = None) -> DataFrame:
    """Published entries; root and snapshot prune partitions."""
    schema = T.StructType(schemas.ENTRIES.fields + [T.StructField("root_part", T.StringType())])
    entries = spark.read.schema(schema).parquet(folder)
    if root_key is not None:
        part = F.sha2(F.lower(F.lit(root_key)), 256).substr(1, 16)
        entries = entries.where((F.col("root_part") == part) & (F.col("root_key") == root_key))
    if snapshot_id is not None:
        entries = entries.where(F.col("snapshot_id") == snapshot_id)
    return entries.select(*schemas.ENTRIES.names)


def delete_root(spark: SparkSession, folder: str, root_key: str) -> None:
    """Remove the partition folder of one root; nothing else is read or written."""
    part = hashlib.sha256(root_key.lower().encode()).hexdigest()[:16]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/root_part={part}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- portable tree ---------------------------------------------------------

def export_tree_json(entries: DataFrame, folder: str) -> None:
    """One JSON line per node in preorder, packed; the path carries the nesting.

    Names repeat along a branch, so packing leaves about a tenth. A packed file cannot be
    split for reading, which is why one holds at most ``JSON_ROWS`` nodes.
    """
    out = tree.preorder(entries).write.mode("overwrite").option("ignoreNullFields", False)
    out.option("compression", "gzip").option("maxRecordsPerFile", JSON_ROWS).json(folder)


def import_tree_json(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.ENTRIES).json(folder)
