"""Session settings and the two cluster-wide helpers every module shares."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
SCAN_BYTES = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "filetide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. A local master, where one
    machine is the whole cluster, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="filetide-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for tables written between jobs."""
    import uuid

    return os.path.join(shared_folder(spark), "filetide", f"{name}-{uuid.uuid4().hex}")


def small_scans(spark: SparkSession, most: int = SCAN_BYTES) -> None:
    """Let no task scan more than ``most`` stored bytes; a smaller setting stays.

    By default a task's share of the files grows with the table up to 128 MiB. Rows
    of numbers whose paths are spelled out by the reader grow thirtyfold and more
    in the sorts and counts of that task.
    """
    key = "spark.sql.files.maxPartitionBytes"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > most:
        spark.conf.set(key, str(most))


def write_scratch(df: DataFrame, name: str, row_group: int | None = None) -> str:
    """Folder below the shared one that ``df`` was written to.

    The shuffle files of the write go with its end, so steps that follow each other
    do not add up on the disks. ``row_group`` bounds the bytes of a row group, the
    least a task can read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return path


def cut_lineage(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder so that a lost executor costs a re-read.

    A written table (not an executor-local checkpoint) survives executor loss
    and gives the next plan exact file statistics.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, "cut", row_group))
