"""Inventory readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths as P
from ..session import cut_lineage


def entries_from_listing(listing: DataFrame, root: str, snapshot_id: str) -> DataFrame:
    """Derive every column of ``entries`` from the raw columns of a listing."""
    root_key = P.path_key(F.lit(root))
    keyed = listing.withColumn("root_key", root_key).withColumn("path_key", P.path_key("path"))
    name = F.element_at(F.split(P.canonical_path("path"), r"\\"), -1)
    derived = keyed.withColumn("name", name).withColumn("parent_key", P.parent_key("path_key"))
    return derived.select(
        "root_key", F.lit(snapshot_id).alias("snapshot_id"), "path", "path_key", "parent_key", "name",
        F.when(F.col("is_dir"), F.lit("")).otherwise(P.extension("name")).alias("ext"), "is_dir", "size", "created_at",
        "modified_at", "accessed_at", "attributes", "physical_id",
        P.level_below("path_key", "root_key").alias("level"), F.lit(None).cast("string").alias("sha256"),
    )


def read_listing(spark: SparkSession, paths: str | Sequence[str], root: str, snapshot_id: str, format: str = "parquet") -> DataFrame:
    """Entries from exported listings in Parquet, CSV (with header) or JSON lines."""
    reader = spark.read.schema(schemas.LISTING)
    if format == "csv":
        reader = reader.option("header", True)
    files = [paths] if isinstance(paths, str) else list(paths)
    return entries_from_listing(reader.format(format).load(files), root, snapshot_id)


def read_storage(spark: SparkSession, folder: str, snapshot_id: str, glob: str | None = None) -> DataFrame:
    """Entries of storage Spark can reach. Only listing is done: the content column is never selected.

    Spark's binary reader leaves out files of no bytes; where those count, take an
    exported listing (``read_listing``).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    plain = F.regexp_replace("path", "^file:/+", "/")
    none = lambda kind: F.lit(None).cast(kind)
    listing = reader.load(folder).select(
        plain.alias("path"), F.lit(False).alias("is_dir"), F.col("length").alias("size"), none("timestamp").alias("created_at"),
        F.col("modificationTime").alias("modified_at"), none("timestamp").alias("accessed_at"),
        none("int").alias("attributes"), none("string").alias("physical_id"),
    )
    return entries_from_listing(listing, folder, snapshot_id)


def read_content(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """``file_content`` of reachable storage; filters on the path are applied before the bytes are used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return reader.load(folder).select(P.path_key(plain).alias("path_key"), "content")


# --- design projects -------------------------------------------------------

DESIGN = "ProjectName STRING, RootFolders ARRAY<STRING>"
DESIGN_NODE = (
    "Name STRING, EstimatedSizeBytes BIGINT, EstimatedFileCount BIGINT, InheritAcl BOOLEAN, MappedSourcePaths ARRAY<STRING>, "
    "AclEntries ARRAY<STRUCT<AccountName: STRING, Rights: INT, AccessType: STRING>>, Children ARRAY<STRING>"
)


def load_design(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``plan_nodes``, ``plan_sources`` and ``plan_aces`` of nested design files, of any depth.

    A level keeps its children as JSON texts and the next one parses them, until
    none is left; each level is written to the shared folder. Node ids are
    positions (``0.1.3``), parents and levels follow from the nesting.
    """
    tops = spark.read.schema(DESIGN).option("multiLine", True).json(path)
    below = tops.select(F.col("ProjectName").alias("plan_id"), F.lit(None).cast("string").alias("parent_id"), F.posexplode("RootFolders").alias("ord", "json"))
    levels: list[DataFrame] = []
    while True:
        node = F.from_json("json", DESIGN_NODE)
        rows = below.withColumn("node_id", F.concat_ws(".", "parent_id", F.col("ord").cast("string"))).withColumn("node", node)
        level = cut_lineage(rows.select("plan_id", "node_id", "parent_id", "ord", F.lit(len(levels)).alias("level"), "node.*"))
        if levels and level.isEmpty():
            break
        levels.append(level)
        below = level.select("plan_id", F.col("node_id").alias("parent_id"), F.posexplode("Children").alias("ord", "json"))
    flat = reduce(DataFrame.unionByName, levels)
    nodes = flat.select(
        "plan_id", "node_id", "parent_id", "ord", F.col("Name").alias("name"), "level", F.col("EstimatedSizeBytes").alias("est_size"),
        F.col("EstimatedFileCount").alias("est_files"), F.coalesce("InheritAcl", F.lit(True)).alias("inherit_acl"),
    )
    return {
        "plan_nodes": nodes,
        "plan_sources": flat.select("plan_id", "node_id", F.explode("MappedSourcePaths").alias("source_path")),
        "plan_aces": flat.select("plan_id", "node_id", F.posexplode("AclEntries").alias("ace_order", "a")).select(
            "plan_id", "node_id", "ace_order", F.col("a.AccountName").alias("account"), F.col("a.Rights").alias("rights"),
            F.col("a.AccessType").alias("access_type"),
        ),
    }


def save_design(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def open_design(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    known = {"plan_nodes": schemas.PLAN_NODES, "plan_sources": schemas.PLAN_SOURCES, "plan_aces": schemas.PLAN_ACES}
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in known.items()}
