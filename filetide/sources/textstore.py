"""Texts laid out so that a search reads only the files of its candidates.

Every key belongs to a bucket by its hash; a bucket is a partition folder, and
rows in it are sorted by key. Whoever knows which keys matter knows which
folders to read before any text is touched. Hashing the key, not the folder,
keeps buckets even however large one folder is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

MAX_BUCKETS = 1 << 16  # bound on the list of buckets a search names


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class TextStore:
    """``(path_key, text)`` below ``folder`` in ``buckets`` partitions."""

    spark: SparkSession
    folder: str
    buckets: int

    def __post_init__(self) -> None:
        if not 1 <= self.buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets must lie between 1 and {MAX_BUCKETS}")

    def write(self, texts: DataFrame) -> TextStore:
        """Replace the store by ``texts``; a bucket is written by one task, so choose ``buckets`` for the size wanted."""
        placed = texts.select("path_key", "text", bucket_of("path_key", self.buckets).alias("bucket"))
        (
            placed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "path_key")
            .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.folder)
        )
        return self

    def all(self) -> DataFrame:
        return self._read().select("path_key", "text")

    def of(self, candidates: DataFrame) -> DataFrame:
        """Texts of the buckets that hold a ``path_key`` of ``candidates``; other rows of those buckets come along.

        The buckets, at most ``MAX_BUCKETS`` numbers, are read first; they select
        partition folders, so the scan lists and opens no other file.
        """
        chosen = candidates.select(bucket_of("path_key", self.buckets).alias("b")).distinct().collect()
        return self._read().where(F.col("bucket").isin(sorted(r["b"] for r in chosen))).select("path_key", "text")

    def _read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schemas.FILE_TEXT.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.folder)
