"""A saved search over newly arrived inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import search


def stream_hits(entries: DataFrame, spec: search.SearchSpec, folder: str) -> DataStreamWriter:
    """Append hits below ``folder/hits`` and exact totals of each batch below ``folder/totals``.

    A batch overwrites its own partition, so a repeated batch after a failure
    counts once. ``running_totals`` adds the batches up. A batch is read once for its
    hits and once, without their columns, for the totals, and is kept nowhere: its source
    must give the same rows again, as files and logs do.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = search.name_hits(batch, spec)
        found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("compression", "zstd").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/hits")
        search.totals(found).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/totals")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")


def running_totals(spark, folder: str) -> DataFrame:
    totals = spark.read.schema("hits bigint, bytes bigint, batch_id bigint").parquet(f"{folder}/totals")
    return totals.agg(F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"))
