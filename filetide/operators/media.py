"""Pictures, videos and protected masters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleanup import within_stamp
from .tree import TREE

# Fixed values.
IMAGES = [".jpg", ".jpeg", ".png"]
VIDEOS = [".mp4", ".mov", ".avi", ".mkv", ".wmv", ".m4v"]
MASTERS = [".psd", ".ai", ".raw", ".cr2", ".arw", ".nef", ".dng", ".tiff", ".tif"]
PROTECTED_WORDS = ["_master", "_original", "_raw", "マスター", "印刷用", "原稿", "元データ", "広報用"]
MIN_IMAGE_BYTES = 2 * 1024 * 1024


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def classify(
    entries: DataFrame, *, protected_words: Sequence[str] = PROTECTED_WORDS, protected_paths: Sequence[str] = (),
    min_image_bytes: int = MIN_IMAGE_BYTES,
) -> DataFrame:
    """Media files with class and protection; small pictures drop out unless protected."""
    ext = F.lower("ext")
    master = ext.isin(MASTERS)
    word = _any([F.contains("path_key", F.lit(w.lower())) for w in protected_words])
    path = _any([F.startswith("path_key", F.lit(p.lower().replace("\\", "/"))) for p in protected_paths])
    reason = F.when(master, "Master extension").when(word, "Protected folder name").when(path, "Protected path")
    kind = F.when(master, "Master").when(ext.isin(IMAGES), "Image").when(ext.isin(VIDEOS), "Video")
    media = entries.where(~F.col("is_dir")).withColumn("media_class", kind).where(F.col("media_class").isNotNull())
    media = media.withColumn("protection", reason).withColumn("is_protected", F.col("protection").isNotNull())
    small = (F.col("media_class") == "Image") & ~F.col("is_protected") & (F.col("size") < min_image_bytes)
    status = F.when(F.col("is_protected"), F.concat(F.lit("Protected ("), "protection", F.lit(")"))).when(
        F.col("media_class") == "Video", "Large video").otherwise("To optimise")
    return media.where(~small).withColumn("status", status)


def videos(media: DataFrame) -> DataFrame:
    return media.where(F.col("media_class") == "Video").orderBy(F.desc("size"), "path_key")


def stamp_check(media: DataFrame, now: DataFrame) -> DataFrame:
    """Whether each file still has the length and time it was listed with (two seconds tolerated)."""
    present = now.select("path_key", F.col("size").alias("_size"), F.col("modified_at").alias("_modified"))
    joined = media.join(present, "path_key", "left")
    unchanged = within_stamp(F.col("_size"), F.col("_modified"), F.col("size"), F.col("modified_at"))
    return joined.withColumn("unchanged", F.coalesce(F.col("_size").isNotNull() & unchanged, F.lit(False))).drop("_size", "_modified")


def with_savings(media: DataFrame) -> DataFrame:
    """Saved bytes and percent of files that have an ``optimised_size``."""
    saved = F.greatest(F.col("size") - F.col("optimised_size"), F.lit(0))
    return media.withColumn("saved_bytes", F.coalesce(saved, F.lit(0))).withColumn(
        "reduction_percent", F.when(F.col("size") > 0, F.col("saved_bytes") / F.col("size") * 100.0).otherwise(F.lit(0.0))
    )


def totals(media: DataFrame) -> DataFrame:
    """Pictures, videos, bytes before and after, saved bytes; needs ``optimised_size`` (null when not processed)."""
    done = F.col("optimised_size").isNotNull()
    before = F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0))
    after = F.coalesce(F.sum("optimised_size"), F.lit(0))
    video = F.col("media_class") == "Video"
    sums = media.groupBy(*TREE).agg(
        F.count_if(~video).alias("images"), F.count_if(video).alias("videos"), F.count_if(done).alias("optimised_images"),
        before.alias("original_bytes"), after.alias("optimised_bytes"),
    )
    saved = F.greatest(F.col("original_bytes") - F.col("optimised_bytes"), F.lit(0))
    return sums.withColumn("saved_bytes", saved).withColumn(
        "reduction_percent",
        F.when(F.col("original_bytes") > 0, F.col("saved_bytes") / F.col("original_bytes") * 100.0).otherwise(F.lit(0.0)),
    )
