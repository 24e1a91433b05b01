"""Small corpora with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, n int, at int, c long, shard int, ids string"
EMPTY = [(None, None), (7001, None), (7002, ""), (7003, " \n\t "), (7004, "word"), (7005, "two words"), (7006, "▁ literal  blanks  and \U0001f600 signs\r\n")]


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    draw = random.Random(seed)
    out = [f"{draw.choice('bcdfglmnprst')}{draw.choice('aeiou')}{'klmnrstv'[x % 8]}{x // 8 % 500}".translate(str.maketrans("0123456789", "abcdefghij")) for x in (draw.randrange(vocabulary) for _ in range(words))]
    return "".join(w + ("\n" if draw.random() < 0.05 else " ") for w in out).strip()


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """``documents`` with extra columns whose names operators use themselves."""
    full = [(i, t, "en", "s", len(t) if t is not None else None, "x", 1, 2, 3, 4, "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def folder(spark: SparkSession, path, rows, labels=(), benchmark=(), vectors=()) -> str:
    out = str(path)
    frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return out


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def edited(text: str, seed: int, edits: int) -> str:
    draw, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"edit{draw.randrange(10**6)}"
    return " ".join(w)


def crc(key) -> int:
    return zlib.crc32(str(key).encode() if key is not None else b"")
