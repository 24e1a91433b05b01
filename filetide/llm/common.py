"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filetide.session import scratch_path

WORDS = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    A lost executor then costs a re-read of files, and the next plan starts
    from exact sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(prefix: str) -> str:
    """A column name no input has."""
    return f"_{prefix}_{uuid.uuid4().hex[:12]}"


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo ``modulus``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Lower-case words between ASCII white space; empty for null or blank text."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often and however deep ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


# Multiplier of the word hash and its inverse modulo 2^64 (any odd number has one).
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 texts laid end to end, and the text of each.

    ``data`` holds the bytes and ``offsets`` the ``n + 1`` borders. The hash of a
    word is a polynomial of its bytes, read off one running sum, then mixed.
    """
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets <= len(data)]] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(len(data) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    words = (running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mixed(words), np.searchsorted(offsets, starts, "right") - 1 if n else starts


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text (sorted within a text), and the borders per text.

    A text with fewer words than ``width`` has its whole sequence as its one
    shingle; a text without words has none.
    """
    words, owner = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    text_of = np.repeat(np.arange(n), made)
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(len(text_of)) - begin[text_of] + first[text_of]
    length = np.minimum(counts, width)[text_of]
    h = length.astype(np.uint64)
    for k in range(width):
        there = k < length
        step = np.zeros(len(at), np.uint64)
        step[there] = words[at[there] + k]
        h = mixed(h * np.uint64(_BASE) + step)
    order = np.lexsort((h, text_of))
    h, text_of = h[order], text_of[order]
    fresh_one = np.ones(len(h), bool)
    fresh_one[1:] = (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])
    h, text_of = h[fresh_one], text_of[fresh_one]
    return h, np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=n))]).astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    borders = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[borders[0] : borders[-1]]
    return data, borders - borders[0]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of the measured column."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += int(size)
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
