"""Snapshots arriving as files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .. import schemas


def read_snapshots(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.SNAPSHOTS)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


SPAN_SECONDS, PARTS = 86_400, 128
KEPT = "rows array<struct<target_key: string, us: bigint, snapshot_id: string, total_bytes: bigint, total_files: bigint>>"
COLUMNS = ["target_key", "us", "snapshot_id", "total_bytes", "total_files"]


def _first(row: tuple) -> tuple:
    """Orders the snapshots of one target and second: earliest first, then by id, null before all."""
    return (row[1], row[2] is not None, row[2] or "")


class EarliestOfSecond(StatefulProcessor):
    """State of one part of a day: the earliest snapshot so far of every target and second in it that is still open.

    Every state call goes to the state server and back, so a key holds many
    seconds; a day's seconds are dealt by hash over ``PARTS`` keys.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    @staticmethod
    def _closes(us: int) -> int:
        return (us // 1_000_000 + 1) * 1000

    @staticmethod
    def _frame(rows: list[tuple], late: bool) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS)
        whole = out.astype({"total_bytes": "Int64", "total_files": "Int64"})
        return whole.assign(ts=pd.to_datetime(whole["us"], unit="us"), late=late)[["target_key", "snapshot_id", "ts", "total_bytes", "total_files", "late"]]

    def _load(self) -> dict[tuple, tuple]:
        held = self.kept.get()[0] if self.kept.exists() else []
        return {(r[0], r[1] // 1_000_000): tuple(r) for r in held}

    def _keep(self, best: dict[tuple, tuple]) -> None:
        """Hold the open rows and wake when the first of them closes."""
        if best:
            self.kept.update((list(best.values()),))
            self.handle.registerTimer(min(self._closes(r[1]) for r in best.values()))
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        best, changed = None, False
        whole = lambda x: None if pd.isna(x) else int(x)
        text = lambda x: None if pd.isna(x) else x
        for frame in rows:
            late = []
            for t, u, s, b, f in zip(*[frame[c] for c in COLUMNS]):
                row = (text(t), int(u), text(s), whole(b), whole(f))
                if self._closes(row[1]) <= watermark:
                    late.append(row)
                    continue
                best = self._load() if best is None else best
                at = (row[0], row[1] // 1_000_000)
                if at not in best or _first(row) < _first(best[at]):
                    best[at], changed = row, True
            if late:
                yield self._frame(late, True)
        if changed:
            self._keep(best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        best = self._load()
        done = [r for r in best.values() if self._closes(r[1]) <= watermark]
        if done:
            self._keep({at: r for at, r in best.items() if self._closes(r[1]) > watermark})
            yield self._frame(done, False)

    def close(self) -> None:
        pass


def stream_history(snapshots: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per target and second, the earliest by ``(ts, snapshot_id)`` of those that came in time.

    A second closes when the watermark, ``delay`` behind the newest snapshot,
    passes its end; its row then leaves with ``late`` false, as the batch form keeps
    it, whatever the order of arrival. A snapshot of a second that has closed leaves
    at once with ``late`` true, so that none is lost uncounted (``late_counts``).
    Needs the RocksDB state store.
    """
    marked = snapshots.withWatermark("ts", delay)
    # The copy of the time carries no watermark: late rows reach the processor instead of being dropped before it.
    us = F.unix_micros("ts")
    second = F.floor(us / 1_000_000)
    rows = marked.select(
        F.floor(second / SPAN_SECONDS).alias("span"), F.pmod(F.xxhash64("target_key", second), F.lit(PARTS)).alias("part"),
        "target_key", us.alias("us"), "snapshot_id", "total_bytes", "total_files",
    )
    schema = StructType([*[snapshots.schema[c] for c in ("target_key", "snapshot_id", "ts", "total_bytes", "total_files")]]).add("late", "boolean")
    return rows.groupBy("span", "part").transformWithStateInPandas(
        statefulProcessor=EarliestOfSecond(), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


def late_counts(written: DataFrame) -> DataFrame:
    """Late snapshots of every target in the written output of ``stream_history``."""
    return written.groupBy("target_key").agg(F.sum(F.col("late").cast("long")).alias("late"))
