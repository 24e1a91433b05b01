"""Growth alerts with state: the causal surge test, one snapshot at a time."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import history as H

OUTPUT = (
    "target_key string, snapshot_id string, ts timestamp, delta_bytes bigint, rate double, baseline_count int, "
    "z_score double, is_anomaly boolean, late_dropped bigint"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 1_024  # rates in a block of state; one of twice as many is halved


class Baseline:
    """All rates of a target as sorted blocks, of which only those an answer needs are loaded.

    ``index`` lists the blocks in order of size: their numbers, counts and least
    rates. ``changed`` names the blocks to be written back.
    """

    def __init__(self, ids: list[int], counts: list[int], lows: list[float], load: Callable[[int], list[float]], block: int = BLOCK):
        self.ids, self.counts, self.lows = ids, counts, lows
        self.block, self.changed, self._load, self._held = block, set(), load, {}
        self._ends = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        return int(self._ends[-1]) if len(self._ends) else 0

    def rates(self, block_id: int) -> list[float]:
        if block_id not in self._held:
            self._held[block_id] = self._load(block_id)
        return self._held[block_id]

    def loaded(self) -> int:
        return len(self._held)

    def add(self, rate: float) -> None:
        if not self.ids:
            self.ids, self.counts, self.lows, self._held[0] = [0], [0], [rate], []
        at = max(0, bisect_right(self.lows, rate) - 1)
        number = self.ids[at]
        held = self.rates(number)
        insort(held, rate)
        self.changed.add(number)
        self.counts[at], self.lows[at] = len(held), held[0]
        if len(held) >= 2 * self.block:
            new, half = max(self.ids) + 1, len(held) // 2
            self._held[number], self._held[new] = held[:half], held[half:]
            self.counts[at : at + 1], self.lows[at : at + 1], self.ids[at : at + 1] = [half, len(held) - half], [held[0], held[half]], [number, new]
            self.changed.add(new)
        self._ends = np.cumsum(self.counts, dtype=np.int64)

    def at(self, k: int) -> float:
        block = int(np.searchsorted(self._ends, k, "right"))
        return self.rates(self.ids[block])[k - (int(self._ends[block - 1]) if block else 0)]

    def _middle(self, kth: Callable[[int], float]) -> float:
        n = len(self)
        return kth(n // 2) if n % 2 else (kth(n // 2 - 1) + kth(n // 2)) / 2.0

    def median(self) -> float:
        return self._middle(self.at)

    def mad(self, median: float) -> float:
        return self._middle(lambda k: self._distance(median, k))

    def _distance(self, centre: float, k: int) -> float:
        """The ``k``-th smallest distance to ``centre``: of all ``k + 1`` neighbours those that reach least far."""
        low, high = 0, len(self) - 1 - k
        while low < high:
            middle = (low + high) // 2
            if self.at(middle + k) - centre >= centre - self.at(middle):
                high = middle
            else:
                low = middle + 1
        return min(max(centre - self.at(a), self.at(a + k) - centre) for a in {low, max(low - 1, 0)})


def verdict(base: Baseline, delta: int, rate: float) -> tuple[float | None, bool]:
    """Z-score and verdict of a change against strictly earlier rates."""
    if len(base) < H.MIN_DELTAS:
        return None, False
    median = base.median()
    z = H.Z_SCALE * abs(rate - median) / max(base.mad(median), H.MAD_FLOOR)
    return z, bool(delta >= H.MIN_ANOMALY_BYTES and rate > median and z > H.Z_LIMIT)


class SurgeDetector(StatefulProcessor):
    """Per target: the last snapshot, its rates in sorted blocks with an index, and a count of late rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint, total bigint")
        self.index = handle.getValueState("index", "ids binary, counts binary, lows binary")
        self.blocks = handle.getMapState("blocks", "id bigint", "rates binary")
        self.late = handle.getValueState("late", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["us"] = pd.to_datetime(batch["ts"]).astype("datetime64[us]").astype("int64")
        batch = batch.sort_values(["us", "snapshot_id"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        ids, counts, lows = self.index.get() if self.index.exists() else (b"", b"", b"")
        base = Baseline(
            np.frombuffer(ids, np.int64).tolist(), np.frombuffer(counts, np.int64).tolist(), np.frombuffer(lows, float).tolist(),
            lambda number: np.frombuffer(self.blocks.getValue((number,))[0], float).tolist(),
        )
        late = self.late.get()[0] if self.late.exists() else 0
        out = []
        for snapshot_id, ts, us, total in zip(batch["snapshot_id"], batch["ts"], batch["us"], batch["total_bytes"]):
            if last is not None and us < last[0]:
                late += 1  # an older row would rewrite past verdicts
                continue
            if last is not None:
                days = max((us - last[0]) / 86_400_000_000.0, H.MIN_GAP_DAYS)
                delta = int(total - last[1])
                rate = delta / days
                z, surge = verdict(base, delta, rate)
                out.append((key[0], snapshot_id, ts, delta, rate, len(base), z, surge, late))
                base.add(rate)
            last = (int(us), int(total))
        if last is not None:
            self.last.update(last)
        if base.changed:
            for number in base.changed:
                self.blocks.updateValue((number,), (np.array(base.rates(number), float).tobytes(),))
            self.index.update((np.array(base.ids, np.int64).tobytes(), np.array(base.counts, np.int64).tobytes(), np.array(base.lows, float).tobytes()))
        self.late.update((late,))
        columns = [f.split()[0] for f in OUTPUT.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"baseline_count": "int32", "late_dropped": "int64", "delta_bytes": "int64"})

    def close(self) -> None:
        pass


def stream_growth_alerts(snapshots: DataFrame) -> DataFrame:
    """Verdict of every snapshot as it arrives. The session needs the RocksDB state store (``STATE_STORE``).

    Of a target's rates a batch reads the index and the blocks that hold the
    answers, about ``2 log2(blocks)`` a verdict, and writes back the blocks that got
    a new rate. The new snapshots of one target are sorted inside its task, so
    triggers should keep batches moderate.
    """
    return snapshots.groupBy("target_key").transformWithStateInPandas(
        statefulProcessor=SurgeDetector(), outputStructType=OUTPUT, outputMode="append", timeMode="none"
    )
