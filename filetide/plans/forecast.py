"""Capacity forecast."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame

from ..operators import history


class Forecast(Mapping[str, DataFrame]):
    """The tables of a forecast by name, each built when first asked for: some write steps while they are built."""

    def __init__(self, snapshots: DataFrame, subfolders: DataFrame, threshold: Column | None) -> None:
        self.snapshots, self.subfolders, self.threshold = snapshots, subfolders, threshold
        self._made: dict[str, DataFrame] = {}
        self._build: dict[str, Callable[[], DataFrame]] = {
            "trend": self._trend,
            "baseline": lambda: history.rate_baseline(snapshots),
            "anomalies": lambda: self._points,
            "history": lambda: history.mark_anomalies(history.history_rows(snapshots), self._points),
            "contributors": self._contributors,
        }

    @cached_property
    def _points(self) -> DataFrame:
        return history.anomalies(self.snapshots)

    def _trend(self) -> DataFrame:
        fitted = history.model_confidence(history.threshold_status(history.regression(self.snapshots), self.threshold))
        return fitted.join(history.holt(self.snapshots), "target_key", "left")

    def _contributors(self) -> DataFrame:
        found = self._points.where("is_anomaly").select("target_key", "snapshot_id")
        return history.contributors(self.snapshots, self.subfolders, only=found)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._build[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


def forecast(snapshots: DataFrame, subfolders: DataFrame, threshold: Column | None = None) -> Forecast:
    """Trend, threshold, smoothing, anomalies and their contributors for every target."""
    return Forecast(snapshots, subfolders, threshold)
