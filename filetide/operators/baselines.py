"""Running order statistics: median and MAD of all earlier values of a key, for keys of any size.

Values of a key are numbered along time and along size. Both orders are cut into
blocks of ``block`` rows. A time block is one task; of the time before it, it
knows how many values of each rank block came, and gets the values themselves of
only those rank blocks in which an answer can lie:

* the median moves by at most ``block`` places within a time block, so the rank
  blocks that far around the middle hold every median;
* the MAD is a distance to a known median, so it lies in the rank blocks that the
  least and the greatest possible distance touch on either side.

So a task holds a few blocks and one count for each other rank block, never a
key's history.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import number_within

BLOCK = 1 << 16  # least values a block (the root of the longest key, if that is more); a key of n values has n / BLOCK counts in a task
CHUNK = 128  # rows of a time block that are worked out together
SALTS = 16  # parts in which a rank block is sent to the time blocks that ask for it


class Seen:
    """Sorted values, each standing for ``weight`` rows of about that size."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.weights = values[order], weights[order].astype(np.int64)
        self._count()

    def _count(self) -> None:
        self.upto = np.cumsum(self.weights)
        self.total = int(self.upto[-1]) if len(self.upto) else 0
        self.ended = np.append(self.values, np.inf)

    def add(self, new: np.ndarray) -> None:
        new = np.sort(new)
        at = np.searchsorted(self.values, new)
        self.values, self.weights = np.insert(self.values, at, new), np.insert(self.weights, at, 1)
        self._count()

    def at(self, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest value, from 0; infinities beyond both ends."""
        return np.where(k < 0, -np.inf, self.ended[np.searchsorted(self.upto, k, "right")])

    def distance(self, centre: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest distance to ``centre``: of all windows of ``k + 1`` neighbours the one that reaches least far."""
        inside = (k >= 0) & (k < self.total)
        k = np.clip(k, 0, max(self.total - 1, 0))
        low, high = np.zeros(len(k), np.int64), np.maximum(self.total - 1 - k, 0)
        while (low < high).any():
            middle = (low + high) // 2
            right = self.at(middle + k) - centre >= centre - self.at(middle)
            low, high = np.where(right, low, np.minimum(middle + 1, high)), np.where(right, middle, high)
        reach = lambda a: np.maximum(centre - self.at(a), self.at(a + k) - centre)
        best = np.minimum(reach(low), np.where(low > 0, reach(np.maximum(low - 1, 0)), np.inf))
        return np.where(inside, best, np.where(k < 0, -np.inf, np.inf)) if self.total else np.where(inside, 0.0, np.inf)


def kth_of_both(one: Callable[[np.ndarray], np.ndarray], others: np.ndarray, counts: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest of a sorted sequence ``one`` and row-wise sorted ``others``, of which ``counts`` count."""
    rows = np.arange(len(k))
    taken = lambda e: np.where(e > 0, others[rows, np.maximum(e - 1, 0)], -np.inf)
    rest = lambda e: np.where(k - e < 0, -np.inf, one(np.maximum(k - e, 0)))
    low, high = np.zeros(len(k), np.int64), np.minimum(counts, np.maximum(k + 1, 0))
    while (low < high).any():
        middle = (low + high) // 2
        enough = taken(middle) >= rest(middle)
        low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
    both = lambda e: np.maximum(rest(e), taken(e))
    return np.minimum(both(low), np.where(low > 0, both(np.maximum(low - 1, 0)), np.inf))


def middle_of(n: np.ndarray, kth: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Median by position: the middle value, or the mean of the middle two."""
    upper = kth(n // 2)
    return np.where(n % 2 == 1, upper, (kth(n // 2 - 1) + upper) / 2.0)


def walk(values: np.ndarray, before: int, seen: Seen, medians: np.ndarray | None = None, spread: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of everything before each value; ``before`` values came before the first."""
    found, spreads = np.full(len(values), np.nan), np.full(len(values), np.nan)
    with np.errstate(invalid="ignore"):
        for a in range(0, len(values), CHUNK):
            new = values[a : a + CHUNK]
            w = len(new)
            counts, earlier = np.arange(w), np.tri(w, k=-1, dtype=bool)
            n = before + a + counts
            if medians is None:
                others = np.sort(np.where(earlier, new[None, :], np.inf), axis=1)
                centre = middle_of(n, lambda k: kth_of_both(seen.at, others, counts, k))  # noqa: B023
            else:
                centre = medians[a : a + CHUNK]
            found[a : a + CHUNK] = centre
            if spread:
                others = np.sort(np.where(earlier, np.abs(new[None, :] - centre[:, None]), np.inf), axis=1)
                spreads[a : a + CHUNK] = middle_of(n, lambda k: kth_of_both(lambda q: seen.distance(centre, q), others, counts, k))  # noqa: B023
            seen.add(new)
    return found, spreads


def touched(n: np.ndarray, medians: np.ndarray, low: np.ndarray, high: np.ndarray, seen: np.ndarray, slack: int) -> np.ndarray:
    """Which rank blocks (``low`` to ``high``, with ``seen`` values each) the MAD of any row may lie in.

    Up to ``slack`` more values may have come, anywhere. The distance is bracketed by
    halving: blocks that a distance only touches count wholly for its least,
    not at all for its greatest value.
    """
    upto = np.concatenate([[0], np.cumsum(seen)])
    least, most = (n - 1) // 2 + 1, n // 2 + 1
    if not len(medians) or not len(low):
        return np.zeros(len(low), bool)

    def outer(d: np.ndarray) -> np.ndarray:
        return np.maximum(upto[np.searchsorted(low, medians + d, "right")] - upto[np.searchsorted(high, medians - d, "left")], 0)

    def inner(d: np.ndarray) -> np.ndarray:
        return np.maximum(upto[np.searchsorted(high, medians + d, "right")] - upto[np.searchsorted(low, medians - d, "left")], 0)

    far = np.maximum(np.abs(high[-1] - medians), np.abs(medians - low[0]))
    nearest, b, c, d = np.zeros(len(medians)), far.copy(), np.zeros(len(medians)), far.copy()
    for _ in range(50):
        middle = (nearest + b) / 2
        short = outer(middle) + slack < least
        nearest, b = np.where(short, middle, nearest), np.where(short, b, middle)
        middle = (c + d) / 2
        enough = inner(middle) >= most
        c, d = np.where(enough, c, middle), np.where(enough, middle, d)
    edge = np.zeros(len(low) + 1, np.int64)
    for x, y in ((medians - d, medians - nearest), (medians + nearest, medians + d)):
        first, last = np.searchsorted(high, x, "left"), np.searchsorted(low, y, "right")
        some = first < last
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some], -1)
    return (np.cumsum(edge[:-1]) > 0) & (seen > 0)


def running_median_mad(rows: DataFrame, key: str, order: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``earlier_count``, ``earlier_median`` and ``earlier_mad`` of the values before each row along ``order``.

    ``value`` is a double without nulls or NaN and ``order`` tells all rows of a key
    apart. Without earlier values median and MAD are null.
    """
    # Whatever arrives keeps its columns: only the numbered value goes through Python.
    timed = number_within(rows, [key], order, "_t")
    # Time blocks times rank blocks are counted: from the root of the longest key up, these are no more than its values.
    block = max(block, isqrt(timed.agg(F.max("_t")).first()[0] or 0) + 1)
    ranked = number_within(timed.select(key, "_t", value), [key], [value, "_t"], "_r")
    narrow = cut_lineage(ranked.select(
        key, "_t", F.col(value).alias("_v"), F.floor(F.col("_t") / block).alias("_tb"), F.floor(F.col("_r") / block).alias("_rb"),
    ))
    kind = narrow.schema[key].dataType.simpleString()
    done = f"{key} {kind}, _t bigint, _median double, _mad double"

    def alone(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_t")
        median, mad = walk(frame["_v"].to_numpy(float), 0, Seen(np.zeros(0), np.zeros(0)))
        return frame[[key, "_t"]].assign(_median=median, _mad=mad)

    # The first block of a key has nothing before it.
    base = narrow.where("_tb = 0").groupBy(key).applyInPandas(alone, done)
    later = narrow.where("_tb > 0")
    if not later.isEmpty():
        base = base.unionByName(_later_blocks(narrow, key, kind, done, block))
    base = base.select(key, "_t", "_median", "_mad")
    joined = timed.join(base, [key, "_t"])
    some = F.col("_t") > 0
    return joined.select(
        *rows.columns, F.col("_t").alias("earlier_count"), F.when(some, F.col("_median")).alias("earlier_median"), F.when(some, F.col("_mad")).alias("earlier_mad")
    )


def context(narrow: DataFrame, counts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What each time block is sent: values that came before it in the wanted rank blocks, one row for every other rank block."""
    by = [key, "_tb"]
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sent = narrow.select(key, "_rb", "_v", F.col("_tb").alias("_own"), F.pmod("_t", F.lit(SALTS)).cast("int").alias("_salt"))
    values = sent.join(wanted.withColumn("_salt", salts), [key, "_rb", "_salt"]).where("_own < _tb")
    others = counts.join(wanted, [*by, "_rb"], "left_anti").select(*by, F.col("low").alias("x"), F.col("seen").alias("w"))
    return values.select(*by, F.col("_v").alias("x"), F.lit(1).cast("bigint").alias("w")).unionByName(others)


def _later_blocks(narrow: DataFrame, key: str, kind: str, done: str, block: int) -> DataFrame:
    """Median and MAD of the rows of all time blocks but the first of each key."""
    by = [key, "_tb"]
    later = narrow.where("_tb > 0")
    # How many values of each rank block came before each time block.
    last = narrow.groupBy(key).agg(F.max("_tb").alias("_last"))
    edges = narrow.groupBy(key, "_rb").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    along = Window.partitionBy(key, "_rb").orderBy("_tb")
    cells = narrow.groupBy(key, "_rb", "_tb").agg(F.count("*").alias("n")).join(last, key)
    cells = cells.withColumn("seen", F.sum("n").over(along)).withColumn("_until", F.coalesce(F.lead("_tb").over(along), F.col("_last")))
    counts = cells.where("_until > _tb").select(key, "_rb", "seen", F.explode(F.sequence(F.col("_tb") + 1, F.col("_until"))).alias("_tb"))
    counts = cut_lineage(counts.join(edges, [key, "_rb"]))

    def median_of(keys: tuple, own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_t")
        median, _ = walk(own["_v"].to_numpy(float), int(keys[1]) * block, Seen(before["x"].to_numpy(float), before["w"].to_numpy()), spread=False)
        return own[[key, "_tb", "_t", "_v"]].assign(_median=median)

    def mad_of(keys: tuple, own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_t")
        median = own["_median"].to_numpy(float)
        _, mad = walk(own["_v"].to_numpy(float), int(keys[1]) * block, Seen(before["x"].to_numpy(float), before["w"].to_numpy()), medians=median)
        return own[[key, "_t", "_median"]].assign(_mad=mad)

    def asked(keys: tuple, own: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_rb")
        hit = touched(own["_t"].to_numpy(), own["_median"].to_numpy(float), blocks["low"].to_numpy(float), blocks["high"].to_numpy(float), blocks["seen"].to_numpy(), block)
        return blocks.loc[hit, [key, "_tb", "_rb"]]

    inside = Window.partitionBy(*by).orderBy("_rb")
    place = counts.withColumn("_upto", F.sum("seen").over(inside))
    half = F.floor(F.col("_tb") * block / 2)
    around = cut_lineage(place.where((F.col("_upto") >= half - block) & (F.col("_upto") - F.col("seen") <= half + block)).select(*by, "_rb"))
    # Both sides come from one table: new names of their own keep their columns apart.
    grouped = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns]).groupBy(*by)
    medians = grouped(later.select(*by, "_t", "_v")).cogroup(grouped(context(narrow, counts, around, key))).applyInPandas(median_of, f"{key} {kind}, _tb bigint, _t bigint, _v double, _median double")
    medians = cut_lineage(medians)
    wanted = grouped(medians).cogroup(grouped(counts.select(*by, "_rb", "seen", "low", "high"))).applyInPandas(asked, f"{key} {kind}, _tb bigint, _rb bigint")
    wanted = cut_lineage(wanted)
    return grouped(medians).cogroup(grouped(context(narrow, counts, wanted, key))).applyInPandas(mad_of, done)
