"""Helpers that keep one hot key from becoming one slow task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_ROWS = 500_000  # a smaller group fits one task; salting it would only cost
HOT_LIST = 10_000  # bound on the broadcast list of hot keys: only keys with more than this share of all hot rows enter it


def hot_keys(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``keys`` of groups too large for one task, with ``_salts``: the tasks each is spread over, by its own rows.

    ``counts`` has one row per key and its rows in ``_rows``. At most
    ``HOT_LIST`` keys can hold ``1 / HOT_LIST`` of the hot rows, so the list is
    small whatever the input; a key below that share is no larger than any of the
    parts the others are cut into. None where no group is that large.
    """
    large = cut_lineage(counts.where(F.col("_rows") >= hot_rows).select(*keys, "_rows"))
    total = large.agg(F.sum("_rows")).first()[0]
    if not total:
        return None
    part = max(hot_rows, -(-total // HOT_LIST))
    return large.where(F.col("_rows") >= part).select(*keys, F.ceil(F.col("_rows") / part).cast("long").alias("_salts"))


def measured_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", *, counts: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """A join on ``keys`` in which a key of ``left`` takes as many tasks as its rows need.

    Rows of a hot key are dealt over its salts, and its rows of ``right`` repeated
    once per salt; every other key has salt 0. Every row of ``left`` meets every
    row of ``right`` with its key exactly once, so ``inner``, ``left``,
    ``left_semi`` and ``left_anti`` give what the plain join gives. The rows of
    each key are counted first, unless ``counts`` has them.
    """
    keys = list(keys)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("_rows"))
    found = hot_keys(counts.dropna(subset=keys), keys, hot_rows)
    if found is None:
        return left.join(right, keys, how)
    hot = F.broadcast(found)
    dealt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0).cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    one = left.join(hot, keys, "left").withColumn("_salt", dealt).drop("_salts")
    two = right.join(hot, keys, "left").withColumn("_salt", every).drop("_salts")
    return one.join(two, [*keys, "_salt"], how).drop("_salt")


def attach(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], *, group_rows: str, how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join per-group values back to the rows they came from, hot groups spread.

    ``groups`` has one row per key with its row count in ``group_rows`` (dropped
    from the result), so the rows need not be counted again; it is written once
    and read for both the list of hot keys and the join.
    """
    held = cut_lineage(groups)
    counts = held.select(*keys, F.col(group_rows).alias("_rows"))
    return measured_join(rows, held.drop(group_rows), keys, how, counts=counts, hot_rows=hot_rows)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every group.

    Spark plans ``row_number() <= k`` as a group limit before *and* after the
    shuffle, so at most ``k`` rows per group and map task travel, hot or not.
    """
    rank_name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank_name, F.row_number().over(window)).where(F.col(rank_name) <= k)
    return kept if rank else kept.drop(rank_name)


def sorted_by(df: DataFrame, order: Sequence[tuple[Column, bool]]) -> DataFrame:
    """``df`` sorted by ``(expression, descending)`` pairs, each expression worked out once per row.

    A sort on an expression evaluates it anew for both rows of every comparison.
    """
    names = [f"_order{i}" for i in range(len(order))]
    keyed = df.select("*", *[value.alias(name) for name, (value, _) in zip(names, order)])
    ways = [F.desc(name) if descending else F.asc(name) for name, (_, descending) in zip(names, order)]
    return keyed.orderBy(*ways).drop(*names)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return packed.select(*keys, "_row.*").select(*df.columns)


def lag_in_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slice_by: Column
) -> DataFrame:
    """``lag`` of ``values`` over ``keys`` ordered by ``order``, cut into slices of the order.

    ``slice_by`` must not decrease along the order (a month of the timestamp).
    Inside a slice it is a plain window, so a key with a third of all rows is
    many tasks. The first row of a slice takes the last row of the slice before
    it, found on the table of slices (one row per key and slice).
    New columns are named ``prev_<value>``; ``has_prev`` tells null from none.
    """
    keys, order, values = list(keys), list(order), list(values)
    sliced = df.withColumn("_slice", slice_by)
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    packed = F.struct(*dict.fromkeys([*order, *values]))
    tails = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max(packed).alias("_tail"), F.count("*").alias("_n"))
        .withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")))
        .drop("_tail")
    )
    lagged = sliced.withColumn("_prev", F.lag(packed).over(inner))
    joined = attach(lagged, tails, [*keys, "_slice"], group_rows="_n", how="left")
    joined = joined.withColumn("_prev", F.coalesce("_prev", "_carry"))
    return joined.select(
        *df.columns,
        F.col("_prev").isNotNull().alias("has_prev"),
        *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values],
    )


def number_rows(df: DataFrame, rank: Column, order: Sequence[Column], out: str, cuts: int = 200) -> DataFrame:
    """Consecutive numbers from 1 in ``order`` without sending everything to one task.

    ``rank`` is a double that never decreases along ``order``. One small action
    reads at most ``cuts`` quantiles of it; rows between two cuts are numbered on
    their own and shifted by the rows before them. Cut points only balance the
    work: the numbers do not depend on them.
    """
    ranked = df.withColumn("_key", rank)
    probs = [i / cuts for i in range(1, cuts)]
    row = ranked.agg(F.percentile_approx("_key", probs, 1000).alias("q")).first()
    bounds = sorted(set(row["q"] or []))
    # Number of cut points below the key, read from a literal array.
    points = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    ranked = ranked.withColumn("_part", F.size(F.filter(points, lambda b: b < F.col("_key"))))
    counts = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    # At most `cuts` rows: one task is enough and the broadcast is bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranked.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.row_number().over(inside) + F.col("_offset"))
        .drop("_part", "_offset", "_key")
    )


def _in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` sorted by ranges of key and order and written, with ``_at`` growing along and ``_part`` its partition.

    A large key is many partitions.
    """
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return cut_lineage(spread.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """Consecutive numbers from 0 along ``order`` among the rows of every key, however many rows one has.

    The rows a key has in the partitions before are added to the number in its own.
    """
    keys = list(keys)
    placed = _in_parts(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    pieces = pieces.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(pieces, [*keys, "_part"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key strictly before each row along ``order``; 0 for the first."""
    return _running(df, keys, order, value, out, F.sum, lambda inside, carried: F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0)))


def running_min(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """Least ``value`` of the rows of the key strictly before each row along ``order``; null where there is none."""
    return _running(df, keys, order, value, out, F.min, F.least)


def _running(df, keys, order, value, out, gather, both) -> DataFrame:
    keys = list(keys)
    placed = _in_parts(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(*keys, "_part").agg(gather(value).alias("_whole"))
    pieces = pieces.select(*keys, "_part", gather("_whole").over(before).alias("_carried"))
    joined = placed.withColumn("_inside", gather(value).over(inside)).join(pieces, [*keys, "_part"])
    return joined.select(*df.columns, both(F.col("_inside"), F.col("_carried")).alias(out))
