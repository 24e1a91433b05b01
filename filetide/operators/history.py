"""Snapshot history: retention, growth, anomalies, regression, smoothing, thresholds.

Retention belongs to the store (``retain_newest``); analysis reads every row it is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tree
from .baselines import BLOCK, running_median_mad
from .skew import lag_in_slices, newest, number_within, top_k

# Fixed values of the history store and the forecast model.
RETAINED = 500
MIN_SCANS = 3
MIN_DELTAS = 5
MIN_ANOMALY_BYTES = 500 * 1024 * 1024
MAD_FLOOR = 10.0 * 1024 * 1024
Z_LIMIT = 3.5
Z_SCALE = 0.6745
ALPHA, BETA = 0.3, 0.1
MIN_HOLT_STEP = 0.001
MIN_GAP_DAYS = 1.0 / 86400.0
DAYS_PER_MONTH = 30.4375
GIB = 1024**3


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed days with microsecond precision."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def append_snapshot(entries: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """The history rows of a finished scan: totals of the root, sizes of its direct subfolders."""
    rolled = tree.rollup(entries)
    roots = rolled.where(F.col("folder_key") == F.col("root_key"))
    totals = roots.select(
        F.col("root_key").alias("target_key"), "snapshot_id", ts.alias("ts"),
        F.col("bytes").alias("total_bytes"), F.col("files").alias("total_files"),
    )
    direct = rolled.where(tree.P.level_below("folder_key", "root_key") == 1)
    subfolders = direct.select(
        F.col("root_key").alias("target_key"), "snapshot_id",
        tree.P.leaf("folder_key").alias("name"), F.col("bytes").alias("size"),
    )
    return totals, subfolders


def load_history(sources: Sequence[DataFrame]) -> DataFrame:
    """Merge stores to one row per target and second; of several the earliest (ts, id) stays."""
    merged = reduce(DataFrame.unionByName, sources).withColumn("_second", F.date_trunc("second", "ts"))
    rest = [c for c in merged.columns if c not in ("target_key", "_second", "ts", "snapshot_id")]
    packed = merged.groupBy("target_key", "_second").agg(F.min(F.struct("ts", "snapshot_id", *rest)).alias("_row"))
    return packed.select("target_key", "_row.*").select(*sources[0].columns)


def retain_newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = RETAINED) -> DataFrame:
    """The newest ``k`` rows of every key."""
    return top_k(df, keys, [F.desc(c) for c in order], k)


def change_since_last(current: DataFrame, snapshots: DataFrame, as_of: Column, settle_seconds: int = 3) -> DataFrame:
    """Current total against the newest snapshot older than ``settle_seconds``; none means a first scan.

    ``current(target_key, total_bytes)`` has one row per target.
    """
    past = snapshots.where(F.unix_micros(as_of) - F.unix_micros("ts") > settle_seconds * 1_000_000)
    last = newest(past.select("target_key", "ts", "snapshot_id", "total_bytes"), ["target_key"], ["ts", "snapshot_id"])
    last = last.select("target_key", F.col("snapshot_id").alias("last_snapshot_id"), F.col("total_bytes").alias("_last"))
    diff = F.coalesce(F.col("total_bytes") - F.col("_last"), F.lit(0))
    status = F.when(F.col("_last").isNull(), F.lit("Initial")).when(diff > 0, F.lit("Grown")).when(
        diff < 0, F.lit("Shrunk")).otherwise(F.lit("Unchanged"))
    return current.join(last, "target_key", "left").withColumn("diff_bytes", diff).withColumn("status", status).drop("_last")


# --- growth ----------------------------------------------------------------

def growth(snapshots: DataFrame) -> DataFrame:
    """Change, elapsed days (at least a second) and daily rate between neighbouring snapshots."""
    lagged = lag_in_slices(
        snapshots, ["target_key"], ["ts", "snapshot_id"], ["ts", "snapshot_id", "total_bytes"],
        F.date_trunc("month", "ts"),
    )
    gap = F.greatest(days_between("ts", "prev_ts"), F.lit(MIN_GAP_DAYS))
    delta = F.col("total_bytes") - F.col("prev_total_bytes")
    return (
        lagged.withColumn("days_elapsed", F.when(F.col("has_prev"), gap))
        .withColumn("delta_bytes", F.when(F.col("has_prev"), delta))
        .withColumn("rate", F.col("delta_bytes") / F.col("days_elapsed"))
    )


def history_rows(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with its difference to the older one; the first is the initial scan."""
    label = F.when(~F.col("has_prev"), F.lit("Initial scan")).when(F.col("delta_bytes") > 0, F.lit("Growth")).when(
        F.col("delta_bytes") < 0, F.lit("Reduction")).otherwise(F.lit("No change"))
    return growth(snapshots).withColumn("change", label)


def anomalies(snapshots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Causal surge test: each change against the median and MAD of all strictly earlier rates.

    Later snapshots never change a verdict. A target of any size is worked on in
    blocks of ``block`` snapshots (``baselines``). Rows without a rate (a total is
    null) have no baseline and no verdict and enter no baseline.
    """
    rates = growth(snapshots).where("has_prev").drop("has_prev")
    based = running_median_mad(rates.where(F.col("rate").isNotNull()), "target_key", ["ts", "snapshot_id"], "rate", block)
    based = based.unionByName(rates.where(F.col("rate").isNull()), allowMissingColumns=True)
    enough = F.col("earlier_count") >= MIN_DELTAS
    based = based.withColumns({
        "baseline_count": F.col("earlier_count").cast("int"),
        "baseline_median": F.when(enough, F.col("earlier_median")),
        "baseline_mad": F.when(enough, F.greatest("earlier_mad", F.lit(MAD_FLOOR))),
    }).drop("earlier_count", "earlier_median", "earlier_mad")
    z = F.lit(Z_SCALE) * F.abs(F.col("rate") - F.col("baseline_median")) / F.col("baseline_mad")
    surge = (
        enough_rates()
        & (F.col("delta_bytes") >= MIN_ANOMALY_BYTES)
        & (F.col("rate") > F.col("baseline_median"))
        & (F.col("z_score") > Z_LIMIT)
    )
    return (
        based.withColumn("z_score", F.when(enough_rates(), z))
        .withColumn("insufficient_baseline", ~enough_rates())
        .withColumn("is_anomaly", F.coalesce(surge, F.lit(False)))
    )


def enough_rates() -> Column:
    return F.coalesce(F.col("baseline_count") >= MIN_DELTAS, F.lit(False))


def mark_anomalies(rows: DataFrame, points: DataFrame) -> DataFrame:
    """History rows with the verdict of the same snapshot."""
    verdict = points.select("target_key", "snapshot_id", "is_anomaly", "z_score")
    return rows.join(verdict, ["target_key", "snapshot_id"], "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False))
    )


def _middle(values: DataFrame, value: str, out: str) -> DataFrame:
    """Median by position of every target; the rows are ranked across tasks, so no target is gathered."""
    ranked = number_within(values, ["target_key"], [value], "_r")
    sizes = values.groupBy("target_key").agg(F.count("*").alias("_n"))
    middle = F.col("_r").between(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    return ranked.join(sizes, "target_key").where(middle).groupBy("target_key").agg(F.avg(value).alias(out))


def rate_baseline(snapshots: DataFrame) -> DataFrame:
    """Median daily rate and MAD (with its floor) of each target over its whole history."""
    rates = cut_lineage(growth(snapshots).where(F.col("rate").isNotNull()).select("target_key", "rate"))
    medians = _middle(rates, "rate", "median_rate")
    away = rates.join(medians, "target_key").select("target_key", F.abs(F.col("rate") - F.col("median_rate")).alias("away"))
    both = medians.join(_middle(away, "away", "_mad"), "target_key")
    return both.select("target_key", "median_rate", F.greatest("_mad", F.lit(MAD_FLOOR)).alias("effective_mad"))


# --- contributors ----------------------------------------------------------

def subfolder_growth(snapshots: DataFrame, subfolders: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Subfolder sizes beside those of the snapshot before; a name is matched without case.

    ``only(target_key, snapshot_id)`` names the snapshots wanted.
    """
    pairs = growth(snapshots).select("target_key", "snapshot_id", "prev_snapshot_id")
    if only is not None:
        pairs = pairs.join(only, ["target_key", "snapshot_id"], "left_semi")
    keyed = subfolders.withColumn("name_key", F.lower("name"))
    previous = keyed.groupBy(
        "target_key", F.col("snapshot_id").alias("prev_snapshot_id"), "name_key"
    ).agg(F.max("size").alias("previous_size"))
    now = keyed.join(pairs, ["target_key", "snapshot_id"])
    joined = now.join(previous, ["target_key", "prev_snapshot_id", "name_key"], "left")
    return joined.select(
        "target_key", "snapshot_id", "prev_snapshot_id", "name", F.col("size").alias("current_size"),
        F.coalesce("previous_size", F.lit(0)).alias("previous_size"),
    ).withColumn("delta_bytes", F.col("current_size") - F.col("previous_size"))


def contributors(snapshots: DataFrame, subfolders: DataFrame, k: int = 5, *, only: DataFrame | None = None) -> DataFrame:
    """Growing subfolders of each snapshot (of ``only``, where given) with their share of all growth; the ``k`` largest."""
    grown = subfolder_growth(snapshots, subfolders, only).where(F.col("delta_bytes") > 0)
    keys = ["target_key", "snapshot_id"]
    totals = grown.groupBy(*keys).agg(F.sum("delta_bytes").alias("_total"), F.count("*").alias("_n"))
    top = top_k(grown, keys, [F.desc("delta_bytes"), F.col("name")], k, "rank")
    share = F.bround(F.col("delta_bytes") / F.col("_total") * 100.0, 1)
    return top.join(totals.drop("_n"), keys).withColumn("contribution_percent", share).drop("_total")


# --- trend -----------------------------------------------------------------

def regression(snapshots: DataFrame) -> DataFrame:
    """Least squares of bytes on elapsed days for every target at once.

    One aggregation: Spark's moments merge around running means, so they combine
    map-side and need no centring pass, and no target is gathered anywhere.
    """
    x = F.unix_micros("ts") / F.lit(86_400_000_000.0)
    y = F.col("total_bytes").cast("double")
    fitted = snapshots.groupBy("target_key").agg(
        F.count("*").alias("scans"), F.min(x).alias("_x0"),
        F.max(F.struct("ts", "snapshot_id", "total_bytes")).alias("_last"), F.max(x).alias("_x1"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_cov"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
    )
    enough = F.col("scans") >= MIN_SCANS
    moves_x = F.col("_vx") * F.col("scans") > 1e-9
    moves_y = F.col("_vy") * F.col("scans") > 1e-9
    slope = F.when(moves_x, F.col("_cov") / F.col("_vx")).otherwise(F.lit(0.0))
    r2 = F.when(moves_x & moves_y, F.least(F.lit(1.0), F.col("_cov") * F.col("_cov") / (F.col("_vx") * F.col("_vy"))))
    return fitted.select(
        "target_key", "scans",
        F.when(enough, slope).alias("slope"),
        F.when(enough, F.col("_my") - slope * (F.col("_mx") - F.col("_x0"))).alias("intercept"),
        F.when(enough, F.coalesce(r2, F.lit(0.0))).alias("r_squared"),
        F.col("_last.ts").alias("latest_ts"),
        F.col("_last.total_bytes").alias("latest_bytes"),
        (F.col("_x1") - F.col("_x0")).alias("latest_day"),
    )


def threshold_status(fitted: DataFrame, threshold: Column | None = None) -> DataFrame:
    """When the line reaches the threshold; default: 10 GiB or a fifth above the latest size."""
    latest = F.col("latest_bytes")
    default = F.greatest(latest + 10 * GIB, F.floor(latest * 1.2).cast("long"))
    limit = default if threshold is None else F.when(threshold > 0, threshold).otherwise(default)
    with_limit = fitted.withColumn("threshold_bytes", limit)
    days = (F.col("threshold_bytes") - F.col("intercept")) / F.col("slope") - F.col("latest_day")
    status = (
        F.when(F.col("scans") < MIN_SCANS, F.lit("NotEnoughData"))
        .when(latest >= F.col("threshold_bytes"), F.lit("AlreadyExceeded"))
        .when(F.col("slope") <= 0, F.lit("DecreasingOrFlat"))
        .when(days >= 0, F.lit("Reachable"))
        .otherwise(F.lit("AlreadyExceeded"))
    )
    dated = with_limit.withColumn("status", status).withColumn(
        "days_to_target",
        F.when(F.col("status") == "Reachable", days)
        .when((F.col("status") == "AlreadyExceeded") & (latest >= F.col("threshold_bytes")), F.lit(0.0)),
    )
    micros = F.unix_micros("latest_ts") + F.floor(F.col("days_to_target") * 86_400_000_000.0).cast("long")
    reachable_range = F.col("days_to_target") < 3_000_000
    return dated.withColumn("target_date", F.when(reachable_range, F.timestamp_micros(micros)))


def model_confidence(fitted: DataFrame) -> DataFrame:
    """Confidence class of the fit and the growth per mean month."""
    r2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r_squared")))
    label = F.when(r2 >= 0.8, F.lit("High")).when(r2 >= 0.5, F.lit("Medium")).when(r2.isNotNull(), F.lit("Low"))
    return fitted.withColumn("confidence", label).withColumn("monthly_bytes", F.col("slope") * DAYS_PER_MONTH)


def _steps(maps: Column) -> Column:
    """Maps of (level, trend) composed in order: a 2 x 2 matrix ``m`` and a shift ``v``."""
    def then(one: Column, two: Column) -> Column:
        cell = lambda i, j: two[f"m{i}0"] * one[f"m0{j}"] + two[f"m{i}1"] * one[f"m1{j}"]
        shift = lambda i: two[f"m{i}0"] * one["v0"] + two[f"m{i}1"] * one["v1"] + two[f"v{i}"]
        return F.struct(*[cell(i, j).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1)], shift(0).alias("v0"), shift(1).alias("v1"))

    same = {"m00": 1.0, "m01": 0.0, "m10": 0.0, "m11": 1.0, "v0": 0.0, "v1": 0.0}
    start = F.struct(*[F.lit(v).alias(k) for k, v in same.items()])
    fields = lambda x: F.struct(*[x[k].alias(k) for k in same])
    return F.aggregate(maps, start, lambda one, two: then(one, fields(two)))


def holt(snapshots: DataFrame) -> DataFrame:
    """Holt's linear smoothing for uneven spacing, over each target's whole history.

    It starts at the first point with the first slope as trend and is applied
    from the second point on. A step is an affine map of (level, trend), so the
    steps of a month are composed on their own, then the months.
    """
    moved = growth(snapshots).where("has_prev")
    dt = F.greatest(days_between("ts", "prev_ts"), F.lit(MIN_HOLT_STEP))
    y = F.col("total_bytes").cast("double")
    order = [F.col("ts").alias("ts"), F.col("snapshot_id").alias("snapshot_id")]
    step = F.struct(
        *order, F.lit(1 - ALPHA).alias("m00"), ((1 - ALPHA) * dt).alias("m01"), (-ALPHA * BETA / dt).alias("m10"),
        F.lit(BETA * (1 - ALPHA) + 1 - BETA).alias("m11"), (ALPHA * y).alias("v0"), (ALPHA * BETA * y / dt).alias("v1"),
    )
    first = F.min(F.struct(*order, F.col("prev_total_bytes").cast("double").alias("y0"), y.alias("y1"), dt.alias("dt"))).alias("first")
    months = moved.groupBy("target_key", F.date_trunc("month", "ts").alias("month")).agg(
        F.array_sort(F.collect_list(step)).alias("steps"), first, F.count("*").alias("n")
    )
    months = months.select("target_key", "month", _steps(F.col("steps")).alias("map"), "first", "n")
    whole = months.groupBy("target_key").agg(
        F.array_sort(F.collect_list(F.struct("month", "map.*"))).alias("maps"), F.min("first").alias("first"), F.sum("n").alias("n")
    ).where(F.col("n") + 1 >= MIN_SCANS)
    level, trend = F.col("first.y0"), (F.col("first.y1") - F.col("first.y0")) / F.col("first.dt")
    ended = whole.select("target_key", _steps(F.col("maps")).alias("m"), level.alias("l"), trend.alias("t"))
    end = lambda i: F.col(f"m.m{i}0") * F.col("l") + F.col(f"m.m{i}1") * F.col("t") + F.col(f"m.v{i}")
    return ended.select("target_key", end(0).alias("level"), end(1).alias("trend"))
