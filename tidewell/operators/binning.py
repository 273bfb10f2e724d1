"""Time binning and whole days: the subtree that all rhythm measures share.

Activity is a long table (pid, ts, activity), one row per observation. Bins are
(pid, day, pos, x), one row per bin that has an observation; a missing bin is a
missing row. A whole day has all of its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.expressions import bin_of, clean, day_of
from tidewell.functions.params import bins_per_day, one_of


def bin_activity(activity: DataFrame, bin_minutes: int = 60) -> DataFrame:
    """Sums over clock-aligned bins; null and NaN observations are left out first."""
    bins_per_day(bin_minutes)
    rows = activity.select("pid", "ts", clean(F.col("activity").cast("double")).alias("x")).where("x is not null")
    return rows.groupBy("pid", day_of(F.col("ts")).alias("day"), bin_of(F.col("ts"), bin_minutes).alias("pos")).agg(F.sum("x").alias("x"))


def full_day_dates(bins: DataFrame, bin_minutes: int = 60) -> DataFrame:
    """(pid, day) of the whole days."""
    return bins.groupBy("pid", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == bins_per_day(bin_minutes)).select("pid", "day")


def count_full_days(bins: DataFrame, bin_minutes: int = 60) -> DataFrame:
    """(pid, n_days) for every pid that has a bin, 0 included."""
    days = bins.groupBy("pid", "day").agg((F.count(F.lit(1)) == bins_per_day(bin_minutes)).cast("long").alias("whole"))
    return days.groupBy("pid").agg(F.sum("whole").alias("n_days"))


def keep_full_days(bins: DataFrame, bin_minutes: int = 60) -> DataFrame:
    """The bins of whole days. One exchange on (pid, day), no join."""
    n = F.count(F.lit(1)).over(Window.partitionBy("pid", "day"))
    return bins.withColumn("_n", n).where(F.col("_n") == bins_per_day(bin_minutes)).drop("_n")


def daily_profile(full: DataFrame) -> DataFrame:
    """(pid, pos, x, n): mean of each bin of the day over the whole days, and their number."""
    return full.groupBy("pid", "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))


def circular_window(profile: DataFrame, width: int, kind: str, period: int, keys: tuple[str, ...] = ("pid",), value: str = "x") -> DataFrame:
    """(keys, total, pos): the run of ``width`` consecutive bins of least or greatest sum, around the clock.

    The earliest start wins ties. Rows are doubled by one period and summed
    over a row frame; a profile has at most ``period`` rows.
    """
    one_of("kind", kind, ("min", "max"))
    doubled = profile.select(*keys, F.explode(F.array("pos", F.col("pos") + period)).alias("pos"), F.col(value).alias("_v"))
    frame = Window.partitionBy(*keys).orderBy("pos").rowsBetween(0, width - 1)
    sums = doubled.withColumn("total", F.sum("_v").over(frame)).where(F.col("pos") < period)
    if kind == "min":
        best = sums.groupBy(*keys).agg(F.min(F.struct("total", "pos")).alias("b"))
        return best.select(*keys, "b.total", "b.pos")
    best = sums.groupBy(*keys).agg(F.max(F.struct(F.col("total"), (-F.col("pos")).alias("back"))).alias("b"))
    return best.select(*keys, "b.total", (-F.col("b.back")).alias("pos"))


def gate(roster: DataFrame, found: DataFrame, days: DataFrame, min_days: int, columns: list[str]) -> DataFrame:
    """One row per pid of roster; columns are null where fewer than min_days whole days were recorded."""
    joined = roster.select("pid").join(days, "pid", "left").join(found, "pid", "left")
    enough: Column = F.coalesce(F.col("n_days"), F.lit(0)) >= min_days
    return joined.select("pid", *[F.when(enough, F.col(c)).alias(c) for c in columns])


def roster_of(activity: DataFrame) -> DataFrame:
    """Every pid of activity, those without a usable observation too."""
    return activity.select("pid").distinct()
