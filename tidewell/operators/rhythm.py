"""Rest-activity rhythm measures over the bins of whole days.

Each takes bins (see binning) and returns one row for every pid that has a
whole day, with a null value where the measure isn't defined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.params import bins_per_day, window_bins
from tidewell.operators.binning import circular_window, daily_profile


def interdaily_stability(full: DataFrame, min_days: int = 7) -> DataFrame:
    """(pid, interdaily_stability): variance of the daily profile over the variance of all bins.

    On whole days every position has as many bins, so this is N * sum of the
    profile's squares about the mean over p * sum of all squares about it.
    Null for a constant series and under min_days.
    """
    # one row per (pid, pos) goes on: counts, means and squares merge without the mean being known before
    by_pos = full.groupBy("pid", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    total = by_pos.groupBy("pid").agg(F.var_pop("m").alias("between"), F.avg("v").alias("within"), F.max("n").alias("n_days"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    value = F.when((F.col("n_days") >= min_days) & (F.col("lo") < F.col("hi")), F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0)))
    return total.select("pid", value.alias("interdaily_stability"))


def intradaily_variability(full: DataFrame, bin_minutes: int = 60, min_days: int = 1) -> DataFrame:
    """(pid, intradaily_variability): mean squared successive difference over the variance.

    Differences over a gap longer than a bin are left out, while N stays; null
    without any difference, for a constant series and under min_days. Days are
    summed up first, with their first and last bins; the step from a day to the
    next is that of two rows, joined by the day.
    """
    return variability_of(day_sums(full), bin_minutes, min_days)


def day_sums(full: DataFrame) -> DataFrame:
    """(pid, day, n, steps, m, v, lo, hi, first, last) of each whole day: what variability needs of it."""
    order = Window.partitionBy("pid", "day").orderBy("pos")
    rows = full.withColumn("_d", F.when(F.lag("pos").over(order) == F.col("pos") - 1, F.col("x") - F.lag("x").over(order)))
    return rows.groupBy("pid", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("steps"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min_by("x", "pos").alias("first"), F.max_by("x", "pos").alias("last"))


def variability_of(days: DataFrame, bin_minutes: int = 60, min_days: int = 1) -> DataFrame:
    """intradaily_variability of day_sums."""
    p = bins_per_day(bin_minutes)
    eve = days.select(F.col("pid").alias("_p"), F.date_add("day", 1).alias("_day"), F.col("last").alias("_eve"))
    linked = days.join(eve, (F.col("pid") == F.col("_p")) & (F.col("day") == F.col("_day")), "left").withColumn("over", (F.col("first") - F.col("_eve")) * (F.col("first") - F.col("_eve")))
    # whole days have as many bins each, so the variance is that of their means and the mean of theirs
    total = linked.groupBy("pid").agg(F.sum("n").alias("n"), F.sum("steps").alias("within"), F.sum("over").alias("over"), (F.var_pop("m") + F.avg("v")).alias("v"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    steps = F.when(F.col("within").isNotNull() | F.col("over").isNotNull(), F.coalesce("within", F.lit(0.0)) + F.coalesce("over", F.lit(0.0)))
    value = F.when((F.col("n") >= min_days * p) & (F.col("lo") < F.col("hi")), steps / F.nullif((F.col("n") - 1) * F.col("v"), F.lit(0.0)))
    return total.select("pid", value.alias("intradaily_variability"))


def _period(full: DataFrame, kind: str, hours: int, bin_minutes: int, name: str) -> DataFrame:
    width, p = window_bins(hours, bin_minutes), bins_per_day(bin_minutes)
    # sums over days decide: on counts they are exact, and dividing by the number of days doesn't change the order
    profile = full.groupBy("pid", "pos").agg(F.round(F.sum("x"), 6).alias("x"), F.count(F.lit(1)).alias("n"))
    found = circular_window(profile, width, kind, p)
    days = profile.groupBy("pid").agg(F.max("n").alias("n"))
    return found.join(days, "pid").select("pid", (F.col("total") / F.col("n") / width).alias(f"{name}_value"), (F.col("pos") * bin_minutes).cast("int").alias(f"{name}_onset_min"))


def least_active_period(full: DataFrame, hours: int = 5, bin_minutes: int = 60) -> DataFrame:
    """(pid, l_value, l_onset_min): mean and start of the least active hours of the daily profile."""
    return _period(full, "min", hours, bin_minutes, "l")


def most_active_period(full: DataFrame, hours: int = 10, bin_minutes: int = 60) -> DataFrame:
    """(pid, m_value, m_onset_min): mean and start of the most active hours of the daily profile."""
    return _period(full, "max", hours, bin_minutes, "m")


def cosinor(full: DataFrame, bin_minutes: int = 60) -> DataFrame:
    """(pid, mesor, cosinor_amplitude, acrophase_hours, cosinor_r_squared): one 24-hour harmonic fitted to the daily profile.

    The regressors are orthogonal on a whole day of bins, so the fit is a ratio
    of sums. With two bins a day only the cosine is there, at half the weight.
    Null for a constant profile.
    """
    p = bins_per_day(bin_minutes)
    angle = F.col("pos") * (2 * math.pi / p)
    weight = 2.0 / p if p > 2 else 1.0 / p
    sums = daily_profile(full).groupBy("pid").agg(F.avg("x").alias("m"), (F.sum(F.col("x") * F.cos(angle)) * weight).alias("b"), (F.sum(F.col("x") * F.sin(angle)) * weight).alias("g"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    power = F.col("b") * F.col("b") + F.col("g") * F.col("g")
    explained = power / 2 if p > 2 else power
    turn = F.pmod(F.atan2("g", "b"), F.lit(2 * math.pi)) * (24 / (2 * math.pi))
    varied = (F.col("lo") < F.col("hi")) & (F.col("v") > 0)
    value = {"mesor": F.col("m"), "cosinor_amplitude": F.sqrt(power), "acrophase_hours": turn, "cosinor_r_squared": explained / F.nullif(F.col("v"), F.lit(0.0))}
    return sums.select("pid", *[F.when(varied, c).alias(n) for n, c in value.items()])


def _window_sums(twice, width: int, period: int, sign: int):
    """(sum times sign, position) of each run of ``width`` values of an array that holds the period twice."""
    total = lambda i: F.aggregate(F.slice(twice, i + 1, F.lit(width)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda i: F.struct((total(i) * sign).alias("s"), i.alias("pos")))


def profile_measures(full: DataFrame, bin_minutes: int = 60, l_hours: int = 5, m_hours: int = 10, is_days: int = 7) -> DataFrame:
    """(pid, n_days, interdaily_stability, l_value, l_onset_min, m_value, m_onset_min, mesor, cosinor_amplitude, acrophase_hours, cosinor_r_squared).

    What the measures above give one by one, from a single pass over the bins:
    they all follow from each position's mean, spread and sum, of which a pid
    has at most 1440.
    """
    return measures_of(position_sums(full), bin_minutes, l_hours, m_hours, is_days)


def position_sums(full: DataFrame) -> DataFrame:
    """(pid, pos, n, m, v, s, lo, hi): number, mean, variance, sum and ends of each position's bins."""
    return full.groupBy("pid", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def merged_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    """position_sums of the bins of both."""
    both = a.join(b.withColumnsRenamed({c: f"_{c}" for c in ("n", "m", "v", "s", "lo", "hi")}), ["pid", "pos"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0))
    off = F.coalesce(F.col("m") - F.col("_m"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = (n * zero("m") + m * zero("_m")) / (n + m)
    spread = (n * zero("v") + m * zero("_v")) / (n + m) + n * m / ((n + m) * (n + m)) * off * off
    return both.select("pid", "pos", (n + m).alias("n"), mean.alias("m"), spread.alias("v"), (zero("s") + zero("_s")).alias("s"), F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"))


def measures_of(by_pos: DataFrame, bin_minutes: int = 60, l_hours: int = 5, m_hours: int = 10, is_days: int = 7) -> DataFrame:
    """profile_measures of position_sums."""
    p = bins_per_day(bin_minutes)
    by_pos = by_pos.withColumn("s", F.round("s", 6))
    angle, weight = F.col("pos") * (2 * math.pi / p), 2.0 / p if p > 2 else 1.0 / p
    one = by_pos.groupBy("pid").agg(
        F.max("n").alias("n_days"),
        F.var_pop("m").alias("between"),
        F.avg("v").alias("within"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.avg("m").alias("mean"),
        (F.sum(F.col("m") * F.cos(angle)) * weight).alias("b"),
        (F.sum(F.col("m") * F.sin(angle)) * weight).alias("g"),
        F.min("m").alias("least"),
        F.max("m").alias("most"),
        F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("profile"),
    )
    twice = F.transform(F.concat("profile", "profile"), lambda x: x["s"])
    columns = {"n_days": F.col("n_days")}
    varied = (F.col("n_days") >= is_days) & (F.col("lo") < F.col("hi"))
    columns["interdaily_stability"] = F.when(varied, F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0)))
    for name, hours, sign in (("l", l_hours, 1), ("m", m_hours, -1)):
        width = window_bins(hours, bin_minutes)
        best = F.array_min(_window_sums(twice, width, p, sign))  # the earliest of equals, as the position comes second
        columns[f"{name}_value"] = best["s"] * sign / F.col("n_days") / width
        columns[f"{name}_onset_min"] = (best["pos"] * bin_minutes).cast("int")
    power = F.col("b") * F.col("b") + F.col("g") * F.col("g")
    turn = F.pmod(F.atan2("g", "b"), F.lit(2 * math.pi)) * (24 / (2 * math.pi))
    curved = (F.col("least") < F.col("most")) & (F.col("between") > 0)
    for name, value in {"mesor": F.col("mean"), "cosinor_amplitude": F.sqrt(power), "acrophase_hours": turn, "cosinor_r_squared": (power / 2 if p > 2 else power) / F.nullif(F.col("between"), F.lit(0.0))}.items():
        columns[name] = F.when(curved, value)
    return one.select("pid", *[c.alias(n) for n, c in columns.items()])
