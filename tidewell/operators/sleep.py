"""Sleep scoring of minute series and nightly sleep measures.

Scorers look at neighbours by position, whatever the time between them. They
run over ranges of positions with a halo of neighbours, so a recording spreads
over as many tasks as it has ranges. Nights are ranges of time, both ends
included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.expressions import non_negative
from tidewell.functions.params import bins_per_day, one_of, window_bins
from tidewell.operators.binning import bin_activity, circular_window, keep_full_days

SLEEP, WAKE = 0, 1
SCORERS = ("cole_kripke", "sadeh")

# Published weights of the two scorers and limits of the rescoring rules.
COLE_KRIPKE = (404, 598, 326, 441, 1408, 508, 350, 188)
SADEH = (7.601, 0.065, 1.08, 0.056, 0.703)
WEBSTER = ((1, 4), (2, 10), (3, 20))


#: Rows of a range of a recording, and rows of its neighbours that it sees on either side: the rescoring rules look at
#: runs of up to 3 rows between runs of at least 20, the scorers at up to 5 rows.
RANGE, HALO = 8192, 32


def in_ranges(rows: DataFrame, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """rows with their position in the recording (_pos), once for each range of ``size`` positions that sees them (_range), _own in one.

    Positions are counted by day: the days of a year are summed within it, and
    the years of a pid, of which there are few, in an array. So no task holds a
    recording, however long, and a range sees as many neighbours as it needs
    whatever the time between them. Equal times are ordered by activity or
    label. A null time comes first.
    """
    tie = [c for c in ("activity", "label") if c in rows.columns]
    rows = rows.withColumns({"_day": F.to_date("ts"), "_year": F.coalesce(F.year("ts"), F.lit(-1_000_000))})
    days = rows.groupBy("pid", "_year", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("pid", "_year").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    years = days.groupBy("pid", "_year").agg(F.sum("_n").alias("_n")).groupBy(F.col("pid").alias("_p")).agg(F.collect_list(F.struct("_year", "_n")).alias("_years"))
    earlier = F.aggregate(F.filter("_years", lambda y: y["_year"] < F.col("_year")), F.lit(0).cast("long"), lambda a, y: a + y["_n"])
    starts = days.withColumn("_before", F.coalesce(before, F.lit(0))).join(years, F.col("pid").eqNullSafe(F.col("_p")))
    starts = starts.select("_p", F.col("_day").alias("_d"), (earlier + F.col("_before")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("pid", "_day").orderBy("ts", *tie)) - 1
    rows = rows.withColumn("_k", place).join(starts, F.col("pid").eqNullSafe(F.col("_p")) & F.col("_day").eqNullSafe(F.col("_d")))
    rows = rows.withColumn("_pos", F.col("_start") + F.col("_k")).drop("_day", "_year", "_p", "_d", "_start", "_k")
    own, at = F.floor(F.col("_pos") / size), F.col("_pos") % size
    seen = F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= size - halo, own + 1)))
    return rows.select("*", F.posexplode(seen).alias("_other", "_range")).withColumn("_own", F.col("_other") == 0).drop("_other")


def _order() -> Window:
    return Window.partitionBy("pid", "_range").orderBy("_pos")


def _cole_kripke(rows: DataFrame) -> DataFrame:
    near = [F.coalesce(F.lag("_a", 4 - k).over(_order()), F.lit(0.0)) * F.lit(float(w)) for k, w in enumerate(COLE_KRIPKE)]
    total = near[0]
    for x in near[1:]:
        total = total + x
    rows = rows.withColumn("_a", non_negative(F.col("activity").cast("double")))
    return rows.withColumn("label", F.when(total * F.lit(1e-5) >= 1.0, WAKE).otherwise(SLEEP)).drop("_a")


def _sadeh(rows: DataFrame) -> DataFrame:
    c, m, nat, sd, lg = SADEH
    rows = rows.withColumn("_a", non_negative(F.col("activity").cast("double")))
    rows = rows.withColumn("_w", F.array(*[F.coalesce(F.lag("_a", -k).over(_order()), F.lit(0.0)) for k in range(-5, 6)]))
    rows = rows.withColumn("_m", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / 11)
    rows = rows.withColumn("_sd", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / 11))
    rows = rows.withColumn("_nat", F.size(F.filter("_w", lambda x: (x > 50) & (x <= 100))))
    index = F.lit(c) - F.lit(m) * F.col("_m") - F.lit(nat) * F.col("_nat") - F.lit(sd) * F.col("_sd") - F.lit(lg) * F.log1p("_a")
    return rows.withColumn("label", F.when(index < 0, WAKE).otherwise(SLEEP)).drop("_a", "_w", "_m", "_sd", "_nat")


def _webster(rows: DataFrame) -> DataFrame:
    """Rows in ranges, rescored. Each row learns where its own run and the two around it start, from the rows before it and, in the other order, after it.

    A range's halo is longer than the longest run that can decide, so runs cut
    off at its edge are long enough as they are.
    """
    before = _order().rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("pid", "_range").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, -1)
    starts = lambda c: F.when(F.col("_starts"), c)
    found = rows.withColumn("_starts", F.coalesce(F.col("label") != F.lag("label").over(_order()), F.lit(True)))
    found = found.withColumn("_first", F.last(starts(F.col("_pos")), True).over(before))
    found = found.withColumn("_lag", F.lag("_first").over(_order()))
    found = found.withColumn("_prev", F.last(starts(F.coalesce("_lag", F.col("_pos"))), True).over(before))  # a first run's is its own start
    end = F.coalesce(F.max("_pos").over(after), F.col("_pos")) + 1
    found = found.withColumn("_next", F.coalesce(F.last(starts(F.col("_pos")), True).over(after), end))
    found = found.withColumn("_second", F.coalesce(F.last(starts(F.col("_next")), True).over(after), F.col("_next")))
    size, around = F.col("_next") - F.col("_first"), F.least(F.col("_first") - F.col("_prev"), F.col("_second") - F.col("_next"))
    rescued = F.lit(False)
    for most, least in WEBSTER:
        rescued = rescued | ((size <= most) & (around >= least))
    return found.withColumn("label", F.when((F.col("label") == SLEEP) & rescued, WAKE).otherwise(F.col("label"))).select(rows.columns)


def _labelled(activity: DataFrame, *steps, size: int = RANGE, halo: int = HALO) -> DataFrame:
    rows = in_ranges(activity, size, halo)
    for step in steps:
        rows = step(rows)
    kept = [c for c in activity.columns if c != "label"]
    return rows.where("_own").select(*kept, "label")


def cole_kripke(activity: DataFrame) -> DataFrame:
    """activity with label: wake where the weighted sum of four epochs before, the epoch and three after reaches 1; outside counts as 0."""
    return _labelled(activity, _cole_kripke)


def sadeh(activity: DataFrame) -> DataFrame:
    """activity with label: wake where the index of mean, moderate epochs, spread and the epoch's logarithm is negative.

    The eleven-epoch window is padded with zeros and always counts eleven.
    """
    return _labelled(activity, _sadeh)


def webster_rules(labels: DataFrame) -> DataFrame:
    """labels with short sleep runs between long wake runs rescored as wake.

    Runs are those of the labels as they come; a run at an edge has no
    neighbour there and stays.
    """
    return _labelled(labels, _webster).select(labels.columns)


def score_sleep(activity: DataFrame, scorer: str = "cole_kripke", size: int = RANGE) -> DataFrame:
    """activity with label (0 sleep, 1 wake); the rescoring rules follow the Cole-Kripke scorer.

    Every row is scored, in ranges of ``size`` rows that see their neighbours.
    A null or negative activity counts as 0.
    """
    one_of("scorer", scorer, SCORERS)
    return _labelled(activity, *((_cole_kripke, _webster) if scorer == "cole_kripke" else (_sadeh,)), size=size)


def rest_onsets(full: DataFrame, hours: int = 5, bin_minutes: int = 60) -> DataFrame:
    """(pid, day, onset_min): start of each whole day's least active hours, circular within the day."""
    width = window_bins(hours, bin_minutes, limited=False)
    rounded = full.withColumn("x", F.round("x", 6))
    found = circular_window(rounded, width, "min", bins_per_day(bin_minutes), ("pid", "day"))
    return found.select("pid", "day", (F.col("pos") * bin_minutes).cast("int").alias("onset_min"))


def _minutes(n) -> object:
    return F.make_dt_interval(mins=n)


def rest_windows(onsets: DataFrame, hours: int = 5, pad_before: int = 30, pad_after: int = 60) -> DataFrame:
    """(pid, day, starts, ends) of the nights around the onsets."""
    midnight = F.col("day").cast("timestamp_ntz")
    return onsets.select("pid", "day", (midnight + _minutes(F.col("onset_min") - pad_before)).alias("starts"), (midnight + _minutes(F.col("onset_min") + hours * 60 + pad_after)).alias("ends"))


def epochs_of_nights(labels: DataFrame, windows: DataFrame) -> DataFrame:
    """(pid, day, ts, label) of every epoch in a night, both ends included; nights may overlap and cross midnight.

    A range join: each window is exploded to the calendar days it touches (two
    at most), so the join is an equality on (pid, day) with a range beside it.
    """
    touched = windows.withColumn("_on", F.explode(F.sequence(F.to_date("starts"), F.to_date("ends"))))
    rows = labels.select(F.col("pid").alias("_pid"), "ts", "label", F.to_date("ts").alias("_day"))
    joined = touched.join(rows, (F.col("pid") == F.col("_pid")) & (F.col("_on") == F.col("_day")) & F.col("ts").between(F.col("starts"), F.col("ends")))
    return joined.select("pid", "day", "ts", "label")


def night_metrics(epochs: DataFrame, min_epochs: int = 30) -> DataFrame:
    """(pid, day, tst, waso, efficiency, sol) of each night with enough epochs, in epochs and as a share.

    Sleep is counted between the first and the last sleep epoch. A night
    without sleep has sol equal to its length.
    """
    place = F.row_number().over(Window.partitionBy("pid", "day").orderBy("ts")) - 1
    asleep = F.col("label") == SLEEP
    rows = epochs.withColumn("_k", place)
    nights = rows.groupBy("pid", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(asleep).alias("tst"), F.min(F.when(asleep, F.col("_k"))).alias("first"), F.max(F.when(asleep, F.col("_k"))).alias("last"))
    return nights.where(F.col("n") >= min_epochs).select(
        "pid",
        "day",
        "tst",
        F.coalesce(F.col("last") - F.col("first") + 1 - F.col("tst"), F.lit(0)).cast("long").alias("waso"),
        (F.col("tst") / F.col("n")).alias("efficiency"),
        F.coalesce(F.col("first").cast("long"), F.col("n")).alias("sol"),
    )


def sleep_metrics(activity: DataFrame, bin_minutes: int = 60, min_days: int = 3, scorer: str = "cole_kripke", l5_hours: int = 5, pad_before: int = 30, pad_after: int = 60, full: DataFrame | None = None) -> DataFrame:
    """(pid, tst_hours, tst_24h_hours, waso_min, sleep_efficiency, sol_min): means over the nights of the whole days.

    tst_24h counts all sleep epochs of the recording, those of partial days
    too, per whole day. Rows with null activity are left out first. A pid with
    fewer than min_days whole days, or without a valid night, has nulls.
    full: the bins of whole days, where they are there already.
    """
    rows = usable(activity)
    full = keep_full_days(bin_activity(rows, bin_minutes), bin_minutes) if full is None else full
    days = full.groupBy("pid").agg((F.count(F.lit(1)) / bins_per_day(bin_minutes)).alias("n_days"))
    labels = score_sleep(rows, scorer).select("pid", "ts", "label")
    nights = night_metrics(epochs_of_nights(labels, rest_windows(rest_onsets(full, l5_hours, bin_minutes), l5_hours, pad_before, pad_after)))
    asleep = labels.groupBy("pid").agg(F.count_if(F.col("label") == SLEEP).alias("asleep"))
    return sleep_means(asleep, days, nights, min_days)


def usable(activity: DataFrame) -> DataFrame:
    """The rows with an activity."""
    return activity.where(F.col("activity").isNotNull() & ~F.isnan(F.col("activity").cast("double")))


def sleep_means(asleep: DataFrame, days: DataFrame, nights: DataFrame, min_days: int = 3) -> DataFrame:
    """sleep_metrics of (pid, asleep), (pid, n_days) and night_metrics."""
    means = nights.groupBy("pid").agg(*[F.avg(c).alias(c) for c in ("tst", "waso", "efficiency", "sol")])
    joined = asleep.join(days, "pid", "left").join(means, "pid", "left")
    enough = (F.col("n_days") >= min_days) & F.col("tst").isNotNull()
    value = {"tst_hours": F.col("tst") / 60, "tst_24h_hours": F.col("asleep") / F.col("n_days") / 60, "waso_min": F.col("waso"), "sleep_efficiency": F.col("efficiency"), "sol_min": F.col("sol")}
    return joined.select("pid", *[F.when(enough, c).alias(n) for n, c in value.items()])
