"""The frame of 17 rhythm and sleep features per participant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.expressions import amplitude, hours_of, relative_amplitude
from tidewell.operators.binning import bin_activity, keep_full_days
from tidewell.operators.rhythm import intradaily_variability, profile_measures
from tidewell.operators.sleep import sleep_metrics
from tidewell.sources.shared import written

FEATURES = (
    "interdaily_stability", "intradaily_variability", "l5_value", "l5_onset_hours", "m10_value", "m10_onset_hours", "amplitude", "relative_amplitude",
    "mesor", "cosinor_amplitude", "acrophase_hours", "cosinor_r_squared", "tst_hours", "tst_24h_hours", "waso_min", "sleep_efficiency", "sol_min",
)


def extract_features(activity: DataFrame, bin_minutes: int = 60, l_hours: int = 5, m_hours: int = 10, is_days: int = 7, sleep_days: int = 3) -> DataFrame:
    """(pid, label, 17 features), one row for every pid; what can't be computed is null.

    Activity is binned once; stability, active periods and cosinor come from
    one aggregate of the whole days' bins, variability from another, and the
    nights from the same bins. The recordings are written to the shared folder
    once, as roster, bins and positions are counted before nights are scored.
    """
    activity = written(activity.select("pid", "ts", "activity", *(["label"] if "label" in activity.columns else [])))
    full = keep_full_days(bin_activity(activity, bin_minutes), bin_minutes)
    label = F.min("label") if "label" in activity.columns else F.first(F.lit(None).cast("string"))
    roster = activity.groupBy("pid").agg(label.alias("label"))
    profile = profile_measures(full, bin_minutes, l_hours, m_hours, is_days)
    return frame_of(roster, profile, intradaily_variability(full, bin_minutes), sleep_metrics(activity, bin_minutes, sleep_days, l5_hours=l_hours, full=full))


def frame_of(roster: DataFrame, profile: DataFrame, variability: DataFrame, sleep: DataFrame) -> DataFrame:
    """(pid, label, 17 features) of the measures' tables."""
    frame = roster.join(profile, "pid", "left").join(variability, "pid", "left").join(sleep, "pid", "left")
    made = {
        "l5_value": F.col("l_value"),
        "l5_onset_hours": hours_of(F.col("l_onset_min")),
        "m10_value": F.col("m_value"),
        "m10_onset_hours": hours_of(F.col("m_onset_min")),
        "amplitude": amplitude(F.col("l_value"), F.col("m_value")),
        "relative_amplitude": relative_amplitude(F.col("l_value"), F.col("m_value")),
    }
    return frame.select("pid", "label", *[made.get(c, F.col(c)).alias(c) for c in FEATURES])
