"""Activity tables from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_activity(events: DataFrame, entity: str = "event_type") -> DataFrame:
    """(pid, label, ts, activity): one row per event, value as activity."""
    return events.select(F.col(entity).cast("string").alias("pid"), F.lit("control").alias("label"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("activity"))


def dense_activity(events: DataFrame, entity: str = "event_type", gain: float = 1.0) -> DataFrame:
    """One row per minute from an entity's first to its last event: the sum of that minute's values times gain, else 0.

    This is what a device that logs zeros yields. Sums are rounded to cents, so
    that thresholds on them don't depend on the order of addition.
    """
    minutes = events.groupBy(F.col(entity).cast("string").alias("pid"), F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("value") * gain, 2).alias("activity"))
    spans = minutes.groupBy("pid").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    # by day first: no single row grows into the whole recording
    days = spans.select("pid", "first", "last", F.explode(F.sequence(F.to_date("first"), F.to_date("last"))).alias("day"))
    grid = days.select("pid", "first", "last", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("m"), "day")
    grid = grid.withColumn("ts", F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("m"))).where("ts between first and last").select("pid", "ts")
    return grid.join(minutes, ["pid", "ts"], "left").select("pid", F.lit("control").alias("label"), "ts", F.coalesce("activity", F.lit(0.0)).alias("activity"))


def daily_features(events: DataFrame) -> DataFrame:
    """(user, day, mean, sd, pctZeros, median, q25, q75, class) per user and day, in the three cohorts with features."""
    cohort = cohort_of(F.col("user_id"))
    rows = events.withColumn("class", cohort).where(F.col("class").isin("control", "depression", "schizophrenia"))
    v = F.col("value")
    return rows.groupBy(F.col("user_id").alias("user"), F.to_date("ts").alias("day"), "class").agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.avg(F.when(v < 1, 1.0).otherwise(0.0)).alias("pctZeros"),
        F.percentile(v, 0.5).alias("median"),
        F.percentile(v, 0.25).alias("q25"),
        F.percentile(v, 0.75).alias("q75"),
    )


def cohort_of(user):
    """Cohort name of a user id."""
    names = F.array(*[F.lit(c) for c in ("control", "depression", "schizophrenia", "adhd", "clinical")])
    return F.get(names, (user % 5).cast("int"))


def cohort_metadata(events: DataFrame) -> DataFrame:
    """(number, days, gender, age, cohort) per user."""
    users = events.groupBy(F.col("user_id").alias("number")).agg(F.countDistinct(F.to_date("ts")).alias("days"))
    return users.select("number", "days", (F.col("number") % 2 + 1).alias("gender"), (F.col("number") % 50 + 20).alias("age"), cohort_of(F.col("number")).alias("cohort"))
