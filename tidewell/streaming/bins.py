"""Binning and whole days as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.expressions import clean
from tidewell.functions.params import bins_per_day


def stream_bins(activity: DataFrame, bin_minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """(pid, day, pos, x) as bins close: a tumbling window that ends once the watermark is past it.

    Windows are aligned to midnight, as the bin width divides the day. Later
    rows than ``late`` are dropped by the watermark. ts may be without time
    zone; a watermark needs one, and the session's is used.
    """
    bins_per_day(bin_minutes)
    rows = activity.select("pid", F.col("ts").cast("timestamp").alias("ts"), clean(F.col("activity").cast("double")).alias("x")).where("x is not null")
    sums = rows.withWatermark("ts", late).groupBy("pid", F.window("ts", f"{bin_minutes} minutes").alias("w")).agg(F.sum("x").alias("x"))
    start = F.col("w.start")
    return sums.select("pid", F.to_date(start).alias("day"), F.floor((F.hour(start) * 60 + F.minute(start)) / bin_minutes).cast("int").alias("pos"), "x")


def stream_full_days(activity: DataFrame, bin_minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """(pid, day, bins): a day's bins, sorted, once the day is over and if all are there.

    One state row per (pid, day) holds at most a day's minutes.
    """
    p = bins_per_day(bin_minutes)
    rows = activity.select("pid", F.col("ts").cast("timestamp").alias("ts"), clean(F.col("activity").cast("double")).alias("x")).where("x is not null")
    days = rows.withWatermark("ts", late).groupBy("pid", F.window("ts", "1 day").alias("w")).agg(F.collect_list(F.struct(F.floor((F.hour("ts") * 60 + F.minute("ts")) / bin_minutes).cast("int").alias("pos"), "x")).alias("rows"))
    positions = F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["pos"])))
    bins = F.transform(positions, lambda k: F.struct(k.alias("pos"), F.aggregate(F.filter("rows", lambda r: r["pos"] == k), F.lit(0.0), lambda a, r: a + r["x"]).alias("x")))
    return days.where(F.size(positions) == p).select("pid", F.to_date("w.start").alias("day"), bins.alias("bins"))
