"""Filters, joins and roll-ups that prepare participants for modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.summaries import exact_percentiles

DISTRIBUTIONAL = ("mean", "sd", "pctZeros", "median", "q75")
FEATURE_COHORTS = ("control", "depression", "schizophrenia")


def min_days_filter(metadata: DataFrame, min_days: int) -> DataFrame:
    """Participants recorded on at least min_days days; a null count goes."""
    return metadata.where(F.col("days") >= min_days)


def exclude_features(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """features without the named columns; absent ones are ignored."""
    return features.drop(*names)


def valid_users(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Feature rows of users in the cohorts with features; ids are compared as text."""
    known = metadata.where(F.col("cohort").isin(*FEATURE_COHORTS)).select(F.col("number").cast("string").alias("_id")).distinct()
    return features.join(known, F.col("user").cast("string") == F.col("_id"), "left_semi")


def preprocess(metadata: DataFrame, features: DataFrame, min_days: int = 7, exclude: tuple[str, ...] = ("q25",)) -> tuple[DataFrame, DataFrame]:
    """Metadata and features after the day filter and the exclusion."""
    kept = min_days_filter(metadata, min_days)
    return kept, exclude_features(valid_users(features, kept), exclude)


def to_participant_level(features: DataFrame, columns: tuple[str, ...] = DISTRIBUTIONAL) -> DataFrame:
    """(user, means of the columns there are, class): the class is the most frequent, the smallest of equals."""
    have = [c for c in columns if c in features.columns]
    return features.groupBy("user").agg(*[F.avg(c).alias(c) for c in have], F.mode("class", True).alias("class"))


def join_features(distributional: DataFrame, temporal: DataFrame) -> DataFrame:
    """Inner join on user; the class of the left side counts."""
    return distributional.join(temporal.drop("class"), "user")


def lost_rows(distributional: DataFrame, temporal: DataFrame) -> DataFrame:
    """Users of the left side that join_features loses."""
    return distributional.join(temporal, "user", "left_anti").select("user")


def label_codes(labels: DataFrame, column: str) -> DataFrame:
    """labels with code, the rank of the label among the sorted labels, from 0.

    The distinct labels are ranked, not the rows; nulls get no code.
    """
    from pyspark.sql import Window

    codes = labels.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)
    return labels.join(codes, column, "left").select(*labels.columns, "code")


def reliable(frame: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose cosinor fit explains enough; null goes."""
    return frame.where(F.col("cosinor_r_squared") >= least)


def setting_column(columns: list[str]) -> str | None:
    """First column whose name tells the care setting."""
    return next((c for c in columns if "hosp" in c.lower() or "inpatient" in c.lower()), None)


def with_setting(frame: DataFrame, metadata: DataFrame, key: str = "user") -> DataFrame:
    """frame with the metadata's care-setting column as hosp; null where a participant has none."""
    column = setting_column(metadata.columns)
    if column is None:
        return frame.withColumn("hosp", F.lit(None).cast("string"))
    side = metadata.select(F.col("number").cast("string").alias("_id"), F.col(column).cast("string").alias("hosp"))
    return frame.join(side, F.col(key).cast("string") == F.col("_id"), "left").drop("_id")


def temporal_columns(columns: list[str], keys: tuple[str, ...] = ("user", "pid", "class", "label")) -> list[str]:
    """Columns that are neither keys nor distributional."""
    return [c for c in columns if c not in keys and c not in DISTRIBUTIONAL]


def distributional_columns(columns: list[str]) -> list[str]:
    return [c for c in DISTRIBUTIONAL if c in columns]


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of the columns replaced by the column's interpolated median (one row of medians, joined by broadcast)."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "value")
    found = exact_percentiles(long, "value", {"median": 0.5}, ("column",))
    medians = found.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_m_{c}") for c in columns])
    return df.join(F.broadcast(medians)).select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
