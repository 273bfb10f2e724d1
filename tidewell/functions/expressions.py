"""Column expressions for scalar steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def non_negative(x: Column) -> Column:
    """Null as 0, negative values as 0."""
    return F.greatest(F.coalesce(clean(x), F.lit(0.0)), F.lit(0.0))


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def bin_of(ts: Column, bin_minutes: int) -> Column:
    """Position within the day of the bin that holds a time."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / bin_minutes).cast("int")


def amplitude(low: Column, high: Column) -> Column:
    """Null where either is."""
    return high - low


def relative_amplitude(low: Column, high: Column) -> Column:
    """(high - low) / (high + low), null for a zero sum."""
    return (high - low) / F.nullif(high + low, F.lit(0.0))


def hours_of(minutes: Column) -> Column:
    """Minutes from midnight as hours."""
    return minutes / F.lit(60.0)


def binary_label(label: Column) -> Column:
    """control stays, everything else, null too, is patient."""
    return F.when(label == "control", "control").otherwise("patient")


def binary_code(label: Column) -> Column:
    """0 for control, 1 for any other label, null too."""
    return F.when(label == "control", 0).otherwise(1)
