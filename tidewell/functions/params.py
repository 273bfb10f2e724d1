"""Eager checks of parameters; they raise ValueError when a plan is built, not when it runs."""

from __future__ import annotations

MINUTES_PER_DAY = 1440


def bins_per_day(bin_minutes: int) -> int:
    """Number of bins a day has; the bin width must divide the day."""
    if isinstance(bin_minutes, bool) or not isinstance(bin_minutes, int) or bin_minutes < 1:
        raise ValueError(f"bin_minutes must be a positive integer, not {bin_minutes!r}")
    if MINUTES_PER_DAY % bin_minutes:
        raise ValueError(f"bin_minutes must divide {MINUTES_PER_DAY}, and {bin_minutes} doesn't")
    return MINUTES_PER_DAY // bin_minutes


def window_bins(hours: int, bin_minutes: int, limited: bool = True) -> int:
    """Number of bins in a window of whole hours; ``limited`` asks for 1 to 23 hours."""
    bins_per_day(bin_minutes)
    if limited and not 1 <= hours <= 23:
        raise ValueError(f"hours must be from 1 to 23, not {hours}")
    if hours * 60 % bin_minutes:
        raise ValueError(f"{hours} hours aren't a whole number of {bin_minutes}-minute bins")
    return hours * 60 // bin_minutes


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


class SchemaError(ValueError):
    """A table lacks columns or holds values outside its domain."""


def require_columns(columns: list[str], required, name: str) -> None:
    """Raise SchemaError if a required column is missing; reads no data."""
    if missing := sorted(set(required) - set(columns)):
        raise SchemaError(f"{name}: missing columns {missing}; present are {sorted(columns)}")
