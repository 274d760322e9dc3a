"""Levels and learned adjustments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def to_db(amplitude: Column, floor: float = -120.0) -> Column:
    """Decibels of a linear amplitude; silence gives the floor."""
    return F.when(amplitude > 0, F.greatest(20.0 * F.log10(amplitude), F.lit(floor))).otherwise(F.lit(floor))


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.least(c, as_column(high)), as_column(low))


def within(value: Column, target: float, tolerance: float) -> Column:
    """|value - target| <= tolerance; a missing value is not within."""
    return F.coalesce(F.abs(value - target) <= tolerance + 1e-9, F.lit(False))


def at_most(value: Column, limit: float) -> Column:
    return F.coalesce(value <= limit + 1e-9, F.lit(False))


def speed_factor(expected: Column, corrected: Column) -> Column:
    return F.when(expected > 0, corrected / expected).otherwise(F.lit(1.0))


def adjusted_time(time: Column, speed: Column, mean_offset: Column, last_offset: Column, most: float = 5.0) -> Column:
    """A predicted time corrected by what was learned: damped by half, or by the key's own last offset where there is one.

    Never below 0; a change of `most` seconds or more is not taken over, and missing averages change nothing.
    """
    mean = F.coalesce(mean_offset, F.lit(0.0))
    general = time * F.coalesce(speed, F.lit(1.0)) + 0.5 * mean
    own = time + 0.7 * last_offset + 0.3 * mean
    new = F.greatest(F.when(last_offset.isNotNull(), own).otherwise(general), F.lit(0.0))
    return F.when(F.abs(new - time) < most, new).otherwise(time)
