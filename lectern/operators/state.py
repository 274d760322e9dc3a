"""Learned corrections: an append-only log of corrections, and what follows from it for each language and reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import adjusted_time, speed_factor


def profile_key(language: Column, reader: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.nullif(language, F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(reader, F.lit("")), F.lit("default")))


def profiles(corrections: DataFrame, *, keys: list[str], expected: str, corrected: str) -> DataFrame:
    """Per key: corrections, mean offset, and mean speed factor over those with an expected time above 0 (1 if none)."""
    e, c = F.col(expected), F.col(corrected)
    return corrections.groupBy(*keys).agg(F.count("*").alias("corrections"), F.avg(c - e).alias("mean_offset"), F.coalesce(F.avg(F.when(e > 0, speed_factor(e, c))), F.lit(1.0)).alias("mean_speed"))


def latest(rows: DataFrame, *, keys: list[str], value: Column, order: str) -> DataFrame:
    """The value of the row with the highest order number of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.col(order)).alias("latest"))


def exponential_mean(rows: DataFrame, *, keys: list[str], value: str, order: str, alpha: float = 0.3, seed: float = 0.5) -> DataFrame:
    """Exponential moving mean in order: seed, then alpha x + (1 - alpha) m for each value.

    Depends on the order, so the values of a key come together; the streaming form keeps one number a key instead.
    """
    lists = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x")))).alias("a"))
    return lists.select(*keys, F.aggregate("a", F.lit(float(seed)), lambda m, x: (1 - alpha) * m + alpha * x.x).alias("mean"))


def adjust(times: DataFrame, corrections: DataFrame, *, keys: list[str], verse: str, time: str, expected: str, corrected: str, order: str) -> DataFrame:
    """times with adjusted: corrected by the profile of its key, and by the verse's own last correction if there is one."""
    known = profiles(corrections, keys=keys, expected=expected, corrected=corrected).select(*keys, "mean_offset", "mean_speed")
    last = latest(corrections, keys=[*keys, verse], value=F.col(corrected) - F.col(expected), order=order)
    out = times.join(known, keys, "left").join(last, [*keys, verse], "left")
    return out.withColumn("adjusted", adjusted_time(F.col(time), F.col("mean_speed"), F.col("mean_offset"), F.col("latest"))).drop("mean_offset", "mean_speed", "latest")


def cleared(corrections: DataFrame, key: Column | None = None) -> DataFrame:
    """The log without a key's rows, or empty."""
    return corrections.where("false") if key is None else corrections.where(~F.coalesce(key, F.lit(False)))
