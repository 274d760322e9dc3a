"""Times as text and in samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Seconds of 'M:SS.mmm', 'H:MM:SS.mmm' or a plain number; 0 for anything else, null included.

    A fraction is padded or cut to three digits. 'M:SS' without a fraction is no time and gives 0.
    """
    t = F.trim(text)
    shape = r"^(?:([0-9]+):)?([0-9]+):([0-9]{1,2})\.([0-9]+)$"
    part = lambda i: F.coalesce(F.regexp_extract(t, shape, i).try_cast("double"), F.lit(0.0))
    milli = F.substring(F.rpad(F.regexp_extract(t, shape, 4), 3, "0"), 1, 3).try_cast("double")
    clock = part(1) * 3600 + part(2) * 60 + part(3) + milli / 1000
    number = F.when(t.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), t.try_cast("double"))
    return F.coalesce(F.when(t.rlike(shape), clock), number, F.lit(0.0))


def format_time(seconds: Column) -> Column:
    """'M:SS.mmm' with minutes unbounded; rounded to the millisecond, so seconds never read 60."""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor((ms % 60000) / 1000), ms % 1000)


def format_centiseconds(seconds: Column) -> Column:
    """'M:SS.ss'."""
    cs = F.round(seconds * 100).cast("bigint")
    return F.format_string("%d:%02d.%02d", F.floor(cs / 6000), F.floor((cs % 6000) / 100), cs % 100)


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def samples_to_seconds(samples: Column, rate: Column) -> Column:
    return samples / F.when(rate > 0, rate)


def seconds_to_samples(seconds: Column, rate: Column) -> Column:
    """Whole samples, towards zero."""
    x = seconds * rate
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def tick_interval(span: Column, most: int = 10) -> Column:
    """The smallest usual interval that cuts a span of seconds into at most `most` ticks."""
    steps = [0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0]
    out = F.lit(steps[-1])
    for s in reversed(steps[:-1]):
        out = F.when(span / s <= most, F.lit(s)).otherwise(out)
    return out
