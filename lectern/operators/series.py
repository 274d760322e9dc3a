"""Time series of peaks: envelopes, silent runs, pauses, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket_peaks(samples: DataFrame, *, keys: list[str], position: str, value: str, width: int) -> DataFrame:
    """The largest magnitude in each bucket of `width` positions."""
    bucket = F.floor(F.col(position) / width).cast("bigint")
    return samples.groupBy(*keys, bucket.alias("bucket")).agg(F.max(F.abs(F.col(value))).alias("peak"), F.count("*").alias("samples"))


def envelope(samples: DataFrame, *, keys: list[str], position: str, value: str, total: str, columns: int = 1400) -> DataFrame:
    """Minimum and maximum in at most `columns` equal buckets; what lies beyond the last full column is left out.

    `total` is the column with the number of positions of the group, known from the header, so no second pass is needed.
    """
    width = F.greatest(F.lit(1), F.floor(F.col(total) / columns))
    bucket = F.floor(F.col(position) / width).cast("bigint")
    return samples.withColumn("bucket", bucket).where(F.col("bucket") < columns).groupBy(*keys, "bucket").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def edge_run(buckets: DataFrame, *, keys: list[str], order: list[str], peak: str, threshold: float, width: str, most: float | None = None, from_end: bool = False) -> DataFrame:
    """Seconds of silence before the first loud bucket in order, or with `from_end` behind the last one, capped at `most`.

    Two aggregates with partial results, no window: where a group has its first loud bucket, and what lies before it.
    """
    place = F.struct(*[F.col(c) for c in order])
    edge = F.max if from_end else F.min
    first = buckets.groupBy(*keys).agg(edge(F.when(F.col(peak) > threshold, place)).alias("__loud"))
    outside = F.col("__loud").isNull() | ((place > F.col("__loud")) if from_end else (place < F.col("__loud")))
    rows = _with(buckets.select(*keys, *dict.fromkeys([*order, width])), first, keys)
    out = rows.groupBy(*keys).agg(F.sum(F.when(outside, F.col(width)).otherwise(F.lit(0.0))).alias("silence_s"))
    return out if most is None else out.withColumn("silence_s", F.least("silence_s", F.lit(float(most))))


def sharded(rows: DataFrame, *, keys: list[str], position: Column, hot_rows: int | None) -> tuple[DataFrame, bool]:
    """rows with __shard, and whether any group is cut: 0, or for groups of more than `hot_rows` rows the stretch of
    positions, of about that many rows, in which a row lies.

    There are at most rows / hot_rows such groups, so what is broadcast is small. Whether there are any is looked up at
    once, with an aggregate over the keys alone, so that tables without hot groups get the plain plan. None cuts none.
    """
    whole = rows.withColumn("__shard", F.lit(0).cast("bigint"))
    if hot_rows is None:
        return whole, False
    stats = rows.select(*keys, position.cast("double").alias("__at")).groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
    hot = stats.where((F.col("__n") > hot_rows) & (F.col("__hi") > F.col("__lo")))
    if hot.isEmpty():
        return whole, False
    hot = hot.select(*keys, "__lo", ((F.col("__hi") - F.col("__lo")) / F.ceil(F.col("__n") / hot_rows)).alias("__w"))
    shard = F.coalesce(F.floor((position.cast("double") - F.col("__lo")) / F.col("__w")), F.lit(0)).cast("bigint")
    return rows.join(F.broadcast(hot), keys, "left").withColumn("__shard", shard).drop("__lo", "__w"), True


def islands(rows: DataFrame, *, keys: list[str], order: list[Column], inside: Column, start: str, end: str, hot_rows: int | None = None) -> DataFrame:
    """Maximal runs of consecutive rows for which `inside` holds: first start, last end, and the number of rows.

    With `hot_rows`, larger groups are cut into stretches by their first order column; the count of breaks goes on from one
    stretch to the next, so runs over a cut stay whole.
    """
    cut, split = sharded(rows, keys=keys, position=order[0], hot_rows=hot_rows)
    w = Window.partitionBy(*keys, "__shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.withColumn("__in", F.coalesce(inside, F.lit(False))).withColumn("__island", F.sum(F.when(F.col("__in"), 0).otherwise(1)).over(w))
    if split:
        before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
        sums = marked.groupBy(*keys, "__shard").agg(F.max("__island").alias("__b")).withColumn("__b", F.coalesce(F.sum("__b").over(before), F.lit(0)))
        marked = _with(marked, sums, [*keys, "__shard"]).withColumn("__island", F.col("__island") + F.col("__b"))
    return marked.where("__in").groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def _with(rows: DataFrame, sums: DataFrame, on: list[str]) -> DataFrame:
    """rows with what was summed up for their group; null keys are groups as well."""
    other = sums.select(*[F.col(c).alias(f"__r_{i}") for i, c in enumerate(on)], *[c for c in sums.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"__r_{i}")) for i, c in enumerate(on)]
    return rows.join(other, same).drop(*[f"__r_{i}" for i in range(len(on))])


def pauses(buckets: DataFrame, *, keys: list[str], start: str, width: str, peak: str, threshold: float = 0.01, least: float = 0.3) -> DataFrame:
    """Silent stretches of at least `least` seconds, one at the end included."""
    rows = buckets.withColumn("__end", F.col(start) + F.col(width))
    out = islands(rows, keys=keys, order=[F.col(start)], inside=F.col(peak) <= threshold, start=start, end="__end")
    return out.withColumn("duration", F.col("end") - F.col("start")).where(F.col("duration") >= least - 1e-9)


def longest(rows: DataFrame, *, keys: list[str], duration: str, start: str, k: Column | int) -> DataFrame:
    """The k longest of each group, earlier ones first among equals, numbered in order of time from 1."""
    by_size = Window.partitionBy(*keys).orderBy(F.col(duration).desc(), F.col(start))
    by_time = Window.partitionBy(*keys).orderBy(F.col(start))
    return rows.withColumn("__rank", F.row_number().over(by_size)).where(F.col("__rank") <= k).drop("__rank").withColumn("number", F.row_number().over(by_time))


def segments(marks: DataFrame, *, keys: list[str], start: str, tie: str, end_of_group: Column) -> DataFrame:
    """Each mark with the time at which the next one of its group begins, the group's end for the last."""
    w = Window.partitionBy(*keys).orderBy(F.col(start), F.col(tie))
    return marks.withColumn("segment_end", F.coalesce(F.lead(start).over(w), end_of_group))


def points_in_segments(points: DataFrame, parts: DataFrame, *, keys: list[str], at: str, start: str, end: str, bucket_s: float = 60.0) -> DataFrame:
    """Points joined with every segment of their group that holds them, both ends included.

    An interval join: segments are listed under each stretch of `bucket_s` they touch, so that it runs as an equi-join on
    the group and the stretch, which also divides a group that holds a large part of the rows.
    """
    cell = lambda c: F.floor(F.col(c) / bucket_s).cast("bigint")
    listed = parts.where(F.col(start) <= F.col(end)).withColumn("__cell", F.explode(F.sequence(cell(start), cell(end))))
    inside = points.withColumn("__cell", cell(at)).join(listed, [*keys, "__cell"])
    return inside.where(F.col(at).between(F.col(start), F.col(end))).drop("__cell")


def push_apart(rows: DataFrame, *, keys: list[str], position: str, tie: str, gap: int, hot_rows: int | None = None) -> DataFrame:
    """Positions moved forward as little as needed to lie `gap` apart: the running maximum of position - i gap, plus i gap.

    With `hot_rows`, larger groups are cut into stretches; the count and the maximum go on from one to the next.
    """
    cut, split = sharded(rows, keys=keys, position=F.col(position), hot_rows=hot_rows)
    w = Window.partitionBy(*keys, "__shard").orderBy(F.col(position), F.col(tie))
    numbered = cut.withColumn("__i", F.row_number().over(w) - 1)
    numbered = numbered.withColumn("__reach", F.max(F.col(position) - F.col("__i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if split:
        before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
        sums = numbered.groupBy(*keys, "__shard").agg(F.count("*").alias("__c"), F.max("__reach").alias("__m"))
        sums = sums.withColumn("__c", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        sums = sums.withColumn("__m", F.max(F.col("__m") - F.col("__c") * gap).over(before))
        numbered = _with(numbered, sums, [*keys, "__shard"])
        numbered = numbered.withColumns({"__reach": F.greatest(F.col("__reach") - F.col("__c") * gap, F.col("__m")), "__i": F.col("__i") + F.col("__c")}).drop("__c", "__m")
    return numbered.withColumn("placed", F.col("__reach") + F.col("__i") * gap).drop("__i", "__reach", "__shard")


def thin(rows: DataFrame, *, keys: list[str], position: str, gap: float, always: Column | None = None) -> DataFrame:
    """The positions that are drawn: those at least `gap` behind the last one drawn, and those that always are.

    The choice depends on what was drawn before, so it is a fold over each group's positions in order; a group's
    positions come together in one row, which suits the few hundred marks of a recording.
    """
    must = F.lit(False) if always is None else F.coalesce(always, F.lit(False))
    lists = rows.where(F.col(position).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).cast("double").alias("p"), must.alias("m")))).alias("a"))
    kind = "array<double>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        draw = x.m | acc.last.isNull() | (x.p - acc.last >= gap)
        return F.when(draw, F.struct(F.concat(acc.out, F.array(x.p)).alias("out"), x.p.alias("last"))).otherwise(acc)

    return lists.select(*keys, F.aggregate("a", start, step, lambda acc: acc.out).alias("drawn"))


def visible(rows: DataFrame, *, position: str, start: float, end: float) -> DataFrame:
    """The rows of a part of a time line, its ends included; the bounds reach a Parquet scan as filters."""
    return rows.where(F.col(position).between(start, end))


def ticks(start: Column, end: Column, interval: Column) -> Column:
    """The multiples of an interval from start to end, as an array."""
    first, last = F.ceil(start / interval).cast("bigint"), F.floor(end / interval).cast("bigint")
    none = F.array().cast("array<double>")
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: i * interval)).otherwise(none)


def first_loud(clip: Column, threshold: float) -> Column:
    """Position, from 0, of an array's first element beyond the threshold; its length if there is none."""
    at = F.array_position(F.transform(clip, lambda x: F.abs(x) > threshold), True)
    return F.when(at > 0, at - 1).otherwise(F.size(clip).cast("bigint"))


def fix_edges(clip: Column, threshold: float, pad: int) -> Column:
    """An array whose quiet edges are cut and replaced by `pad` zeros on each side; an all-quiet one is kept whole between."""
    head, tail = first_loud(clip, threshold), first_loud(F.reverse(clip), threshold)
    n = F.size(clip)
    body = F.when(head >= n, clip).otherwise(F.slice(clip, head + 1, F.greatest(n - head - tail, F.lit(0))))
    zeros = F.array_repeat(F.lit(0.0), pad)
    return F.concat(zeros, body.cast("array<double>"), zeros)


def without_offset(clip: Column, least: float = 1e-6) -> Column:
    """An array minus its mean, where that is not negligible."""
    mean = F.aggregate(clip, F.lit(0.0), lambda a, x: a + x) / F.size(clip)
    return F.when(F.abs(mean) > least, F.transform(clip, lambda x: x - mean)).otherwise(clip.cast("array<double>"))


def gained(clip: Column, gain: Column | float) -> Column:
    """An array times a factor, clipped to -1 and 1."""
    g = gain if isinstance(gain, Column) else F.lit(float(gain))
    return F.transform(clip, lambda x: F.greatest(F.least(x * g, F.lit(1.0)), F.lit(-1.0)))
