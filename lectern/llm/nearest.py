"""Pairs each row of one table with the row nearest in time of the same entity in another, within a tolerance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest difference between predicted and true position that a segment of the learned index may have.
ERROR = 16


class LearnedIndex:
    """Piecewise-linear index over rows sorted by (group, time), each (group, time) once.

    A group's rows start as one segment, a line from its first to its last row. Segments whose largest error, the
    distance between the predicted and the true position of a row, exceeds `error` are halved until none does.
    """

    def __init__(self, group: np.ndarray, time: np.ndarray, error: int = ERROR):
        self.group, self.time, self.error = group, time, error
        n = len(group)
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        start, stop = edge, np.r_[edge[1:], n][: len(edge)]
        done_start, done_stop = [], []
        while len(start):
            length = stop - start
            wide = length > 2 * error
            done_start.append(start[~wide])
            done_stop.append(stop[~wide])
            start, stop, length = start[wide], stop[wide], length[wide]
            if not len(start):
                break
            at = np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            t0, slope = time[start], self._slope(start, stop)
            off = np.abs(np.repeat(start, length) + (time[at] - np.repeat(t0, length)) * np.repeat(slope, length) - at)
            worst = np.maximum.reduceat(off, np.r_[0, np.cumsum(length)[:-1]])
            fits = worst <= error
            done_start.append(start[fits])
            done_stop.append(stop[fits])
            start, stop = start[~fits], stop[~fits]
            half = (start + stop) // 2
            start, stop = np.r_[start, half], np.r_[half, stop]
        self.start = np.sort(np.concatenate(done_start)) if n else np.zeros(0, np.int64)
        self.stop = np.r_[self.start[1:], n][: len(self.start)]
        self.slope = self._slope(self.start, self.stop)

    def _slope(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        span = self.time[stop - 1] - self.time[start]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (stop - 1 - start) / span
        return np.where(np.isfinite(slope), slope, 0.0)

    def _less(self, i: np.ndarray, group: np.ndarray, time: np.ndarray) -> np.ndarray:
        return (self.group[i] < group) | ((self.group[i] == group) & (self.time[i] < time))

    def _search(self, low: np.ndarray, high: np.ndarray, less) -> np.ndarray:
        """Number of leading positions of each [low, high) for which less holds."""
        low, high = low.copy(), high.copy()
        while (active := low < high).any():
            middle = (low + high) // 2
            is_less = np.zeros(len(low), bool)
            is_less[active] = less(middle[active], active)
            low = np.where(active & is_less, middle + 1, low)
            high = np.where(active & ~is_less, middle, high)
        return low

    def position(self, group: np.ndarray, time: np.ndarray) -> np.ndarray:
        """The first row not less than (group, time): predicted by the segment, then found exactly within its error."""
        n, m = len(self.group), len(group)
        if not n:
            return np.zeros(m, np.int64)
        first = np.zeros(m, np.int64)
        segment = self._search(first, np.full(m, len(self.start)), lambda i, a: self._less(self.start[i], group[a], time[a])) - 1
        at = np.maximum(segment, 0)
        start, stop = self.start[at], self.stop[at]
        guess = start + (time - self.time[start]) * self.slope[at]
        guess = np.where(self.group[start] == group, np.clip(guess, start, stop), stop).astype(np.int64)
        low, high = np.clip(guess - self.error - 1, start, stop), np.clip(guess + self.error + 2, start, stop)
        found = self._search(low, high, lambda i, a: self._less(i, group[a], time[a]))
        # the error bound holds for rows; should rounding put a probe outside the window, its whole segment is searched
        ok = ((found == start) | self._less(np.maximum(found - 1, 0), group, time)) & ((found == stop) | ~self._less(np.minimum(found, n - 1), group, time))
        if not ok.all():
            g, t = group[~ok], time[~ok]
            found[~ok] = self._search(start[~ok], stop[~ok], lambda i, a: self._less(i, g[a], t[a]))
        return np.where(segment < 0, 0, found)


def nearest(index: LearnedIndex, ids: np.ndarray, probe_group: np.ndarray, probe_time: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each probe the id of the nearest row of its group, and whether there is one within the tolerance.

    The index holds rows sorted by (group, time). Of equally near rows the lowest id is taken. Beside the two neighbours of the
    probe the next ones are compared too, since two different times can lie equally far away after rounding.
    """
    group, time = index.group, index.time
    where = index.position(probe_group, probe_time)
    best, best_id = np.full(len(where), np.inf), np.full(len(where), np.iinfo(np.int64).max)
    for step in (-2, -1, 0, 1):
        at = where + step
        valid = (at >= 0) & (at < len(group))
        at = np.where(valid, at, 0)
        if len(group):
            valid &= group[at] == probe_group
            gap = np.where(valid, np.abs(probe_time - time[at]), np.inf)
            better = (gap < best) | ((gap == best) & valid & (ids[at] < best_id))
            best, best_id = np.where(better, gap, best), np.where(better, ids[at], best_id)
    return best_id, best <= tolerance


def match_nearest(
    left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_entity: list[Column], right_entity: list[Column],
    left_time: Column, right_time: Column, tolerance: float, shard_seconds: float = 256.0, hot_rows: int = 1_000_000,
) -> DataFrame:
    """(left_id, right_id): each left row with the right row of the same entity whose time lies nearest, if one does.

    The difference is at most `tolerance` seconds; of equally near rows the lowest right id is taken. Rows whose time or
    any entity column is null, or whose time is not finite, take no part. A right row may serve many left rows and
    repeated left rows count each. Other columns, also of the same names, don't matter. Empty tables give no rows.

    Both sides are cut into shards of one entity and `shard_seconds` of time; right rows within the tolerance of a
    shard's edge go to both shards, so a shard answers its left rows alone and a long recording is spread over many
    tasks. Right rows of the same entity and time are reduced to the lowest id before the shuffle. A shard with more than
    `hot_rows` left rows (there are at most rows / hot_rows of those, so they can be broadcast) is divided into slices,
    each of which gets the shard's right rows. In a task rows arrive sorted by shard, right rows first, so only the
    right rows of one shard and one batch are in memory at a time, and a shard that goes on over several batches keeps its
    index. Entities are compared by 128 bits of hash.
    """
    wide = float(max(shard_seconds, 2 * tolerance))

    def side(df: DataFrame, key: str, entity: list[Column], time: Column) -> DataFrame:
        rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), time.cast("double").alias("t"), *[e.alias(f"e{i}") for i, e in enumerate(entity)])
        names = [f"e{i}" for i in range(len(entity))]
        usable = F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")) & F.col("id").isNotNull()
        for name in names:
            usable = usable & F.col(name).isNotNull()
        return rows.where(usable).select("id", "t", F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit("second"), *names).alias("h2"))

    shard = lambda t: F.floor(t / wide).cast("long")
    lefts = side(left, left_id, left_entity, left_time).withColumn("shard", shard(F.col("t")))
    rights = side(right, right_id, right_entity, right_time).groupBy("h1", "h2", "t").agg(F.min("id").alias("id"))
    low, high = shard(F.col("t") - tolerance), shard(F.col("t") + tolerance)
    rights = rights.withColumn("shard", F.explode(F.sequence(low, high)))
    key = ["h1", "h2", "shard"]
    hot = lefts.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = F.broadcast(hot.select(*key, F.ceil(F.col("n") / hot_rows).cast("int").alias("slices")))
    lefts = lefts.join(hot, key, "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("id"), "slices"), F.lit(0)).cast("int"))
    rights = rights.join(hot, key, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    columns = [*key, "slice", "kind", "t", "id"]
    both = rights.withColumn("kind", F.lit(0)).select(columns).unionByName(lefts.withColumn("kind", F.lit(1)).select(columns))
    both = both.repartition(*key, "slice").sortWithinPartitions(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        open_key: tuple | None = None  # the shard that may go on, its right rows, and their index once it is needed
        open_time, open_ids, index = np.zeros(0), none, None

        def answer(idx: LearnedIndex, right_ids: np.ndarray, group: np.ndarray, time: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            found, near = nearest(idx, right_ids, group, time, tolerance)
            return pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(found[near])], [left_id, right_id])

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, part, piece, kind, time, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            change = np.r_[False, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (part[1:] != part[:-1]) | (piece[1:] != piece[:-1])]
            group, is_right = np.cumsum(change), kind == 0
            head = 0
            if open_key == (h1[0], h2[0], part[0], piece[0]):  # the first rows go on with the open shard
                head = int(np.searchsorted(group, 0, "right"))
                more = is_right[:head]
                if more.any():
                    open_time, open_ids, index = np.r_[open_time, time[:head][more]], np.r_[open_ids, ids[:head][more]], None
                if not more.all():
                    index = index or LearnedIndex(np.zeros(len(open_time), np.int64), open_time)
                    yield answer(index, open_ids, group[:head][~more], time[:head][~more], ids[:head][~more])
            if head == len(group):
                continue
            group, is_right, time, ids = group[head:], is_right[head:], time[head:], ids[head:]
            a, b = np.flatnonzero(is_right), np.flatnonzero(~is_right)
            if len(b):
                yield answer(LearnedIndex(group[a], time[a]), ids[a], group[b], time[b], ids[b])
            last = a[group[a] == group[-1]]
            open_key, open_time, open_ids, index = (h1[-1], h2[-1], part[-1], piece[-1]), time[last], ids[last], None

    return both.mapInArrow(run, f"`{left_id}` long, `{right_id}` long")
