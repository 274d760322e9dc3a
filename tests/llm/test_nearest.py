import bisect

import numpy as np
from pyspark.sql import functions as F

from lectern.llm.nearest import LearnedIndex, match_nearest


def test_index_gives_exact_positions_within_its_error():
    rng = np.random.default_rng(3)
    for turn in range(60):
        n = int(rng.integers(0, 3000))
        group, time = np.sort(rng.integers(0, rng.integers(1, 40), n)), np.round(rng.exponential(1, n) ** 3 * rng.choice([1, 1000]), int(rng.integers(0, 4)))
        rows = sorted(set(zip(group.tolist(), time.tolist())))
        group, time = np.array([g for g, _ in rows], int), np.array([t for _, t in rows], float)
        index = LearnedIndex(group, time, 4)
        for a, b, slope in zip(index.start, index.stop, index.slope):
            assert b - a <= 8 or np.abs(a + (time[a:b] - time[a]) * slope - np.arange(a, b)).max() <= 4
        pg, pt = rng.integers(-1, 42, 300), np.round(rng.exponential(1, 300) ** 3 * 1000, int(rng.integers(0, 4)))
        assert index.position(pg, pt).tolist() == ([bisect.bisect_left(rows, (a, b)) for a, b in zip(pg.tolist(), pt.tolist())] if rows else [0] * 300)


def _match(left, right, **kw):
    options = dict(left_id="i", right_id="j", left_entity=[F.col("e")], right_entity=[F.col("e")], left_time=F.col("t"), right_time=F.col("t"), tolerance=0.5) | kw
    return sorted((r.i, r.j) for r in match_nearest(left, right, **options).collect())


def test_equals_brute_force_also_with_salted_shards_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    left = [(i, f"e{rng.integers(0, 4)}" if i % 3 else "hot", round(float(rng.normal(100, 40)), 2), i) for i in range(900)]
    right = [(j, f"e{rng.integers(0, 4)}" if j % 3 else "hot", round(float(rng.normal(100, 40)), 1), "x") for j in range(1200)]
    left += [(9001, None, 1.0, 0), (9002, "hot", None, 0), (9003, "hot", float("nan"), 0), (9004, "hot", 100.0, 0), (9005, "hot", 100.0, 0)]
    right += [(9101, None, 1.0, "x"), (9102, "hot", None, "x"), (9103, "hot", float("inf"), "x"), (5, "hot", 100.0, "x"), (4, "hot", 100.0, "x")]
    want = []
    for i, e, t, _ in left:
        near = [(abs(t - s), j) for j, f, s, _ in right if e is not None and e == f and t is not None and s is not None and abs(t - s) <= 0.5]
        if near:
            want.append((i, min(near)[1]))
    a, b = spark.createDataFrame(left, "i long, e string, t double, shard long"), spark.createDataFrame(right, "j long, e string, t double, shard string")
    assert _match(a, b) == sorted(want)
    assert _match(a, b, hot_rows=20, shard_seconds=16.0) == sorted(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # shards go on over many batches
    try:
        assert _match(a, b) == sorted(want) == _match(a, b, shard_seconds=10_000.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "i long, j long, e string, t double")
    some = spark.createDataFrame([(1, 1, "a", 0.0)], "i long, j long, e string, t double")
    assert _match(none, none) == _match(none, some) == _match(some, none) == []
    assert _match(some, some) == [(1, 1)]


def test_edges_of_shards_and_ties(spark):
    a = spark.createDataFrame([(1, "a", 256.0), (2, "a", 255.6), (3, "a", -0.2)], "i long, e string, t double")
    b = spark.createDataFrame([(7, "a", 255.75), (8, "a", 256.25), (6, "a", 0.25)], "j long, e string, t double")
    assert _match(a, b) == [(1, 7), (2, 7), (3, 6)]


def test_any_finite_time(spark):
    a = spark.createDataFrame([(1, "a", 1e18), (2, "a", -1e300), (3, "a", float("inf")), (4, "a", 5.0)], "i long, e string, t double")
    b = spark.createDataFrame([(7, "a", 1e18), (8, "a", -1e300), (9, "a", float("-inf")), (6, "a", 5.25)], "j long, e string, t double")
    assert _match(a, b) == [(1, 7), (2, 8), (4, 6)]
