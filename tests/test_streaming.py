import pytest
from pyspark.sql import functions as F

from lectern.operators import state
from lectern.streaming import learned


def _stream(spark, folder, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for i, part in enumerate(df.randomSplit([1.0], 1)):
        part.coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(folder)), df


def _last(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def test_moving_mean_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", float(i % 7), i) for i in range(60)] + [("k0", None, 99)]
    stream, df = _stream(spark, tmp_path / "in", rows, "k string, x double, o long")
    got = {r.key: r["mean"] for r in _last(spark, learned.exponential_mean(stream, key="k", value="x", order="o"), "ema", "update").collect()}
    want = {r.k: r["mean"] for r in state.exponential_mean(df, keys=["k"], value="x", order="o").collect()}
    assert got == pytest.approx(want)


def test_profiles_equal_batch(spark, tmp_path):
    rows = [(f"k{i % 2}", float(i), float(i) * 1.1) for i in range(20)]
    stream, df = _stream(spark, tmp_path / "in", rows, "k string, e double, c double")
    got = {r.k: r.mean_offset for r in _last(spark, learned.running_profiles(stream, keys=["k"], expected="e", corrected="c"), "prof", "complete").collect()}
    assert got == pytest.approx({r.k: r.mean_offset for r in state.profiles(df, keys=["k"], expected="e", corrected="c").collect()})


def test_closed_quiet_sessions(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", v) for s, v in ((0, 1.0), (5, 2.0), (30, 50.0))] + [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-02 00:00:00", 1.0)]
    stream, _ = _stream(spark, tmp_path / "in", rows, "k string, t string, v double")
    out = _last(spark, learned.quiet_sessions(stream.withColumn("t", F.to_timestamp("t")), key="k", time="t", value="v", threshold=10.0, gap="20 seconds"), "quiet", "append")
    assert sorted(r.n for r in out.collect())[-1:] == [2]
