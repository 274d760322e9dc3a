"""Learned state and pauses over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def exponential_mean(stream: DataFrame, *, key: str, value: str, order: str, alpha: float = 0.3, seed: float = 0.5) -> DataFrame:
    """(key, n, mean) after each micro-batch: the exponential moving mean, one number of state a key.

    Within a micro-batch values are taken by `order`; between batches in order of arrival. Null values are passed over.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("x"), F.col(order).cast("long").alias("o")).where("x IS NOT NULL")

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, seed)
        batch = pd.concat(list(pdfs)).sort_values(["o", "x"])
        for x in batch["x"]:
            n, mean = n + 1, (1 - alpha) * mean + alpha * x
        state.update((int(n), float(mean)))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "mean": [mean]})

    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, mean double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def running_profiles(stream: DataFrame, *, keys: list[str], expected: str, corrected: str) -> DataFrame:
    """The profiles of the batch operator, kept up to date; write in update or complete mode."""
    from ..operators.state import profiles

    return profiles(stream, keys=keys, expected=expected, corrected=corrected)


def quiet_sessions(stream: DataFrame, *, key: str, time: str, value: str, threshold: float, gap: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Stretches of quiet rows no further than `gap` apart, once the watermark has passed them."""
    rows = stream.withColumn("at", F.col(time).cast("timestamp")).where(F.col(value) <= threshold).withWatermark("at", late)
    return rows.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def arriving_files(spark, folder: str, pattern: str = "*.wav") -> DataFrame:
    """A stream of the recordings that appear in a folder, with their content."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
