"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes checkpoint() usable: in the folder the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary folder is made if everything runs in one process of this machine (tests). On a cluster
    this is an error, because the executors couldn't read each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Repartitions a small scan that has fewer partitions than the cluster has cores.

    Python stages cost far more CPU a byte than a scan does, so a few compressed files would keep most cores idle.
    A scan that already has enough partitions is left as it is, without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want, *keys) if df.rdd.getNumPartitions() < want else df
