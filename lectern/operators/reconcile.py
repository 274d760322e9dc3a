"""Reconciles markers embedded in recordings with those of a sidecar file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def compare_markers(embedded: DataFrame, sidecar: DataFrame, *, path: str, name: str, label: str, seconds: str, start: str, order: str, sidecar_order: str, tolerance: float = 0.5) -> DataFrame:
    """(path, name, status, row): each sidecar row as 'matched', 'time' (beyond the tolerance) or 'sidecar_only', and
    each embedded name that the sidecar lacks as 'embedded_only' (row null).

    Names are compared trimmed and without case; of several embedded markers of one name the last counts, while each
    sidecar row counts on its own. Null or blank names take no part; a null time on either side is not matched. The last
    of a name is found with a partial max, not by gathering the name's rows. Instead of a full outer join there is a left
    join, whose side of sidecar rows can be split where one name holds many of them, and an anti join of single rows by
    name. Other columns don't matter.
    """
    key = lambda c: F.lower(strip(F.col(c)))
    left = sidecar.select(F.col(path).alias("path"), key(name).alias("name"), F.col(start).alias("start"), F.col(sidecar_order).alias("row")).where("name <> '' AND path IS NOT NULL")
    right = embedded.select(F.col(path).alias("path"), key(label).alias("name"), F.col(seconds).alias("seconds"), F.col(order).alias("ord")).where("name <> '' AND path IS NOT NULL")
    right = right.groupBy("path", "name").agg(F.max_by("seconds", "ord").alias("seconds"), F.lit(True).alias("here"))
    near = F.coalesce(F.abs(F.col("start") - F.col("seconds")) <= tolerance, F.lit(False))
    listed = left.join(right, ["path", "name"], "left")
    listed = listed.select("path", "name", F.when(F.col("here").isNull(), "sidecar_only").when(near, "matched").otherwise("time").alias("status"), "row")
    alone = right.join(left.select("path", "name").distinct(), ["path", "name"], "left_anti")
    return listed.unionByName(alone.select("path", "name", F.lit("embedded_only").alias("status"), F.lit(None).cast(left.schema["row"].dataType).alias("row")))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Counts of each status for each path, and whether everything matches."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = compared.groupBy("path").agg(count("matched").alias("matched"), count("time").alias("time_differs"), count("sidecar_only").alias("sidecar_only"), count("embedded_only").alias("embedded_only"))
    ok = (F.col("matched") > 0) & (F.col("time_differs") + F.col("sidecar_only") + F.col("embedded_only") == 0)
    return out.withColumn("ok", ok)
