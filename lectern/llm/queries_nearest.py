"""Sidecar markers with the nearest embedded marker of the same recording and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .nearest import match_nearest

TOLERANCE_S = 0.5


def _name(c: str) -> Column:
    """Trimmed and without case; null if nothing is left."""
    name = F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("sample_rate") > 0, F.col("sample_rate"))
    return match_nearest(
        table(spark, d, "csv_marker"), table(spark, d, "marker"), left_id="csv_id", right_id="marker_id",
        left_entity=[F.col("path"), _name("name")], right_entity=[F.col("path"), _name("label")],
        left_time=F.col("start_seconds"), right_time=F.col("sample_offset") / rate, tolerance=TOLERANCE_S,
    )


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How many sidecar markers of each recording have an embedded one near enough, and how many have none."""
    every = table(spark, d, "csv_marker").select("csv_id", "path")
    found = p2_found(spark, d).select("csv_id", F.lit(1).alias("hit"))
    return every.join(found, "csv_id", "left").groupBy("path").agg(F.count("*").alias("markers"), F.count("hit").alias("matched"))


_FOUND = """
l AS (SELECT csv_id, path, lower(trim(name)) AS k, start_seconds AS t FROM csv_marker WHERE start_seconds IS NOT NULL AND NOT isnan(start_seconds) AND trim(name) <> '' AND path IS NOT NULL),
r AS (SELECT marker_id, path, lower(trim(label)) AS k, sample_offset / sample_rate AS t FROM marker WHERE sample_offset IS NOT NULL AND sample_rate > 0 AND trim(label) <> '' AND path IS NOT NULL),
found AS (SELECT csv_id, arg_min(marker_id, (abs(l.t - r.t), marker_id)) AS marker_id FROM l JOIN r USING (path, k) WHERE abs(l.t - r.t) <= 0.5::DOUBLE GROUP BY csv_id)
"""

QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
SQL = {
    "p2_found": f"WITH {_FOUND} SELECT csv_id, marker_id FROM found",
    "p2_unmatched": f"WITH {_FOUND} SELECT path, count(*)::BIGINT AS markers, count(found.csv_id)::BIGINT AS matched FROM csv_marker LEFT JOIN found USING (csv_id) GROUP BY path",
}
