"""Queries of the reject parser, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.rejects import parse_marker_records
from .session import spread, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_marker_records(spread(table(spark, d, "csv_raw").select("line_id", "line_no", "line")))
    return parsed.where((F.col("line_no") > 1) & F.col("reason").isNotNull()).select("line_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_marker_records(spread(table(spark, d, "csv_raw").select("line_id", "path", "line_no", "line")))
    return parsed.where((F.col("line_no") > 1) & F.col("reason").isNull()).select(
        "line_id", "path", "name", F.round("start_seconds", 6).alias("start_seconds"), F.col("start_samples").cast("bigint").alias("start_samples"), "time_format"
    )


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Valid and rejected records of each recording's sidecar file."""
    parsed = parse_marker_records(spread(table(spark, d, "csv_raw").select("path", "line_no", "line")))
    return (
        parsed.where(F.col("line_no") > 1).groupBy("path", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("records"))
    )


_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_PARSED = rf"""
raw AS (SELECT *, regexp_replace(line, '\r$', '') AS rec FROM csv_raw WHERE line_no > 1),
shaped AS (SELECT *, coalesce(NOT regexp_full_match(rec, '{_FIELD}(?:\t{_FIELD})*'), false) AS quoting,
  coalesce(regexp_full_match(rec, '{_FIELD}(?:\t{_FIELD}){{5}}'), false) AS six FROM raw),
cut AS (SELECT *, regexp_extract(rec, '^({_FIELD})\t({_FIELD})\t({_FIELD})\t({_FIELD})\t', ['n', 's', 'd', 'f']) AS g FROM shaped),
typed AS (SELECT *,
  CASE WHEN g.n LIKE '"%' THEN replace(g.n[2:-2], '""', '"') ELSE g.n END AS name,
  regexp_replace(CASE WHEN g.s LIKE '"%' THEN replace(g.s[2:-2], '""', '"') ELSE g.s END, '^\s+|\s+$', '', 'g') AS start,
  lower(regexp_replace(CASE WHEN g.f LIKE '"%' THEN replace(g.f[2:-2], '""', '"') ELSE g.f END, '^\s+|\s+$', '', 'g')) AS time_format FROM cut),
judged AS (SELECT *, CASE WHEN quoting THEN 'quoting' WHEN NOT six THEN 'columns'
  WHEN time_format NOT IN ('decimal', 'samples', '30 fps') THEN 'time_format'
  WHEN NOT (time_format = 'decimal' AND regexp_full_match(start, '([0-9]+:[0-5][0-9]|[0-9]+:[0-5][0-9]:[0-5][0-9]|[0-9]+)\.[0-9]{{1,3}}')
    OR time_format = 'samples' AND regexp_full_match(start, '[0-9]+')
    OR time_format = '30 fps' AND regexp_full_match(start, '[0-9]{{2}}:[0-5][0-9]:[0-5][0-9]:[0-2][0-9]')) THEN 'start' END AS reason FROM typed)
"""

QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded, "p4_reasons": p4_reasons}
SQL = {
    "p4_found": f"WITH {_PARSED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": f"""WITH {_PARSED}, parts AS (SELECT *, list_reverse(string_split(start, ':')) AS p FROM judged WHERE reason IS NULL)
SELECT line_id, path, name,
  round(CASE time_format WHEN 'decimal' THEN p[1]::DOUBLE + coalesce(p[2]::DOUBLE, 0) * 60 + coalesce(p[3]::DOUBLE, 0) * 3600
    WHEN '30 fps' THEN p[4]::DOUBLE * 3600 + p[3]::DOUBLE * 60 + p[2]::DOUBLE + p[1]::DOUBLE / 30 END, 6) AS start_seconds,
  CASE WHEN time_format = 'samples' THEN start::BIGINT END AS start_samples, time_format FROM parts""",
    "p4_reasons": f"WITH {_PARSED} SELECT path, coalesce(reason, 'valid') AS outcome, count(*)::BIGINT AS records FROM judged GROUP BY 1, 2",
}
