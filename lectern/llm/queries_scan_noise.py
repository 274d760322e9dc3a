"""Chapter scripts from scanned pages: what disturbs their lines, and their text as continuous paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .scan_noise import repair_scripts


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    names = [r.name for r in table(spark, d, "ref_item").where("kind = 'book' AND name IS NOT NULL").select("name").collect()]
    return repair_scripts(spread(table(spark, d, "parsed_script").select("script_id", "raw_text")), sorted(names))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("script_id", F.explode("noise").alias("x")).select("script_id", "x.line_no", "x.noise")


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("script_id", F.explode("paragraphs").alias("x")).select("script_id", "x.para_no", "x.verse", "x.text")


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs}
SQL: dict[str, str] = {}
