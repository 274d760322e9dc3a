"""Expected and transcribed texts in one consistent form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .lookalike import consistent, letter_pairs

TEXTS = ["expected_text", "transcribed_text"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verse_comparison").select("comparison_id", "lang", *TEXTS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    pairs = letter_pairs(rows, TEXTS)
    differ = spread(rows.where(F.col("expected_text") != F.col("transcribed_text")))
    return consistent(differ, TEXTS, pairs).where("expected_text_form = transcribed_text_form").select("comparison_id")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    pairs = letter_pairs(rows, TEXTS)
    return consistent(spread(rows), TEXTS, pairs).select("comparison_id", "expected_text_form", "transcribed_text_form")


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms}
SQL: dict[str, str] = {}
