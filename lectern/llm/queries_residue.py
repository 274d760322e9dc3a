"""Documents that hold template residue, and the corpus without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, table
from .residue import find_residue


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.join(find_residue(spread(docs.select("doc_id", "text"))).select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")


QUERIES = {"p8_found": p8_found, "p8_clean": p8_clean}
SQL: dict[str, str] = {}
