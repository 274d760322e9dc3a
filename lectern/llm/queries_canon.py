"""Hand-typed labels, books and file names, each with the entry of the reference list that was meant."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .canon import Rules, map_values

BOOK, FILENAME, LABEL = Rules(codes=True), Rules(codes=True, filename=True), Rules(prefix=4)


def _entries(spark: SparkSession, d: str, kind: str) -> list[tuple[int, str, str | None]]:
    rows = table(spark, d, "ref_item").where((F.col("kind") == kind) & F.col("name").isNotNull()).select("ref_id", "name", "code").collect()
    return sorted((r.ref_id, r.name, r.code) for r in rows)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    books, labels = _entries(spark, d, "book"), _entries(spark, d, "label")
    either = lambda values: "|".join(re.escape(v) for v in values if v)
    reports, markers = table(spark, d, "file_report"), table(spark, d, "marker")
    parts = [
        ("label", markers, "label", "marker_id", labels, LABEL, (F.regexp_replace("label", r"(?U)\s+", "") != "") & ~F.col("label").rlike(rf"^(?:{either(n for _, n, _ in labels)})(?: [0-9]+)?\z")),
        ("book", reports, "book", "file_id", books, BOOK, ~F.col("book").isin([n for _, n, _ in books])),
        ("filename", reports, "filename", "file_id", books, FILENAME, ~F.col("filename").rlike(rf"^(?:{either(c for _, _, c in books)})_[0-9]+\.wav\z")),
    ]
    out = None
    for name, df, value, key, entries, rules, case in parts:
        found = map_values(df, entries, value=value, row_id=key, rules=rules, case=case)
        found = found.select(F.lit(name).alias("field"), F.col(key).alias("row_id"), F.col("entry").alias("ref_id"))
        out = found if out is None else out.unionByName(found)
    return out


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The spellings of labels that mean no entry, with how often each was typed."""
    found = map_values(table(spark, d, "marker"), _entries(spark, d, "label"), value="label", row_id="marker_id", rules=LABEL)
    return found.where("entry = 0").groupBy("stem").agg(F.count("*").alias("rows"))


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
SQL: dict[str, str] = {}
