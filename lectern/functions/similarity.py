"""Similarity of texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import comparable


def _ratio(a, b) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The larger of the matching-block ratios of characters and of words; no built-in computes it."""
    return pd.Series([max(_ratio(x or "", y or ""), _ratio((x or "").split(), (y or "").split())) for x, y in zip(a, b)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """Similarity from 0 to 1 of two texts in comparable form; null counts as ''. Equal forms skip the comparison."""
    x, y = comparable(a), comparable(b)
    return F.when(x == y, F.lit(1.0)).otherwise(block_similarity(x, y))


def greedy_similarity(a: Column, b: Column) -> Column:
    """2 m / (len a + len b) with m the characters of a found in b one after the other; a missing one ends the search."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("m"))

    def step(acc: Column, c: Column) -> Column:
        found = F.when(acc.at < 0, 0).otherwise(F.call_function("locate", c, y, acc.at + 1))
        return F.struct(F.when(found > 0, found).otherwise(F.lit(-1)).alias("at"), (acc.m + F.when(found > 0, 1).otherwise(0)).alias("m"))

    chars = F.filter(F.split(x, ""), lambda c: c != "")
    m = F.aggregate(chars, start, step, lambda acc: acc.m)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * m / total)
