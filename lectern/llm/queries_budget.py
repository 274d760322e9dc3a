"""Documents packed into containers, and mixed to target shares, both in tokens."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, spread, table
from .mixing import Mixture, mix
from .packing import pack
from .tokens import token_sizes

#: Where the tokenizer's vocabulary lies on the machines of these queries.
VOCABULARY = os.environ.get("LECTERN_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_sizes(spread(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"], vocabulary=VOCABULARY)
    packs = [(r.pack, r.capacity_tokens) for r in table(spark, d, "pack_size").collect()]
    return pack(sizes, packs, key="doc_id", size="n_tokens")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each pack are."""
    capacity = table(spark, d, "pack_size").select("pack", "capacity_tokens")
    each = p6_packed(spark, d).groupBy("pack", "container").agg(F.sum("tokens").alias("tokens"))
    total = each.groupBy("pack").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(F.broadcast(capacity), "pack").withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def _mixture(spark: SparkSession, d: str, whole: bool = False) -> Mixture:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.regexp_extract("path", "^narration/[^/]*/([^/]*)/", 1).alias("topic"))
    sizes = token_sizes(spread(docs), ["doc_id", "lang", "source", "topic"], vocabulary=VOCABULARY)
    targets = [(r.source, r.target_share, r.max_repeat) for r in table(spark, d, "mix_target").collect()]
    total = None
    if whole:
        checkpoint_dir(spark)
        sizes = sizes.checkpoint()  # the tokens are counted once
        listed = [s for s, share, _ in targets if s is not None and share is not None and share > 0]
        total = sizes.where(F.col("source").isin(listed)).agg(F.sum("n_tokens")).first()[0] or 0
    return mix(sizes, targets, key="doc_id", source="source", language="lang", topic="topic", size="n_tokens", total_tokens=total)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).drawn


def _shares(report: DataFrame) -> DataFrame:
    return report.select("source", "target_share", F.round("actual_share", 6).alias("actual_share"), "tokens", "documents", "available_tokens", "max_repeat", "most_copies", "limited")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(_mixture(spark, d).report)


def p7_whole_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture at the size of all available tokens of the listed sources; small sources are repeated up to their limits."""
    return _mixture(spark, d, whole=True).drawn


def p7_whole_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(_mixture(spark, d, whole=True).report)


def p7_margins(spark: SparkSession, d: str) -> DataFrame:
    """The shares of languages and topics, wanted and reached."""
    made = _mixture(spark, d).margins
    return made.select("margin", "value", F.round("target_share", 6).alias("target_share"), F.round("actual_share", 6).alias("actual_share"), "tokens")


QUERIES = {"p6_packed": p6_packed, "p6_report": p6_report, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_margins": p7_margins, "p7_whole_mixture": p7_whole_mixture, "p7_whole_shares": p7_whole_shares}
SQL: dict[str, str] = {}
