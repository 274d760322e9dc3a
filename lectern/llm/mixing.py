"""Combines records of several sources so that each has its target share of all tokens, small sources repeated."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir


#: The group of rare languages or topics.
RARE = "\x00"


def rake(tokens: np.ndarray, most: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60) -> np.ndarray:
    """Tokens to draw from each cell: iterative proportional fitting to the margins, at most `most` of a cell.

    margins holds (index of each cell's group, target of each group); the last one has the last word and is met exactly
    wherever the cells' limits allow: what a limit cuts off goes to the group's other cells, in proportion.
    """
    x = np.minimum(tokens.astype(float), most)
    for _ in range(rounds):
        before = x.copy()
        for group, target in margins:
            now = np.bincount(group, x, len(target))
            x = np.minimum(x * np.where(now > 0, target / np.maximum(now, 1e-12), 0.0)[group], most)
        if np.abs(x - before).max(initial=0.0) <= 1e-9 * max(tokens.sum(), 1.0):
            break
    group, target = margins[-1]
    for _ in range(200):
        now = np.bincount(group, x, len(target))
        short = target - now
        open_ = x < most * (1 - 1e-12)
        base = np.bincount(group, np.where(open_, np.maximum(x, 1e-9 * most), 0.0), len(target))
        if not ((short > 1e-7 * np.maximum(target, 1.0)) & (base > 0)).any():
            break
        grow = np.where((short > 0) & (base > 0), short / np.maximum(base, 1e-300), 0.0)
        x = np.minimum(np.where(open_, np.maximum(x, 1e-9 * most) * (1 + grow[group]), x), most)
    return x


class Mixture(NamedTuple):
    """drawn (key, source, copies), report by source, margins (margin, value, target_share, actual_share, tokens)."""

    drawn: DataFrame
    report: DataFrame
    margins: DataFrame


def frequent(rows: DataFrame, column: str, least_share: float) -> list[str]:
    """The values with at least `least_share` of all tokens, so at most 1 / least_share of them."""
    totals = rows.groupBy(column).agg(F.sum("size").alias("t"))
    whole = rows.agg(F.sum("size").alias("t")).first().t or 0
    return sorted(r[column] for r in totals.where(F.col("t") >= least_share * whole).select(column).collect())


def mix(
    docs: DataFrame, targets: list[tuple[str, float, int]], *, key: str, source: str, language: str, topic: str, size: str,
    total_tokens: int | None = None, block_rows: int = 50_000, starts: int = 64, seed: str = "mixture", language_share: float = 0.01, topic_share: float = 0.001,
) -> Mixture:
    """The mixture, one row for each document drawn, and reports of the shares reached by sources, languages and topics.

    targets: (source, share, most uses of a document). Documents of other or null sources, or without tokens, take no
    part; null languages and topics are groups of their own. The token weights of the cells (source, language, topic)
    are raked to the sources' targets and to the languages' and topics' own shares of the available tokens; a cell's
    weight over its tokens is the number of times each of its documents is expected. Within each source documents are
    put in order of size in blocks of about `block_rows`, and drawn by systematic sampling with these probabilities, so a
    document comes floor or ceil of its expected times, never more than its most uses. Of `starts` evenly spaced starts
    of the sampling, each source takes the one that comes nearest to its target. A source that has no documents, or
    too few for its share, leaves the rest to the others in proportion. total_tokens defaults to the largest size at
    which every source that has documents reaches its share. Repeated documents are drawn each on their own.

    Languages below `language_share` of all tokens make up one group, null in the report, and so do topics below
    `topic_share`. So the cells sent to the driver and to the tasks are at most sources / (language_share * topic_share),
    no matter how many documents, languages or topics there are; every document takes part all the same.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    wanted: dict[str, tuple[float, int]] = {}
    for name, share, most in targets:
        if name is not None and share is not None and share > 0:
            wanted[name] = (wanted.get(name, (0.0, 0))[0] + float(share), max(wanted.get(name, (0.0, 1))[1], int(most or 1), 1))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{language}`").cast("string"), F.lit("")).alias("language"), F.coalesce(F.col(f"`{topic}`").cast("string"), F.lit("")).alias("topic"), F.col(f"`{size}`").cast("long").alias("size")
    )
    rows = rows.where(F.col("source").isin(sorted(wanted)) & (F.col("size") > 0)).checkpoint()
    for column, least in (("language", language_share), ("topic", topic_share)):
        rows = rows.withColumn(column, F.when(F.col(column).isin(frequent(rows, column, least)), F.col(column)).otherwise(RARE))
    cells = rows.groupBy("source", "language", "topic").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).toPandas().sort_values(["source", "language", "topic"])
    present = sorted(set(cells["source"]))
    share = np.array([wanted[s][0] for s in present])
    share = share / share.sum() if len(share) else share
    most_uses = np.array([wanted[s][1] for s in present])
    tokens = cells["tokens"].to_numpy(float)
    group = {c: cells[c].astype("category").cat.codes.to_numpy().astype(int) for c in ("source", "language", "topic")}
    have = np.bincount(group["source"], tokens, len(present)) if len(cells) else np.zeros(0)
    if total_tokens is None:
        total = float(np.min(have * most_uses / share)) if len(present) else 0.0
    else:
        total = float(total_tokens)
    goal, free = np.zeros(len(present)), np.ones(len(present), bool)
    while free.any():  # what a source can't give goes to the others in proportion
        left = total - goal[~free].sum()
        goal[free] = left * share[free] / share[free].sum()
        over = free & (goal > have * most_uses * (1 + 1e-12))
        if not over.any():
            break
        goal[over] = (have * most_uses)[over]
        free &= ~over
    if len(cells):
        natural = lambda c: np.bincount(group[c], tokens) / tokens.sum() * goal.sum()
        drawn = rake(tokens, tokens * most_uses[group["source"]], [(group["topic"], natural("topic")), (group["language"], natural("language")), (group["source"], goal)])
        cells["times"] = drawn / tokens
    else:
        cells["times"] = []
    sizes = cells.groupby("source")["n"].sum()
    plan = [(r.source, r.language, r.topic, float(r.times), int(wanted[r.source][1]), max(1, math.ceil(int(sizes[r.source]) / block_rows))) for r in cells.itertuples()]
    plan_df = spark.createDataFrame(plan, "source string, language string, topic string, times double, most int, blocks int")
    joined = rows.join(F.broadcast(plan_df), ["source", "language", "topic"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), "blocks"))
    order = Window.partitionBy("source", "block").orderBy(F.col("size").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    shift = F.pmod(F.xxhash64("source", "block", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    lined = joined.select("key", "source", "language", "topic", "size", "times", "most", (F.sum("times").over(order) + shift).alias("upto")).checkpoint()

    def copies(start: Column) -> Column:
        step = F.floor(F.col("upto") + start + 1e-9) - F.floor(F.col("upto") + start - F.col("times") + 1e-9)
        return F.least(step, F.col("most")).cast("int")

    trial = lined.groupBy("source").agg(*[F.sum(copies(F.lit(k / starts)) * F.col("size")).alias(f"t{k}") for k in range(starts)]).collect()
    planned = dict(zip(present, goal.tolist()))
    chosen = {r.source: min(range(starts), key=lambda k: (abs((r[f"t{k}"] or 0) - planned[r.source]), k)) / starts for r in trial}
    start = F.lit(0.0)
    for name, value in sorted(chosen.items()):
        start = F.when(F.col("source") == name, F.lit(value)).otherwise(start)
    taken = lined.withColumn("copies", copies(start)).where("copies > 0").select("key", "source", "language", "topic", "copies", "size")
    used = taken.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("size")).alias("tokens"))
    names = spark.createDataFrame(
        [(s, v[0], v[1], int(have[present.index(s)]) if s in present else 0, float(goal[present.index(s)]) if s in present else 0.0) for s, v in sorted(wanted.items())],
        "source string, target_share double, max_repeat int, available_tokens long, planned_tokens double",
    )
    report = names.join(used, "source", "left").na.fill(0, ["documents", "most_copies", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row a source
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)).withColumn("limited", F.col("planned_tokens") >= F.col("available_tokens") * F.col("max_repeat") * (1 - 1e-9))
    parts = []
    for column in ("language", "topic"):
        reached = taken.groupBy(F.col(column).alias("value")).agg(F.sum(F.col("copies") * F.col("size")).alias("tokens"))
        wanted_rows = [(v, float(t)) for v, t in cells.groupby(column)["tokens"].sum().div(max(tokens.sum(), 1.0)).items()]
        part = spark.createDataFrame(wanted_rows, "value string, target_share double").join(reached, "value", "left").na.fill(0, ["tokens"])
        parts.append(part.select(F.lit(column).alias("margin"), "value", "target_share", "tokens"))
    margins = parts[0].unionByName(parts[1])
    whole = F.sum("tokens").over(Window.partitionBy("margin"))  # one row a group
    margins = margins.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)).withColumn("value", F.when(F.col("value") != RARE, F.col("value")))
    return Mixture(taken.select(F.col("key").alias(key), F.col("source").alias(source), "copies"), report.drop("planned_tokens"), margins)
