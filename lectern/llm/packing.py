"""Fills containers of fixed capacity with items of varying size, leaving little unused space."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each size, in the order given.

    Online: an array counts the open containers of each fill level. An item goes to the level, an empty container
    included, that makes the sum of the squared counts smallest, of equal ones to the fullest; this keeps many levels
    open a little and thus gaps for every size. At the end whole open containers are put together where they fit, the
    fullest first, each into the fullest that still takes it. No size may exceed the capacity.
    """
    count = np.zeros(capacity + 1)
    count[capacity] = -0.5  # a full container adds nothing to the sum
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.zeros(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        level = 0
        if s < capacity:
            best = 2 * count[s] + 1
            now = count[1 : capacity - s + 1]
            change = np.where(now > 0, 2.0 * (count[1 + s :] - now) + 2.0, np.inf)
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = at + 1
        if level:
            number = stacks[level].pop()
            count[level] -= 1
        else:
            number, made = made, made + 1
        out[i] = number
        if level + s < capacity:
            stacks[level + s].append(number)
            count[level + s] += 1
    into = np.arange(made)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open containers by free space
    free = np.zeros(capacity + 1, np.int64)
    for level in range(capacity - 1, 0, -1):
        for number in stacks[level]:
            fits = np.flatnonzero(free[level:])
            if len(fits):
                gap = level + int(fits[0])
                target = room[gap].pop()
                free[gap] -= 1
                into[number] = target
                gap -= level
            else:
                target, gap = number, capacity - level
            if gap:
                room[gap].append(target)
                free[gap] += 1
    return into[out]


def pack(items: DataFrame, packs: list[tuple[str, int]], *, key: str, size: str, shard_containers: int = 4096, shard_items: int = 100_000) -> DataFrame:
    """(pack, key, piece, container, start, tokens): where each item lies in the containers of each pack.

    An item larger than the capacity is cut into full pieces, each a container of its own, and a rest that is packed
    like any item; no other item is cut, so it has one piece, number 0. Items of size 0 or null take no space and give
    no row. Items are divided by a hash of their key into shards of about `shard_containers` containers and at most
    about `shard_items` items, each packed on its own; a shard leaves only a few containers part empty, so the loss
    against packing everything together is small, and no shard grows with the data. Containers are numbered by shard.
    Only keys and sizes are shuffled, never texts.
    """
    checkpoint_dir(items.sparkSession)
    sized = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{size}`").cast("long").alias("size")).where("size > 0").checkpoint()
    kind = sized.schema["key"].dataType.simpleString()
    parts = []
    row = sized.agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).first()
    for name, capacity in sorted(packs):
        if capacity is None or capacity <= 0:
            continue
        shards = max(1, math.ceil((row.tokens or 0) / (capacity * shard_containers)), math.ceil(row.n / shard_items))
        whole = F.floor(F.col("size") / capacity).cast("long")
        rest = (F.col("size") % capacity).cast("long")
        full = sized.where(F.col("size") >= capacity).select(
            F.lit(name).alias("pack"), "key", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"), F.lit(capacity).cast("long").alias("tokens")
        )
        full = full.select("pack", "key", "piece", F.concat_ws("-", F.lit("whole"), F.col("key").cast("string"), F.col("piece").cast("string")).alias("container"), F.lit(0).cast("long").alias("start"), "tokens")
        rests = sized.where(rest > 0).select(
            F.lit(name).alias("pack"), F.lit(capacity).alias("capacity"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", whole.alias("piece"), rest.alias("tokens"), F.xxhash64("key", F.lit("order")).alias("turn")
        )
        parts.append((full, rests))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "key", "piece"], kind="stable")
        sizes = rows["tokens"].to_numpy()
        container = sum_of_squares(sizes, int(rows["capacity"].iloc[0]))
        order = np.argsort(container, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, container[order][1:] != container[order][:-1]]
        start = np.empty(len(rows), np.int64)
        start[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        shard = int(rows["shard"].iloc[0])
        return pd.DataFrame({"pack": rows["pack"].to_numpy(), "key": rows["key"].to_numpy(), "piece": rows["piece"].to_numpy(), "container": [f"{shard}-{c}" for c in container], "start": start, "tokens": sizes})

    schema = f"pack string, key {kind}, piece long, container string, start long, tokens long"
    if not parts:
        return items.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    rests = parts[0][1]
    for _, other in parts[1:]:
        rests = rests.unionByName(other)
    out = rests.groupBy("pack", "shard").applyInPandas(fill, schema)
    for full, _ in parts:
        out = out.unionByName(full)
    return out.withColumnRenamed("key", key)
