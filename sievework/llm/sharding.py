"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import small_side, store

#: Blocks of input whose counts the driver draws from. A bound: more input partitions are coalesced.
MAX_BLOCKS = 1 << 15


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` taken without replacement; by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    left = rng.random() - at_mode
    up = down = mode
    p_up = p_down = at_mode
    while left > 0:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if up >= high and down <= low or (p_up < 1e-300 and p_down < 1e-300):
            return mode
    return mode


def communication_matrix(block_sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each block to each shard: row sums are the block sizes, column sums the shard sizes, at most one apart."""
    rng, total = random.Random(seed), sum(block_sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng.shuffle(room)
    matrix = []
    for n in block_sizes:
        row, rest, left = [], sum(room), n
        for s in range(shards):
            take = hypergeometric(rng, room[s], rest - room[s], left)
            rest -= room[s]
            left -= take
            room[s] -= take
            row.append(take)
        matrix.append(row)
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", bucket_rows: int = 50_000) -> DataFrame:
    """The columns of docs with `shard` (0 .. shards-1) and `slot` (gapless from 0 in each shard).

    1. Each input partition is a block; its rows are sorted by a keyed hash of the id (the local permutation) and
       numbered, and the blocks are stored, so that counts and rows agree whatever executors are lost later.
    2. The driver draws the exact block-to-shard counts (at most MAX_BLOCKS x shards numbers).
    3. A row's place in its block and the drawn counts name its shard.
    4. Rows are exchanged by shard and a range of a keyed hash of their place, of about bucket_rows rows each, and
       numbered there; sums of the ranges' counts give each its first slot. No task holds a whole shard, and neither a
       repeated id nor a null one gathers rows in one.

    Shard sizes differ by one at most. Nulls in any column, empty and very long texts and repeated rows are rows like
    others (full repeats are interchangeable); ids and columns may be of any type. An empty table gives an empty result.
    Columns of docs named shard or slot are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    laid = docs.select(F.struct(*kept).alias("row")).coalesce(MAX_BLOCKS)
    key = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit(""))
    ties = [F.col(f"row.`{c}`") for c in kept if not dict(docs.dtypes)[c].startswith(("map", "variant"))]
    laid = laid.sortWithinPartitions(F.xxhash64(F.lit(seed), key), *ties).withColumn("at", F.monotonically_increasing_id())
    blocks = store(laid.select("row", F.shiftright("at", 33).alias("block"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "shard-blocks")
    sizes = sorted((r[0], r[1]) for r in blocks.groupBy("block").count().collect())
    bounds = []
    for (block, _), row in zip(sizes, communication_matrix([n for _, n in sizes], shards, seed), strict=True):
        ends, so_far = [], 0
        for n in row:
            so_far += n
            ends.append(so_far)
        bounds.append((block, ends))
    drawn = spark.createDataFrame(bounds, "block long, ends array<long>")  # MAX_BLOCKS rows at most
    buckets = max(8, math.ceil(sum(n for _, n in sizes) / shards / bucket_rows))
    order = F.xxhash64(F.lit(seed + 1), "block", "place")
    sent = blocks.join(F.broadcast(drawn), "block").select(
        "row",
        F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"),
        order.alias("order"),
        F.pmod(order, F.lit(buckets)).cast("int").alias("bucket"),
        "block",
        "place",
    )
    counts = store(sent.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", "block", "place"))
    placed = sent.withColumn("nth", nth).join(small_side(starts, counts.count()), ["shard", "bucket"])
    return placed.select("row.*", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))
