"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The documents of a source are put in seeded order within shards and cut into blocks of equal tokens. Blocks are allotted to
the sources, and each source's to its shards, by highest quotients; a shard then takes its quota of blocks by seeded rank,
repeating all of them where the quota exceeds their number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvflow.llm.tokens import with_sizes
from kvflow.session import bounded, materialise

BLOCK_TOKENS = 1024
#: A shard is ordered by one task.
SHARD_TOKENS = 32_000_000
SEED = 20240229
#: Sources that a mix may name; the driver apportions among them.
TARGETS = 100_000


def apportion(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest weight / (2 x seats held + 1); equal quotients in order of position.

    Seats that the caps leave no taker for are not allotted. The seats are first set by a divisor that gives out too few,
    so the number of steps does not grow with the seats.
    """
    caps = [seats] * len(weights) if caps is None else list(caps)
    given = lambda divisor: [min(cap, int(w / divisor + 0.5)) if w > 0 else 0 for w, cap in zip(weights, caps, strict=True)]
    low, high = 0.0, max([*weights, 1.0]) * 2 + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if middle > 0 and sum(given(middle)) <= seats else (middle, high)
    held = given(high)
    queue = [(-w / (2 * n + 1), i) for i, (w, n, cap) in enumerate(zip(weights, held, caps, strict=True)) if w > 0 and n < cap]
    heapq.heapify(queue)
    for _ in range(seats - sum(held)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * held[i] + 1), i))
    return held


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, shard, block, n_tokens, repeats): the documents of the mix and how often each is used.

    * The total is the largest at which every source that has documents can fill its target share within its max_repeats, so
      the shares hold up to a block. Documents of other sources, without source or without tokens stay out.
    * Targets are one row per source (the least of each column if there are several), a list that people keep: more than
      TARGETS rows raise. A source with a null or no positive share is not used. One without documents, or that may not be
      used at all, can't be reached: the others keep their weights to each other, and shares() reports 0 for it.
    """
    goals = targets.groupBy("source").agg(F.min("target_share").alias("share"), F.min("max_repeats").alias("most")).where("share > 0 AND source IS NOT NULL")
    listed = goals.limit(TARGETS + 1).collect()
    if len(listed) > TARGETS:
        raise ValueError(f"more than {TARGETS} sources to mix")
    sized = with_sizes(documents.select("doc_id", "source", "text").join(bounded(goals.select("source")), "source", "left_semi").select("doc_id", "source", "text"), "text")
    sized = materialise(sized.where("n_tokens > 0"), "sizes")

    # One row per source: mix_targets is a list that people keep.
    shards = sized.groupBy("source").agg(F.ceil(F.sum("n_tokens") / shard_tokens).cast("int").alias("n_shards"))
    at = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("n_tokens"))
    placed = sized.join(bounded(shards), "source").withColumn("at", at).withColumn("shard", F.pmod("at", "n_shards").cast("int")).drop("n_shards")
    ordered = Window.partitionBy("source", "shard").orderBy("at", "doc_id")
    start = F.sum("n_tokens").over(ordered) - F.col("n_tokens")
    placed = materialise(placed.withColumn("block", F.floor(start / block_tokens)).drop("at"), "blocks")

    # Long documents may jump over a block, so the blocks that begin are numbered without gaps.
    blocks = placed.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("tokens"))
    per_shard = materialise(blocks.groupBy("source", "shard").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens")), "shards")
    have = {r.source: r.tokens for r in per_shard.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    # Sources that have something to give, with the most blocks that they can.
    wanted = sorted((r.source, r.share, have.get(r.source, 0) * (r.most or 0) / block_tokens) for r in listed if have.get(r.source, 0) * (r.most or 0) > 0)
    total = sum(share for _, share, _ in wanted)
    caps = [math.floor(most) for *_, most in wanted]
    seats = min((math.floor(most * total / share) for _, share, most in wanted), default=0)
    most_used = {r.source: r.most or 0 for r in listed}
    quotas = dict(zip((source for source, *_ in wanted), apportion([share for _, share, _ in wanted], seats, caps), strict=True))

    # A quota counts equal blocks; a shard's blocks are as many seats as their tokens make.
    def to_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        quota = quotas.get(rows["source"].iloc[0], 0)
        caps = (rows["tokens"] * most_used.get(rows["source"].iloc[0], 0) // block_tokens).astype(int).tolist()
        return rows.assign(quota=apportion(rows["tokens"].astype(float).tolist(), quota, caps))[["source", "shard", "tokens", "quota"]]

    given = per_shard.groupBy("source").applyInPandas(to_shards, "source string, shard int, tokens bigint, quota bigint")
    # Whole rounds use every block; the rest goes to blocks in seeded order as long as their tokens come closer to it.
    lottery = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "source", "shard", "block"), "block")
    drawn = blocks.withColumn("middle", F.sum("tokens").over(lottery) - F.col("tokens") / 2).drop("tokens").join(bounded(given), ["source", "shard"])
    need = F.col("quota") * block_tokens
    rounds = F.floor(need / F.col("tokens"))
    middle = F.col("middle") <= need - rounds * F.col("tokens")
    drawn = drawn.select("source", "shard", "block", (rounds + middle.cast("bigint")).cast("int").alias("repeats")).where("repeats > 0")
    return placed.join(drawn, ["source", "shard", "block"]).select("doc_id", "source", "shard", "block", "n_tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, tokens_used, share_reached, most_used) for each target, 0 where nothing is used."""
    used = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_used"))
    whole = mixed.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] or 0
    none = {"n_docs": 0, "tokens_used": 0, "most_used": 0}
    share = F.when(F.lit(whole) > 0, F.col("tokens_used") / F.lit(max(whole, 1))).otherwise(F.lit(0.0))
    return targets.select("source", "target_share").join(used, "source", "left").na.fill(none).withColumn("share_reached", share)
