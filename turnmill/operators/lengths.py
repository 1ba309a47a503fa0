"""Token lengths: truncation, packing, length-grouped batches, step plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.functions.tokens import Tokenizer, token_count, whitespace_tokens
from turnmill.operators.ordinals import running_total, seeded_key, seeded_ordinal

# A mega-batch holds this many batches before it is sorted by length.
MEGA_BATCHES = 50
DEFAULT_MAX_LENGTH = 2048


def with_token_count(df: DataFrame, text: str = "text", tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    return df.withColumn("n_tokens", token_count(F.col(text), tokenizer))


def truncated(tokens: Column, max_length: int = DEFAULT_MAX_LENGTH) -> Column:
    """The first ``max_length`` tokens."""
    return F.slice(tokens, 1, max_length)


def pack_blocks(lengths: DataFrame, key: str, block_size: int, shard: str = "shard") -> DataFrame:
    """Lay examples end to end in key order and cut the stream into blocks.

    ``lengths`` has ``shard``, the key and ``n_tokens``. Every example takes one
    more slot for a separator. One result row per example and block it touches,
    with the slots ``[tok_from, tok_to)`` it puts there.
    """
    slots = lengths.select(shard, key, (F.col("n_tokens") + 1).cast("bigint").alias("slots"))
    placed = running_total(slots, "slots", [key], shard, name="start")
    end = F.col("start") + F.col("slots")
    first, last = F.expr(f"start div {block_size}"), F.expr(f"(start + slots - 1) div {block_size}")
    cut = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    block_start = F.col("block") * block_size
    return cut.select(
        shard,
        "block",
        key,
        (F.greatest(block_start, F.col("start")) - F.col("start")).alias("tok_from"),
        (F.least(block_start + block_size, end) - F.col("start")).alias("tok_to"),
    )


def length_groups(lengths: DataFrame, key: str, batch_size: int, seed: int = 42) -> DataFrame:
    """Batches of similar length: shuffle, cut into mega-batches, sort each by length."""
    ordered = seeded_ordinal(
        lengths.select(key, "n_tokens", seeded_key(seed, key).alias("order_key")), "order_key", [key]
    )
    mega = F.expr(f"ordinal div {MEGA_BATCHES * batch_size}")
    rank = F.row_number().over(W.partitionBy("mega").orderBy(F.desc("n_tokens"), key))
    return ordered.select(key, "n_tokens", mega.alias("mega")).select(
        key,
        (F.col("mega") * MEGA_BATCHES + F.floor((rank - 1) / batch_size)).cast("bigint").alias("batch"),
    )


def effective_batch_size(per_device: int, accumulation: int, world_size: int = 1) -> int:
    """Examples per optimiser step."""
    return per_device * accumulation * max(world_size, 1)


def batch_plan(
    examples: DataFrame,
    key: str,
    *,
    per_device: int = 2,
    accumulation: int = 8,
    world_size: int = 1,
    epochs: float = 3.0,
    max_steps: int = -1,
    seed: int = 42,
) -> DataFrame:
    """Epoch, step and micro-batch of every example.

    Each epoch has its own seeded order. ``max_steps > 0`` replaces ``epochs``
    and runs as many passes as it takes. Steps never cross epochs.
    """
    per_micro = per_device * max(world_size, 1)
    per_step = effective_batch_size(per_device, accumulation, world_size)
    steps_per_epoch = F.ceil(F.count(F.lit(1)) / F.lit(per_step))
    plan = examples.agg(steps_per_epoch.alias("per_epoch"))
    total = F.lit(max_steps) if max_steps > 0 else F.ceil(F.lit(float(epochs)) * F.col("per_epoch"))
    plan = plan.select("per_epoch", total.cast("bigint").alias("total"))
    plan = plan.select(
        F.struct("per_epoch", "total", F.ceil(F.col("total") / F.col("per_epoch")).alias("passes")).alias("plan")
    )

    passes = F.sequence(F.lit(0).cast("bigint"), F.col("plan.passes") - 1)
    repeated = (
        examples.select(key)
        .withColumn("plan", plan.scalar())
        .select(key, "plan.per_epoch", "plan.total", F.explode(passes).alias("epoch"))
    )
    seeded = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"))
    keyed = repeated.withColumn("order_key", seeded_key(seeded, key))
    known_passes = int(-(-epochs // 1)) if max_steps <= 0 else max_steps
    # Of the pass in which the steps end, only examples before that place are ranked.
    wanted = (F.col("total") - F.col("epoch") * F.col("per_epoch")) * per_step
    ordered = seeded_ordinal(keyed, "order_key", [key], "epoch", groups=known_passes, below=wanted)
    step = F.col("epoch") * F.col("per_epoch") + F.expr(f"ordinal div {per_step}")
    return (
        ordered.withColumn("step", step)
        .filter(F.col("step") < F.col("total"))
        .select("epoch", "step", F.expr(f"(ordinal % {per_step}) div {per_micro}").alias("micro_batch"), key)
    )
