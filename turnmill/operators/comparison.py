"""Two models on the same examples: their difference in loss, and how sure it is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Losses are compared in whole millionths, so that sums are exact in any order.
UNIT = 1_000_000
_DIGITS = 8
_DRAWS_A_HASH = 32 // _DIGITS
_RANGE = 16**_DIGITS


def poisson_steps() -> list[int]:
    """Where the count goes up by one, for a uniform number below 2^32: the cumulative
    probabilities of a Poisson distribution with mean 1."""
    steps, total = [], 0.0
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        step = int(total * _RANGE)
        if step >= _RANGE - 1:
            break
        steps.append(step)
    return steps


def _weights(seed: int, block: Column, ids: list[str]) -> Column:
    """How often an example is in each of four replicates, from one hash of it."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids], block.cast("string")))
    draws = [F.conv(F.substring(key, 1 + _DIGITS * i, _DIGITS), 16, 10).cast("long") for i in range(_DRAWS_A_HASH)]
    return F.array(*[sum(((d >= s).cast("int") for s in poisson_steps()), F.lit(0)) for d in draws])


def compare_models(
    losses: DataFrame, ids: list[str], *groups: str, a: str = "loss_a", b: str = "loss_b", replicates: int = 200, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """``n_used, difference, low, high, better`` of each group.

    ``losses`` has a row for each example, named by ``ids``, with ``n_tokens`` and both
    models' mean loss. ``difference`` is b's loss less a's, weighted by predicted tokens;
    examples with fewer than two tokens, or without a loss, are left out. ``low`` and
    ``high`` bound the middle ``level`` of its values in ``replicates`` samples of the examples;
    ``better`` is the share of samples in which b's loss is smaller. In a sample each example
    counts a Poisson number of times, drawn from a hash of seed, ids and sample: samples
    need no other row, are the same in any partitioning, and are summed in one pass.
    """
    if replicates % _DRAWS_A_HASH:
        raise ValueError(f"replicates must be a multiple of {_DRAWS_A_HASH}")
    predicted = (F.col("n_tokens") - 1).cast("long")
    apart = F.round(F.col(b) * UNIT).cast("long") - F.round(F.col(a) * UNIT).cast("long")
    rows = losses.filter((F.col("n_tokens") >= 2) & F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.select(*groups, *ids, predicted.alias("_tokens"), (predicted * apart).alias("_apart"))
    total = lambda c: F.sum(c.cast("decimal(20,0)"))
    whole = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_used"), total(F.col("_tokens")).alias("_n"), total(F.col("_apart")).alias("_sum"))
    # One more than the counted sample blocks would be the corpus itself; it stays apart.
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(replicates // _DRAWS_A_HASH - 1))))
    drawn = blocks.select(*groups, "_tokens", "_apart", "_block", F.posexplode(_weights(seed, F.col("_block"), ids)).alias("_place", "_times")).filter("_times > 0")
    sampled = drawn.groupBy(*groups, "_block", "_place").agg(
        total(F.col("_times") * F.col("_tokens")).alias("_n"), total(F.col("_times") * F.col("_apart")).alias("_sum")
    )
    value = lambda: F.col("_sum").cast("double") / F.col("_n").cast("double") / F.lit(float(UNIT))
    sampled = sampled.select(*groups, value().alias("_value"))
    values = F.array_sort(F.collect_list("_value"))
    # So many values are cut off at either end.
    tail = (1 - level) / 2
    at = lambda p: F.get("_values", F.greatest(F.lit(1), F.ceil(F.round(F.lit(p) * F.size("_values"), 9))).cast("int") - 1)
    spread = sampled.groupBy(*groups).agg(values.alias("_values"), F.avg((F.col("_value") < 0).cast("double")).alias("better"))
    spread = spread.select(*[F.col(g).alias(f"_{g}") for g in groups], at(tail).alias("low"), at(1 - tail).alias("high"), "better")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    joined = whole.join(spread, same, "left") if groups else whole.crossJoin(spread)
    return joined.select(*groups, "n_used", value().alias("difference"), "low", "high", "better")
