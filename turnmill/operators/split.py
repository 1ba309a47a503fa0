"""Exact seeded train/eval split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators.ordinals import seeded_cut, seeded_key

# Below this many rows everything is training data.
MIN_ROWS_TO_SPLIT = 10


def eval_size(n: Column, ratio: float) -> Column:
    """Rows to hold out: ``ceil(ratio * n)`` in double arithmetic."""
    held_out = F.ceil(F.lit(float(ratio)) * n.cast("double"))
    return F.when((n >= MIN_ROWS_TO_SPLIT) & F.lit(ratio > 0), held_out).otherwise(0)


def seeded_split(df: DataFrame, id_column: str, *, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Add ``split`` (``train`` or ``eval``) with exactly ``eval_size`` eval rows.

    Rows are ordered by a seeded hash of their id and the smallest go to eval, so
    the result does not depend on partitioning. The rows themselves are not
    shuffled: they are compared with one cut value.
    """
    if ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    keyed = df.select(seeded_key(seed, id_column).alias("key"), id_column)
    cut = seeded_cut(keyed, "key", id_column, eval_size(F.col("n"), ratio)).scalar()
    own = F.struct(seeded_key(seed, id_column).alias("key"), F.col(id_column).alias("id"))
    return df.withColumn("split", F.when(own <= cut, "eval").otherwise("train"))
