"""Which checkpoints of each training run to resume from, keep, or ship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _columns_of(df: DataFrame, run: str) -> list[str]:
    return [c for c in df.columns if c != run]


def latest(checkpoints: DataFrame, run: str = "run") -> DataFrame:
    """The checkpoint with the highest step of every run."""
    row = F.struct(*_columns_of(checkpoints, run))
    return checkpoints.groupBy(run).agg(F.max_by(row, "step").alias("r")).select(run, "r.*")


def retained(checkpoints: DataFrame, keep: int = 3, run: str = "run") -> DataFrame:
    """The ``keep`` newest checkpoints of every run.

    Spark limits each task to ``keep`` rows per run before the exchange, so a
    run with most of the checkpoints does not land in one task.
    """
    newest = W.partitionBy(run).orderBy(F.desc("step"))
    return (
        checkpoints.withColumn("age", F.row_number().over(newest))
        .filter(F.col("age") <= keep)
        .drop("age")
    )


def best(
    checkpoints: DataFrame,
    metric: str = "eval_loss",
    *,
    greater_is_better: bool = False,
    has_eval: bool = True,
    run: str = "run",
) -> DataFrame:
    """The checkpoint with the best metric of every run; the earliest wins a tie.

    Checkpoints without a metric are ignored. Without an eval split there is no
    best checkpoint and the result is empty.
    """
    measured = checkpoints.filter(F.col(metric).isNotNull() & ~F.isnan(metric) & F.lit(has_eval))
    score = -F.col(metric) if greater_is_better else F.col(metric)
    row = F.struct(*_columns_of(checkpoints, run))
    chosen = F.min_by(row, F.struct(score, F.col("step")))
    return measured.groupBy(run).agg(chosen.alias("r")).select(run, "r.*")
