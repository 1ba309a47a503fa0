"""Latency and throughput per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_latency(
    runs: DataFrame, *engines: str, window: str = "1 hour", lateness: str | None = None
) -> DataFrame:
    """Averages and output rate of the measured runs of each tumbling window.

    ``ts`` must be a timestamp with a zone. On a stream pass ``lateness``: runs
    that come later than that are left out and each window is given once. The
    rate is tokens over seconds of the whole window, since a stream has no
    "last run".
    """
    if lateness:
        runs = runs.withWatermark("ts", lateness)
    grouped = runs.filter(~F.col("is_warmup")).groupBy(F.window("ts", window).alias("w"), *engines)
    summed = grouped.agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("total_s").alias("avg_total_s"),
        F.avg("ttft_s").alias("avg_ttft_s"),
        F.sum("gen_tokens").alias("gen_tokens"),
        F.sum("total_s").alias("busy_s"),
    )
    rate = F.when(F.col("busy_s") > 0, F.col("gen_tokens") / F.col("busy_s")).otherwise(F.lit(0.0))
    return summed.select(
        F.col("w.start").alias("window_start"),
        *engines,
        "runs",
        "avg_total_s",
        "avg_ttft_s",
        rate.alias("tokens_per_s"),
    )
