"""Latency of requests whose starts and pieces come as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators.timing import seconds_between


def stream_timing(starts: DataFrame, deltas: DataFrame, *, longest: str = "1 hour", lateness: str = "1 minute") -> DataFrame:
    """``request_id, total_s, ttft_s, gen_tokens`` of each request, given once.

    ``starts`` has ``request_id`` and ``started``, one row a request; ``deltas`` has
    ``request_id``, ``ts`` and ``delta``. A piece belongs to the start of its request if it
    comes at most ``longest`` after it. Each side is kept no longer than that needs: a row
    more than ``lateness`` older than the latest of its stream is late and does not count.
    A request is given when no further piece can belong to it. Append mode; the same
    figures as the batch form of the same rows.
    """
    begun = starts.select(F.col("request_id").alias("_request"), "started").withWatermark("started", lateness)
    pieces = deltas.select("request_id", "ts", "delta").withWatermark("ts", lateness)
    near = (F.col("request_id") == F.col("_request")) & (F.col("ts") >= F.col("started")) & (F.col("ts") <= F.col("started") + F.expr(f"INTERVAL {longest}"))
    said = F.col("delta") != ""
    return (
        begun.join(pieces, near)
        .groupBy("request_id", "started")
        .agg(F.max("ts").alias("end"), F.min(F.when(said, F.col("ts"))).alias("first"), F.count_if(said).alias("gen_tokens"))
        .select(
            "request_id",
            seconds_between(F.col("started"), F.col("end")).alias("total_s"),
            seconds_between(F.col("started"), F.col("first")).alias("ttft_s"),
            "gen_tokens",
        )
    )
