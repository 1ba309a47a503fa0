"""Generation latency and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.session import materialize


def mark_warmup(runs: DataFrame, engine: str = "engine", *, warmup: int = 1) -> DataFrame:
    """Add ``is_warmup`` to the first ``warmup`` runs of every engine.

    Each engine's last warm-up run is found first. The rank filter runs in every
    task before the exchange, so an engine with most of the runs sends only
    ``warmup`` rows per task. That table has a row per engine and is written, so
    that its real size decides how it is joined; the log is not shuffled for it.
    """
    if warmup <= 0:
        return runs.withColumn("is_warmup", F.lit(False))
    place = F.row_number().over(W.partitionBy(engine).orderBy("run_index"))
    first = runs.select(engine, "run_index").withColumn("place", place)
    first = first.filter(F.col("place") <= warmup)
    ends = materialize(first.groupBy(engine).agg(F.max("run_index").alias("warm_until")), "warmup")
    marked = runs.join(ends, engine, "left")
    return marked.withColumn("is_warmup", F.col("run_index") <= F.col("warm_until")).drop("warm_until")


def _rates(gen: Column, total: Column, ttft: Column) -> tuple[Column, Column]:
    """Overall and decode tokens per second."""
    overall = F.when(total > 0, gen / total).otherwise(F.lit(0.0))
    decode = F.when((total > ttft) & (gen > 1), (gen - 1) / (total - ttft)).otherwise(overall)
    return overall, decode


def benchmark_summary(runs: DataFrame, *engines: str) -> DataFrame:
    """Averages over the measured runs; token counts are those of the last run.

    An engine without measured runs gives no row.
    """
    summed = (
        runs.filter(~F.col("is_warmup"))
        .groupBy(*engines)
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.max_by(F.struct("prompt_tokens", "gen_tokens"), "run_index").alias("last"),
            F.avg("total_s").alias("avg_total_s"),
            F.avg("ttft_s").alias("avg_ttft_s"),
        )
        .select(*engines, "runs", "last.*", "avg_total_s", "avg_ttft_s")
    )
    overall, decode = _rates(F.col("gen_tokens"), F.col("avg_total_s"), F.col("avg_ttft_s"))
    return summed.withColumns({"overall_tps": overall, "decode_tps": decode})


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def request_timing(deltas: DataFrame, request: str = "request_id") -> DataFrame:
    """Latency, time to first token and token count per request.

    ``deltas`` has one row per emitted piece: the request, its ``started`` time,
    ``ts`` and ``delta``. Empty pieces do not count as tokens.
    """
    said = F.col("delta") != ""
    return deltas.groupBy(request).agg(
        seconds_between(F.min("started"), F.max("ts")).alias("total_s"),
        seconds_between(F.min("started"), F.min(F.when(said, F.col("ts")))).alias("ttft_s"),
        F.count_if(said).alias("gen_tokens"),
    )
