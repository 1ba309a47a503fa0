"""Latency logs, token deltas and checkpoint histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators import checkpoints as ck
from turnmill.operators.timing import benchmark_summary, mark_warmup, request_timing
from turnmill.queries import adapters as a
from turnmill.streaming.deltas import accumulate_deltas
from turnmill.streaming.latency import windowed_latency

# Deltas of a reply are 5 ms apart; replies start at whole seconds after this.
EPOCH = "2024-01-01 00:00:00"
DELTA_MS = 5


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def run_log(spark, sf_dir) -> DataFrame:
    events = a.table(spark, sf_dir, "events")
    runs = events.select(
        F.col("event_type").alias("engine"),
        F.col("event_id").alias("run_index"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("prompt_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("gen_tokens"),
        F.col("value").alias("total_s"),
        (F.col("value") * 0.1).alias("ttft_s"),
    )
    return mark_warmup(runs)


def deltas(spark, sf_dir) -> DataFrame:
    """Every assistant turn as the pieces a model would have sent."""
    replies = a.turns(spark, sf_dir).filter("role = 'assistant'")
    started = F.timestamp_micros(
        F.unix_micros(F.lit(EPOCH).cast("timestamp")) + F.col("conv_id") * 1_000_000
    )
    words = F.split("content", " ")
    pieces = replies.select("conv_id", "turn", started.alias("started"), F.size(words).alias("n"), F.posexplode(words).alias("seq", "word"))
    delta = F.when(F.col("seq") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), "word"))
    ts = F.timestamp_micros(F.unix_micros("started") + (F.col("seq") + 1) * DELTA_MS * 1000)
    return pieces.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), "seq", "started", ts.alias("ts"), delta.alias("delta"),
        (F.col("seq") == F.col("n") - 1).alias("last"),
    )


def _checkpoints(spark, sf_dir) -> DataFrame:
    return a.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("eval_loss")
    )


def _windowed(spark, sf_dir) -> DataFrame:
    windows = windowed_latency(run_log(spark, sf_dir), "engine")
    windows = windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return _round(windows, "avg_total_s", "avg_ttft_s", "tokens_per_s")


QUERIES = {
    "benchmark_summary": lambda s, d: _round(
        benchmark_summary(run_log(s, d), "engine"), "avg_total_s", "avg_ttft_s", "overall_tps", "decode_tps"
    ),
    "request_timing": lambda s, d: _round(request_timing(deltas(s, d)), "total_s", "ttft_s"),
    "accumulate_deltas": lambda s, d: accumulate_deltas(deltas(s, d), "request_id"),
    "windowed_latency": _windowed,
    "latest_checkpoint": lambda s, d: ck.latest(_checkpoints(s, d)),
    "retained_checkpoints": lambda s, d: ck.retained(_checkpoints(s, d)),
    "best_checkpoint": lambda s, d: ck.best(_checkpoints(s, d)),
}

_LOG = """
log AS (
  SELECT event_type AS engine, event_id AS run_index, ts, user_id AS prompt_tokens,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS gen_tokens, value AS total_s, value * 0.1::DOUBLE AS ttft_s,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1 AS is_warmup
  FROM events)"""
_CHECKPOINTS = "ckpt AS (SELECT o_custkey AS run, o_orderkey AS step, o_totalprice AS eval_loss FROM orders)"


def _ranked(order: str, keep: int) -> str:
    return f"""
        WITH {_CHECKPOINTS}
        SELECT run, step, eval_loss FROM (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY {order}) AS place FROM ckpt)
        WHERE place <= {keep}"""


ORACLES = {
    "benchmark_summary": f"""
        WITH {_LOG},
        s AS (
          SELECT engine, CAST(count(*) AS BIGINT) AS runs, arg_max(prompt_tokens, run_index) AS prompt_tokens,
                 arg_max(gen_tokens, run_index) AS gen_tokens, avg(total_s) AS t, avg(ttft_s) AS f
          FROM log WHERE NOT is_warmup GROUP BY engine),
        r AS (SELECT *, CASE WHEN t > 0 THEN gen_tokens / t ELSE 0 END AS overall FROM s)
        SELECT engine, runs, prompt_tokens, gen_tokens, round(t, 6) AS avg_total_s, round(f, 6) AS avg_ttft_s,
               round(overall, 6) AS overall_tps,
               round(CASE WHEN t > f AND gen_tokens > 1 THEN (gen_tokens - 1) / (t - f) ELSE overall END, 6) AS decode_tps
        FROM r""",
    "request_timing": f"""
        WITH words AS (
          SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'),
        pieces AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS seq FROM words)
        SELECT conv_id || '-' || turn AS request_id,
               round(max(n) * {DELTA_MS} / 1000.0::DOUBLE, 6) AS total_s,
               round(min(CASE WHEN seq > 0 OR word <> '' THEN seq + 1 END) * {DELTA_MS} / 1000.0::DOUBLE, 6) AS ttft_s,
               CAST(count(*) FILTER (WHERE seq > 0 OR word <> '') AS BIGINT) AS gen_tokens
        FROM pieces GROUP BY conv_id, turn""",
    "accumulate_deltas": """
        SELECT conv_id || '-' || turn AS request_id, text FROM conversations WHERE role = 'assistant' AND text <> ''""",
    "windowed_latency": f"""
        WITH {_LOG}
        SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, engine, CAST(count(*) AS BIGINT) AS runs,
               round(avg(total_s), 6) AS avg_total_s, round(avg(ttft_s), 6) AS avg_ttft_s,
               round(CASE WHEN sum(total_s) > 0 THEN sum(gen_tokens) / sum(total_s) ELSE 0 END, 6) AS tokens_per_s
        FROM log WHERE NOT is_warmup GROUP BY ALL""",
    "latest_checkpoint": _ranked("step DESC", 1),
    "retained_checkpoints": _ranked("step DESC", 3),
    "best_checkpoint": _ranked("eval_loss, step", 1),
}
