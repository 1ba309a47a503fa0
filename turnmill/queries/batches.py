"""Token lengths, packing and batch plans over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.tokens import whitespace_tokens
from turnmill.operators.lengths import (
    MEGA_BATCHES,
    batch_plan,
    length_groups,
    pack_blocks,
    truncated,
    with_token_count,
)
from turnmill.queries import adapters as a

MAX_LENGTH = 256
BLOCK = 512
BATCH = 2


def _lengths(spark, sf_dir, *columns: str) -> DataFrame:
    documents = a.documents(spark, sf_dir, "text", *columns)
    return with_token_count(documents).drop("text").withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


def _truncate(spark, sf_dir) -> DataFrame:
    documents = a.documents(spark, sf_dir, "text")
    kept = truncated(whitespace_tokens(F.col("text")), MAX_LENGTH)
    return documents.select("doc_id", F.array_join(kept, " ").alias("text"), F.size(kept).cast("bigint").alias("n_tokens"))


QUERIES = {
    "token_counts": lambda s, d: _lengths(s, d),
    "truncate_tokens": _truncate,
    "pack_blocks": lambda s, d: pack_blocks(
        _lengths(s, d, "lang").withColumnRenamed("lang", "shard"), "doc_id", BLOCK
    ),
    "length_groups": lambda s, d: length_groups(_lengths(s, d), "doc_id", BATCH),
    "batch_plan": lambda s, d: batch_plan(a.table(s, d, "documents").select("doc_id"), "doc_id"),
    "batch_plan_max_steps": lambda s, d: batch_plan(
        a.table(s, d, "documents").select("doc_id"), "doc_id", max_steps=100, world_size=4
    ),
}

_TOKENS = "regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')"
_LENGTHS = f"lengths AS (SELECT doc_id, lang, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents)"


def _plan_sql(per_micro: int, per_step: int, total: str) -> str:
    return f"""
        WITH sizes AS (SELECT CAST(ceil(count(*) / {per_step}::DOUBLE) AS BIGINT) AS per_epoch FROM documents),
        plan AS (SELECT per_epoch, CAST({total} AS BIGINT) AS total FROM sizes),
        passes AS (SELECT per_epoch, total,
                     unnest(range(CAST(ceil(total / per_epoch::DOUBLE) AS BIGINT))) AS epoch FROM plan),
        placed AS (
          SELECT doc_id, epoch, per_epoch, total,
                 row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || doc_id), doc_id) - 1 AS pos
          FROM documents CROSS JOIN passes)
        SELECT epoch, CAST(epoch * per_epoch + pos // {per_step} AS BIGINT) AS step,
               CAST((pos % {per_step}) // {per_micro} AS BIGINT) AS micro_batch, doc_id
        FROM placed WHERE epoch * per_epoch + pos // {per_step} < total"""


ORACLES = {
    "token_counts": f"WITH {_LENGTHS} SELECT doc_id, n_tokens FROM lengths",
    "truncate_tokens": f"""
        SELECT doc_id, array_to_string(({_TOKENS})[1:{MAX_LENGTH}], ' ') AS text,
               CAST(least(len({_TOKENS}), {MAX_LENGTH}) AS BIGINT) AS n_tokens FROM documents""",
    "pack_blocks": f"""
        WITH {_LENGTHS},
        placed AS (
          SELECT lang AS shard, doc_id, n_tokens + 1 AS slots,
                 coalesce(sum(n_tokens + 1) OVER (PARTITION BY lang ORDER BY doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lengths),
        cut AS (
          SELECT *, unnest(range(CAST(start // {BLOCK} AS BIGINT),
                                 CAST((start + slots - 1) // {BLOCK} + 1 AS BIGINT))) AS block FROM placed)
        SELECT shard, block, doc_id,
               CAST(greatest(0, block * {BLOCK} - start) AS BIGINT) AS tok_from,
               CAST(least(slots, (block + 1) * {BLOCK} - start) AS BIGINT) AS tok_to FROM cut""",
    "length_groups": f"""
        WITH {_LENGTHS},
        placed AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM lengths),
        ranked AS (
          SELECT *, pos // {MEGA_BATCHES * BATCH} AS mega,
                 row_number() OVER (PARTITION BY pos // {MEGA_BATCHES * BATCH}
                                    ORDER BY n_tokens DESC, doc_id) - 1 AS place FROM placed)
        SELECT doc_id, CAST(mega * {MEGA_BATCHES} + place // {BATCH} AS BIGINT) AS batch FROM ranked""",
    "batch_plan": _plan_sql(2, 16, "ceil(3.0::DOUBLE * per_epoch)"),
    "batch_plan_max_steps": _plan_sql(8, 64, "100"),
}
