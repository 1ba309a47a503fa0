"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, as a Java, RE2 and Python pattern alike.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts are long, and a batch is held by the JVM and by Python at once.
_BATCH_KEY, _BATCH_DEFAULT, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after Arrow batches of its session are set to 1,000 rows, if they have Spark's
    default of 10,000."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, _BATCH_ROWS)
    return df


# What a Python worker holds for its next tasks, of one key at a time.
_HELD: dict = {}


def hold(key, make: Callable):
    """What ``make`` gives, kept by this Python worker until another key or :func:`own_memory`."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
        _give_back()
    return _HELD[key]


def _give_back() -> None:
    """Memory of this process that is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _let_go() -> None:
    if _HELD:
        _HELD.clear()
        gc.collect()
    _give_back()


def own_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow, in workers that hold nothing of earlier operators and keep no free memory.

    Workers live on from task to task and from query to query, and an executor's limit counts
    them all.
    """

    def task(batches: Iterator) -> Iterator:
        _let_go()
        yield from run(batches)
        _give_back()

    return task


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


# Tables of narrow rows are in few tasks, each of about so many rows at least.
_ROWS_A_TASK = 50_000


def in_few_tasks(df: DataFrame, rows: int, each: int = _ROWS_A_TASK) -> DataFrame:
    """``df`` in as many tasks as ``rows``, the most that it can have, are worth, if the session's
    shuffles have more: else each of these writes files, and its part of the log, for next to no rows."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // each))
    return df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """One row per distinct ``keys`` with ``copies``, the number of equal rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
