"""Numbering rows and running totals without a single-task sort.

Each of these splits the rows into bounded groups, aggregates one small row per
group, and adds the total of all earlier groups to a value computed inside the
group. No step ranks more than one group in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.session import materialize

# Seeded keys are grouped by their first four hex digits.
_BUCKET_DIGITS = 4
_BUCKETS = 16**_BUCKET_DIGITS
# The bucket table is broadcast while it has at most this many rows (about 32 MB).
_BROADCAST_ROWS = 16 * _BUCKETS
# Three numbers per file block: 2 million blocks are 256 TB of text in 128 MB
# blocks and some 150 MB to broadcast.
_BROADCAST_BLOCKS = 2_000_000


def seeded_key(seed: Column | int, *ids: str) -> Column:
    """A uniform, reproducible sort key for a row, whatever its partition."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), *(F.col(i).cast("string") for i in ids)))


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, _BUCKET_DIGITS)


def _earlier(order: Sequence[str], within: Sequence[str]) -> W:
    return W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def bucket_counts(df: DataFrame, key: str, *within: str) -> DataFrame:
    """Rows per leading-digit bucket with the count of all earlier buckets.

    At most 65,536 rows per ``within`` group, however large ``df`` is.
    """
    counts = df.groupBy(*within, _bucket(F.col(key)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("size")
    )
    return counts.withColumn(
        "before", F.coalesce(F.sum("size").over(_earlier(["bucket"], within)), F.lit(0))
    )


def seeded_ordinal(
    df: DataFrame, key: str, ids: Sequence[str], *within: str, groups: int = 1, below: Column | None = None
) -> DataFrame:
    """Add ``ordinal``: the row's 0-based place in ``key`` order in its group.

    ``key`` must be a :func:`seeded_key`, ``ids`` break ties. ``groups`` is the
    number of ``within`` groups; it bounds the table that is broadcast. With ``below``
    rows of buckets that begin at that place or later are left out before they are
    ranked; the last bucket still comes whole.
    """
    counts = bucket_counts(df, key, *within).drop("size")
    if groups * _BUCKETS <= _BROADCAST_ROWS:
        counts = F.broadcast(counts)
    placed = df.withColumn("bucket", _bucket(F.col(key))).join(counts, [*within, "bucket"])
    if below is not None:
        placed = placed.filter(F.col("before") < below)
    local = F.row_number().over(W.partitionBy(*within, "bucket").orderBy(key, *ids))
    return placed.withColumn("ordinal", local + F.col("before") - 1).drop("bucket", "before")


def seeded_cut(df: DataFrame, key: str, id_column: str, wanted: Column) -> DataFrame:
    """One row ``cut`` (key, id): the last of the ``wanted`` smallest keys.

    ``wanted`` may refer to ``n``, the number of rows. Empty when it is 0.
    Only the rows of the one bucket that holds the cut are ranked.
    """
    counts = bucket_counts(df, key).withColumn("n", F.sum("size").over(W.partitionBy()))
    holder = counts.withColumn("wanted", wanted).filter(
        (F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("size"))
    )
    place = F.row_number().over(W.partitionBy("bucket").orderBy(key, id_column))
    return (
        df.select(key, id_column, _bucket(F.col(key)).alias("bucket"))
        .join(F.broadcast(holder), "bucket")
        .withColumn("place", place + F.col("before"))
        .filter(F.col("place") == F.col("wanted"))
        .select(F.struct(F.col(key).alias("key"), F.col(id_column).alias("id")).alias("cut"))
    )


def running_total(
    df: DataFrame, value: str, order: Sequence[str], *within: str, name: str = "before"
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the ``within`` group.

    Rows are laid out once by range of (group, order), so a group with most of
    the rows still spreads over many tasks, and written with the number of their
    range. Pass narrow rows.
    """
    ranged = materialize(
        df.repartitionByRange(*within, *order).withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    local = F.sum(value).over(_earlier(order, [*within, "part"]))
    totals = ranged.groupBy(*within, "part").agg(F.sum(value).alias("total"))
    offsets = totals.withColumn("offset", F.sum("total").over(_earlier(["part"], within))).drop("total")
    return (
        ranged.withColumn(name, F.coalesce(local, F.lit(0)))
        .join(offsets, [*within, "part"])
        .withColumn(name, F.col(name) + F.coalesce(F.col("offset"), F.lit(0)))
        .drop("part", "offset")
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Turn ``block`` and ``position`` of written lines into 1-based line numbers.

    ``lines`` is read twice and must give the same rows both times, so pass a written
    table. A line whose block was not counted fails the job.

    The line text is not shuffled: one row per file block is counted, written,
    and its first line number joined back. The table is broadcast while its row
    count is within the bound, with the path as a hash once that is known to be
    unique; beyond the bound the join shuffles.
    """
    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("size"), F.min("position").alias("first")
    )
    earlier = F.coalesce(F.sum("size").over(_earlier(["block"], ["file"])), F.lit(0))
    starts = materialize(
        blocks.select("file", "block", (earlier - F.col("first") + 1).alias("shift")), "blocks"
    )
    found = starts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("file").alias("files"),
        F.count_distinct(F.xxhash64("file")).alias("hashes"),
    ).first()
    if found["rows"] <= _BROADCAST_BLOCKS and found["files"] == found["hashes"]:
        short = starts.select(F.xxhash64("file").alias("file_key"), "block", "shift")
        keyed = lines.withColumn("file_key", F.xxhash64("file"))
        joined = keyed.join(F.broadcast(short), ["file_key", "block"], "left").drop("file_key")
    else:
        joined = lines.join(starts, ["file", "block"], "left")
    unknown = F.raise_error(F.concat_ws(" ", F.lit("no count for block"), "block", F.lit("of"), "file")).cast("bigint")
    return joined.withColumn("ordinal", F.coalesce(F.col("position") + F.col("shift"), unknown)).drop("shift")
