"""Token blocks of a stream of examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.session import materialize


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of a range partition with its number, and how many slots of the shard are before
    them in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, filled = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            starts = np.zeros(len(names), np.int64)
            for i, (own, size) in enumerate(zip(names, sizes.tolist(), strict=True)):
                if own != shard:
                    shard, filled = own, 0
                starts[i] = filled
                filled += size
            columns = [*batch.columns, pa.array(np.full(len(names), part)), pa.array(starts)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "local"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("local", T.LongType())])
    return rows.mapInArrow(run, schema)


def _pieces(start: int, size: int, block_size: int) -> np.ndarray:
    """Bounds in a run of ``size`` slots that begins at ``start``: its ends and the block borders."""
    first = (start // block_size + 1) * block_size
    return np.unique(np.concatenate(([0], np.arange(first, start + size, block_size) - start, [size])))


def _cut(rows: DataFrame, block_size: int) -> DataFrame:
    """``shard, block, at, tokens``: whole blocks, and the pieces of those that reach over the
    border of a range. ``at`` is a piece's place in its block.

    Rows that follow each other in the stream are cut together; an open tail is handed on to
    the next batch of the task.
    """
    list_type = rows.schema["tokens"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, open_at, tail, kind = None, 0, None, None

        def piece_rows(shard, start: int, bounds: np.ndarray, values: pa.Array) -> pa.RecordBatch:
            places = start + bounds[:-1]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
            columns = [pa.array([shard] * len(places), kind), pa.array(places // block_size), pa.array(places % block_size), lists]
            return pa.RecordBatch.from_arrays(columns, ["shard", "block", "at", "tokens"])

        for batch in batches:
            kind = batch.column(0).type
            shards, starts, tokens = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            labels = shards.to_pylist()
            follows = [i > 0 and labels[i] == labels[i - 1] and starts[i] == starts[i - 1] + sizes[i - 1] for i in range(len(labels))]
            heads = [i for i, f in enumerate(follows) if not f]
            for head, after in zip(heads, [*heads[1:], len(labels)], strict=True):
                shard, start = labels[head], int(starts[head])
                values = tokens.slice(head, after - head).flatten()
                if tail is not None:
                    if shard == open_shard and start == open_at + len(tail):
                        values, start = pa.concat_arrays([tail, values]), open_at
                    else:
                        yield piece_rows(open_shard, open_at, np.array([0, len(tail)]), tail)
                bounds = _pieces(start, len(values), block_size)
                # The last piece may go on in what follows.
                if len(bounds) > 2:
                    yield piece_rows(shard, start, bounds[:-1], values)
                open_shard, open_at, tail = shard, start + int(bounds[-2]), values.slice(int(bounds[-2]))
        if tail is not None:
            yield piece_rows(open_shard, open_at, np.array([0, len(tail)]), tail)

    schema = T.StructType().add("shard", rows.schema["shard"].dataType).add("block", T.LongType()).add("at", T.LongType()).add("tokens", list_type)
    return rows.select("shard", "start", "tokens").mapInArrow(run, schema)


def packed_tokens(examples: DataFrame, key: str, block_size: int, *, shard: str = "shard", tokens: str = "tokens", separator="<eos>") -> DataFrame:
    """``shard, block, tokens``: the examples of each shard end to end, in order of ``key`` and
    each followed by ``separator``, cut into blocks. The last block of a shard may be shorter.

    ``tokens`` is an array; null counts as empty. ``key`` is unique in a shard. Examples are
    laid out by range of (shard, key), so a shard with most of the rows is spread over many
    tasks, and written once. Of each range at most two pieces, its first and its last, are
    sent on to be put together with those of its neighbours; whole blocks stay where they are.
    """
    array = examples.schema[tokens].dataType
    item = array.elementType
    closed = F.concat(F.coalesce(F.col(tokens), F.array().cast(array)), F.array(F.lit(separator).cast(item)))
    ranged = examples.select(F.col(shard).alias("shard"), closed.alias("tokens"), F.col(key).alias("key"))
    ranged = ranged.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    laid = materialize(_numbered(ranged), "laid-out")
    sizes = laid.groupBy("shard", "part").agg(F.sum(F.size("tokens")).alias("slots"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("shard").alias("_shard"), F.col("part").alias("_part"), F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("offset"))
    # A row for each shard and range; written, so that its size decides the join.
    offsets = materialize(offsets, "offsets")
    placed = laid.join(offsets, (F.col("part") == F.col("_part")) & F.col("shard").eqNullSafe(F.col("_shard")))
    placed = placed.select("shard", (F.col("offset") + F.col("local")).alias("start"), "tokens").sortWithinPartitions("shard", "start")
    cut = materialize(_cut(placed, block_size), "cut")
    whole = cut.filter(F.size("tokens") == block_size).select("shard", "block", "tokens")
    pieces = cut.filter(F.size("tokens") < block_size).groupBy("shard", "block").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("p"))
    return whole.union(pieces.select("shard", "block", F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens")))
