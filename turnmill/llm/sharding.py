"""Contiguous sharding with the smallest possible largest shard.

Documents of equal text form one atomic group; groups are ordered by the SHA-256
of their text, so a shard is a range of digests. The smallest feasible capacity
is found by binary search with a greedy check, on sums per digest prefix: at most
65,536 sums come to the driver first, then only the prefixes in which a cut can
still fall are split further, 256-fold a round, until lower and upper bound of
the capacity meet. No global sort, and no join: a document finds its shard by
comparing its digest with the cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.llm.common import repeated, whole
from turnmill.session import materialize

_FIRST_DIGITS = 4
_NEXT_DIGITS = 2
_KEY_DIGITS = 64
# Greater than every hexadecimal digest.
_BEYOND = "g"
# Rows that get their slots in one task.
_ROWS_A_BUCKET = 20_000
_MIN_BUCKETS = 8


@dataclass(frozen=True)
class ShardPlan:
    """``cuts[j]`` is the first key of shard ``j + 1``; no shard exceeds ``capacity``."""

    capacity: int
    cuts: tuple[str, ...]

    def shard(self, key: Column) -> Column:
        number = F.lit(0)
        for cut in self.cuts:
            number = number + (key >= F.lit(cut)).cast("int")
        return number.cast("int")


@dataclass(frozen=True)
class _Segments:
    """Runs of groups in key order: first key, bytes, and whether it is one group."""

    first: np.ndarray
    last: np.ndarray
    size: np.ndarray
    digits: np.ndarray

    @property
    def atomic(self) -> np.ndarray:
        return self.first == self.last

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def _known_cuts(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Greedy cuts at known group boundaries only, or None if they don't suffice."""
    cuts, at, total = [], 0, int(ends[-1])
    for _ in range(shards):
        if at == total:
            break
        place = int(np.searchsorted(ends, at + capacity, side="right")) - 1
        if place < 0 or ends[place] <= at:
            return None
        at = int(ends[place])
        cuts.append(at)
    return np.array(cuts) if at == total else None


def _free_cuts(ends: np.ndarray, atomic: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts if a run of several groups could be cut anywhere: a lower bound."""
    cuts, at, total = [], 0, int(ends[-1])
    for _ in range(shards):
        target = at + capacity
        if target >= total:
            return [*cuts, total]
        place = int(np.searchsorted(ends, target, side="right"))
        start = int(ends[place - 1]) if place else 0
        if atomic[place]:
            if start <= at:
                return None
            target = start
        at = target
        cuts.append(at)
    return cuts if at >= total else None


def _smallest(feasible: Callable[[int], bool], low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle + 1
    return low


def _bounds(seg: _Segments, shards: int) -> tuple[int, int]:
    ends, atomic, total = seg.ends, seg.atomic, int(seg.size.sum())
    high = _smallest(lambda c: _known_cuts(ends, c, shards) is not None, -(-total // shards), total)
    low = _smallest(lambda c: _free_cuts(ends, atomic, c, shards) is not None, -(-total // shards), high)
    return low, high


def _uncertain(seg: _Segments, low: int, high: int, shards: int) -> np.ndarray:
    """Runs of several groups in which a greedy cut may fall for a capacity in low..high."""
    ends = seg.ends
    starts = ends - seg.size
    found = np.zeros(len(ends), bool)
    least = most = 0
    total = int(ends[-1])
    for _ in range(shards):
        place = int(np.searchsorted(ends, min(least + low, total), side="right"))
        least = max(least, int(ends[place - 1]) if place else 0)
        most = min(most + high, total)
        found |= (ends > least) & (starts < most)
    return found & ~seg.atomic


def _collect(sums: DataFrame, digits: int) -> _Segments:
    rows = sorted(sums.collect(), key=lambda r: r["first"])
    return _Segments(
        np.array([r["first"] for r in rows], dtype=object),
        np.array([r["last"] for r in rows], dtype=object),
        np.array([r["size"] for r in rows], dtype=np.int64),
        np.full(len(rows), digits),
    )


def _sums(sized: DataFrame, digits: int) -> DataFrame:
    return sized.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.sum("size").cast("long").alias("size"), F.min("key").alias("first"), F.max("key").alias("last")
    )


def _refined(sized: DataFrame, seg: _Segments, chosen: np.ndarray) -> _Segments:
    """Split the chosen runs by further digits of the key."""
    parts = [_Segments(*(getattr(seg, n)[~chosen] for n in ("first", "last", "size", "digits")))]
    for depth in np.unique(seg.digits[chosen]):
        own = chosen & (seg.digits == depth)
        digits = min(int(depth) + _NEXT_DIGITS, _KEY_DIGITS)
        prefixes = [str(k)[: int(depth)] for k in seg.first[own]]
        rows = sized.filter(F.substring("key", 1, int(depth)).isin(prefixes))
        parts.append(_collect(_sums(rows, digits), digits))
    joined = [np.concatenate([getattr(p, n) for p in parts]) for n in ("first", "last", "size", "digits")]
    order = np.argsort(joined[0].astype(str), kind="stable")
    return _Segments(*(a[order] for a in joined))


def _even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Of all cuts within the capacity, those nearest to equal shares of what is left."""
    total = int(ends[-1])
    furthest, at = [], 0
    for _ in range(shards - 1):
        at = int(ends[np.searchsorted(ends, at + capacity, side="right") - 1]) if at < total else total
        furthest.append(at)
    bounds = np.concatenate(([0], ends))
    nearest, at = [], total
    for _ in range(shards - 1):
        at = int(bounds[np.searchsorted(bounds, at - capacity, side="left")]) if at > 0 else 0
        nearest.append(at)
    cuts, at = [], 0
    for j in range(shards - 1):
        low = max(nearest[shards - 2 - j], at)
        high = min(furthest[j], at + capacity)
        share = at + (total - at) / (shards - j)
        place = int(np.searchsorted(bounds, share))
        options = [int(b) for b in bounds[max(place - 1, 0) : place + 1]]
        wanted = min(options, key=lambda b: (abs(b - share), b))
        if wanted > high:
            wanted = int(bounds[np.searchsorted(bounds, high, side="right") - 1])
        if wanted < low:
            wanted = int(bounds[np.searchsorted(bounds, low, side="left")])
        at = wanted
        cuts.append(at)
    return cuts


def plan_shards(sized: DataFrame, shards: int) -> ShardPlan:
    """The minimax plan for rows ``key`` (hexadecimal digest) and ``size``.

    ``sized`` is read once a round, three rounds for ten billion groups. An empty
    table gets empty shards; with fewer groups than shards some stay empty; a
    group larger than its share makes the capacity.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    seg = _collect(_sums(sized, _FIRST_DIGITS), _FIRST_DIGITS)
    if not len(seg.size):
        return ShardPlan(0, (_BEYOND,) * (shards - 1))
    low, high = _bounds(seg, shards)
    while low < high and (chosen := _uncertain(seg, low, high, shards)).any():
        seg = _refined(sized, seg, chosen)
        low, high = _bounds(seg, shards)
    ends = seg.ends
    firsts = [*seg.first, _BEYOND]
    # A cut after a run is the first key of the next one.
    cuts = [firsts[int(np.searchsorted(ends, c, side="right"))] for c in _even_cuts(ends, high, shards)]
    return ShardPlan(high, tuple(str(c) for c in cuts))


def group_key(text: str = "text") -> Column:
    return F.sha2(whole(F.col(text)).cast("binary"), 256)


def sized_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (id, text), with the number of ``copies``; ``size`` is
    the UTF-8 bytes of the text plus 1, of one copy. A null text counts as empty."""
    body = whole(F.col(text))
    rows = docs.select(
        F.col(id_column).alias("id"),
        group_key(text).alias("key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    return repeated(rows, "id", "key", "size", "text_crc32")


def minimax_shards(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows ``id, key, size, text_crc32, shard, slot``, one per row of ``docs``.

    Equal texts share a shard; shards are contiguous in ``key`` and the largest is
    as small as that allows. ``slot`` numbers a shard's rows from 0 without gaps,
    by hash bucket, then id and key. Null ids sort first; equal rows get
    neighbouring slots. Columns of ``docs`` besides id and text are not read.
    """
    sized = materialize(sized_documents(docs, id_column, text), "sized")
    totals = sized.select("key", (F.col("size") * F.col("copies")).alias("size"))
    plan = plan_shards(totals, shards)
    placed = sized.withColumn("shard", plan.shard(F.col("key")))
    rows = sized.agg(F.sum("copies")).first()[0] or 0
    buckets = max(_MIN_BUCKETS, -(-rows // (shards * _ROWS_A_BUCKET)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "key"), F.lit(buckets)))
    earlier = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    before = W.partitionBy("shard", "bucket").orderBy("id", "key").rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .join(offsets, ["shard", "bucket"])
        .withColumn("start", F.col("before") + F.col("offset"))
        .withColumn("slot", F.explode(F.sequence("start", F.col("start") + F.col("copies") - 1)))
        .select("id", "key", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text") -> ShardPlan:
    """Write ``docs`` whole, as Parquet folders ``shard=0`` onward below ``path``."""
    sized = materialize(sized_documents(docs.withColumn("_none", F.lit(0)), "_none", text), "sized")
    plan = plan_shards(sized.select("key", (F.col("size") * F.col("copies")).alias("size")), shards)
    docs.withColumn("shard", plan.shard(group_key(text))).write.partitionBy("shard").parquet(path)
    return plan
