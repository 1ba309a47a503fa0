"""Exact n-gram Jaccard join with a token-group matrix.

A document is its set of distinct word shingles, as 64-bit hashes; equal sets are
one node. The join finds, for every node, enough links to connect each pair of
nodes that are similar, without listing the pairs of a group:

1. Similar nodes are put into groups: nodes with the same least hash (under
   several hash functions) are compared with one of them, and those that are
   similar form a cluster. Nodes that are alike, with two equal least hashes, but
   were not linked form loose clusters. Shards of a cluster are groups of some tens
   of nodes, so that many nodes that are nearly similar to each other are not
   candidates pair by pair.
2. Candidates are pairs of clusters. Only tokens of prefixes are needed: two similar
   sets share one among the least ``n - ceil(t * n) + 1`` of each under any common
   order. Frequent tokens come last in that order, then the hash decides. The number
   of shared tokens bounds the overlap; pairs that can't reach the threshold are out.
3. Members of both clusters are compared first. Where they are not similar, every
   node of the smaller cluster is a query on the groups of the other. A group has a
   row in the token-group matrix, a bitmap of its token union; the query's tokens
   that are set in it bound the overlap, and only qualifying groups are opened. Queries
   come in groups too, so that two clusters meet in a row for each pair of groups.
4. Two nodes are compared by parity bitmaps first, whose distance bounds that of the
   sets from below, and then exactly.

Sets are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import in_few_tasks, own_memory, small_batches
from turnmill.llm.components import components
from turnmill.session import materialize

# Texts are cut into words so many at a time, or as many as have about so many bytes.
_ROWS_A_STEP = 256
_BYTES_A_STEP = 1 << 20
# Three hash functions put similar nodes into buckets.
_MINIMA = 3
# Tokens are counted within a task in lots of this many. From 32 MB on, glibc gives memory
# back to the system as soon as it is freed, so a worker that is used again doesn't keep it.
_TOKENS_A_LOT = 1 << 22
# A token in so many documents goes to the end of the order, up to so many tokens
# (the most frequent ones). The order affects cost only, never the result.
_FREQUENT = 64
_MAX_FREQUENT = 500_000
_GROUP_NODES = 32
_GROUP_TOKENS = 1 << 17
# Id tables of at most so many rows are broadcast (about 100 MB); larger ones are
# joined by shuffle.
_BROADCAST_ROWS = 2_000_000
_PAIRS_A_STEP = 200_000
# Rows with a node's tokens are in few tasks if these are so many a task at least.
_TOKENS_A_TASK = 1 << 20
# Pairs whose sets are compared are in few tasks of so many at least.
_PAIRS_A_TASK = 5_000
# Rows whose pairs are made at once, but for tokens in more units than the second number.
_ROWS_AT_ONCE = 20_000
_UNITS_AT_ONCE = 64

_U64 = np.uint64
# Odd multipliers that combine the hashes of a shingle's words, made from a seed.
_FACTORS = np.random.Generator(np.random.Philox(key=[1, 0])).integers(1, 1 << 63, 64, dtype=np.uint64) | _U64(1)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + _U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, few enough at a time; texts are in its second column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        size = _BYTES_A_STEP + (int(ends[at - 1]) if at else 0)
        end = max(at + 1, min(at + _ROWS_A_STEP, int(np.searchsorted(ends, size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def _hashes(words: pa.Array) -> np.ndarray:
    """The hash of each word."""
    words = words.cast(pa.large_binary())
    _, bounds, data = words.buffers()
    bounds = np.frombuffer(bounds, np.int64)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    data = data.to_pybytes() if data else b""
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in pairwise(bounds)), _U64, len(words))


def shingle_sets(texts: pa.Array, words_each: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each whole text, one set behind the other,
    and where the sets begin, with the end of the last.

    A-Z are lower-cased, words end at ASCII white space. A text of fewer words is
    one shingle; without words the set is empty.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    # White space at either end of a text leaves an empty word there.
    real = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    at = lists.offsets.to_numpy()
    at = before[at - at[0]]
    coded = words.filter(real).dictionary_encode()
    hashes = _hashes(coded.dictionary)[coded.indices.to_numpy()]
    total = np.zeros(max(len(hashes) - words_each + 1, 0), _U64)
    for k in range(words_each):
        total += hashes[k : len(total) + k] * _FACTORS[k]
    total = _mix(total)
    counts = np.diff(at)
    sizes = np.where(counts < words_each, np.minimum(counts, 1), counts - words_each + 1)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    tokens = np.empty(starts[-1], _U64)
    for n, first, start, end in zip(counts.tolist(), at.tolist(), starts.tolist(), starts[1:].tolist(), strict=False):
        own = tokens[start:end]
        if n >= words_each:
            own[:] = total[first : first + end - start]
            own.sort()
        elif n:
            own[:] = _mix((hashes[first : first + n] * _FACTORS[:n]).sum(keepdims=True) + _U64(n))
    new = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    new[starts[:-1][sizes > 0]] = True
    return tokens[new], np.concatenate(([0], np.cumsum(new)))[starts]


def node_of(tokens: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.int64(_U64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def _ceil(a, b):
    return -(-a // b)


class Threshold:
    """Similarity of at least ``part / whole`` in whole numbers."""

    def __init__(self, part: int = 75, whole: int = 100):
        self.part, self.whole = part, whole

    def overlap(self, a, b):
        """Least common tokens of similar sets of these sizes."""
        return _ceil(self.part * (a + b), self.part + self.whole)

    def prefix(self, n):
        return n - _ceil(self.part * n, self.whole) + 1

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.whole * min(len(a), len(b)) < self.part * max(len(a), len(b)):
            return False
        common = len(a) + len(b) - len(np.union1d(a, b))
        return common >= self.overlap(len(a), len(b))


def _power(n: int) -> int:
    return 1 << max(n - 1, 1).bit_length()


def sketch(tokens: np.ndarray) -> bytes:
    """The size of a set, and the parity of its tokens in each of some 4 n cells."""
    cells = 4 * _power(len(tokens))
    odd = np.bincount((tokens & _U64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return len(tokens).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def least_distance(a: bytes, b: bytes, at: Threshold) -> int | None:
    """A lower bound of the tokens in which the sets of two sketches differ; None if
    they can't be similar. Each cell in which the parities differ holds a token that
    only one of the sets has."""
    sizes = int.from_bytes(a[:4], "little"), int.from_bytes(b[:4], "little")
    if at.whole * min(sizes) < at.part * max(sizes):
        return None
    x, y = np.frombuffer(a, np.uint8, offset=4), np.frombuffer(b, np.uint8, offset=4)
    if len(x) < len(y):
        x, y = y, x
    # The larger bitmap folded is the bitmap of its set with fewer cells.
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    apart = int(np.bitwise_count(folded ^ y).sum())
    return apart if apart <= sum(sizes) - 2 * at.overlap(*sizes) else None


def union_bitmap(sets: list[np.ndarray]) -> bytes:
    """A group's row of the token-group matrix: the cells that its tokens fall into."""
    tokens = np.unique(np.concatenate(sets))
    cells = 16 * _power(len(tokens))
    bits = np.zeros(cells, np.uint8)
    bits[(tokens & _U64(cells - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def overlap_bound(tokens: np.ndarray, bitmap: bytes) -> int:
    """At least as many as the query's tokens that are in the group's union."""
    place = (tokens & _U64(8 * len(bitmap) - 1)).astype(np.int64)
    return int((np.frombuffer(bitmap, np.uint8)[place >> 3] >> (7 - (place & 7)) & 1).sum())


def _arrow(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return small_batches(docs).select(F.col(id_column).cast("long").alias("id"), body.alias("text"), F.md5(body).alias("key"))


def repeated_tokens(lot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that are in several of the sets, ascending, and in how many. The list is
    emptied, and its tokens are sorted where they are, since a task holds millions of them."""
    tokens = lot[0] if len(lot) == 1 else np.concatenate(lot)
    lot.clear()
    tokens.sort()
    same = np.zeros(len(tokens) + 1, bool)
    np.equal(tokens[1:], tokens[:-1], out=same[1:-1])
    # Runs of two or more begin where the next is the same and the one before is not.
    first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    return tokens[first], last - first + 1


class Size(NamedTuple):
    """How many rows tables have at most: documents, their tokens, and tokens that tasks repeat."""

    docs: int
    tokens: int
    repeated: int


def _size(profiles: DataFrame) -> Size:
    row = profiles.agg(F.count("n"), F.sum("n"), F.sum(F.when(F.col("n").isNull(), F.size("tokens").cast("long")))).first()
    return Size(*(x or 0 for x in row))


def _profiles(docs: DataFrame, words_each: int) -> DataFrame:
    """For each document its node, size and least hashes; then, with a null size,
    tokens that repeat within a task with the number of documents they are in."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.string()), ("node", pa.int64()), ("n", pa.int32()), ("minima", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])

    def counted(lot: np.ndarray) -> pa.RecordBatch:
        tokens, counts = repeated_tokens([lot])
        return _arrow([[None], [None], [None], [None], [None], [tokens.view(np.int64)], [counts.astype(np.int32)]], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, size, seen = np.empty(_TOKENS_A_LOT, _U64), 0, set()
        for batch in batches:
            for part in _steps(batch):
                tokens, bounds = shingle_sets(part.column(1), words_each)
                sizes = np.diff(bounds)
                some = sizes > 0
                least = [np.minimum.reduceat(_mix(tokens, k), bounds[:-1][some]).view(np.int64) for k in range(1, _MINIMA + 1)] if some.any() else []
                minima = iter(np.stack(least, 1).tolist() if least else [])
                nodes = []
                for start, end in pairwise(bounds.tolist()):
                    own = tokens[start:end]
                    nodes.append(node_of(own) if len(own) else None)
                    # A set that no lot has room for is left out: it repeats no token in itself.
                    if len(own) and nodes[-1] not in seen and len(own) <= len(lot):
                        seen.add(nodes[-1])
                        if size + len(own) > len(lot):
                            yield counted(lot[:size])
                            size = 0
                        lot[size : size + len(own)] = own
                        size += len(own)
                none = [None] * len(nodes)
                yield _arrow([part.column(0), part.column(2), nodes, sizes, [next(minima) if n else None for n in sizes], none, none], schema)
        if size:
            yield counted(lot[:size])

    return docs.mapInArrow(own_memory(run), "id long, key string, node long, n int, minima array<long>, tokens array<long>, counts array<int>")


def _frequent(profiles: DataFrame, rows: int) -> np.ndarray:
    """The tokens that go last in the order; at most ``_MAX_FREQUENT`` numbers. ``rows``: how many
    tokens the profiles name."""
    counted = (
        profiles.filter("n is null")
        .select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
        .groupBy(F.col("t.tokens").alias("token"))
        .agg(F.sum("t.counts").alias("df"))
    )
    found = in_few_tasks(counted.filter(F.col("df") >= _FREQUENT), rows).orderBy(F.desc("df"), "token").limit(_MAX_FREQUENT)
    return np.sort(np.array([r[0] for r in found.select("token").collect()], np.int64).view(_U64))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A written table of ``rows`` at most, marked for broadcast if it has few enough."""
    df = materialize(in_few_tasks(df, rows), "ids")
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def _sets(docs: DataFrame, profiles: DataFrame, nodes: DataFrame, words_each: int, size: Size) -> DataFrame:
    """``node, tokens, sketch`` of the given nodes, from the texts of one of their
    documents in each task at most."""
    wanted = _small(nodes.distinct(), size.docs)
    chosen = profiles.filter("n > 0").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    ids = _small(chosen.select("id"), size.docs)
    # Documents without an id can't be chosen by it, so all of them are read.
    texts = docs.join(ids, "id", "left_semi").union(docs.filter("id is null"))
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in _steps(batch):
                nodes, packed, sketches = [], [], []
                tokens, bounds = shingle_sets(part.column(1), words_each)
                for start, end in pairwise(bounds.tolist()):
                    own = tokens[start:end]
                    if len(own) and (node := node_of(own)) not in seen:
                        seen.add(node)
                        nodes.append(node)
                        packed.append(own.tobytes())
                        sketches.append(sketch(own))
                yield _arrow([nodes, packed, sketches], schema)

    made = texts.mapInArrow(own_memory(run), "node long, tokens binary, sketch binary").join(wanted, "node", "left_semi")
    one = made.groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    return materialize(in_few_tasks(one, size.tokens, _TOKENS_A_TASK), "sets")


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``a, b`` with that column of both nodes as ``s`` and ``t``."""
    a = sets.select(F.col("node").alias("a"), F.col(column).alias("s"))
    b = sets.select(F.col("node").alias("b"), F.col(column).alias("t"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "s", "t")


def _verified(pairs: DataFrame, sets: DataFrame, at: Threshold, rows: int) -> DataFrame:
    """The pairs ``a, b``, ``rows`` at most, whose sets are similar: by sketch first, then exactly."""

    def kept(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [test(s, t) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return own_memory(run)

    likely = in_few_tasks(_both(pairs, sets, "sketch"), rows, _PAIRS_A_TASK).mapInArrow(kept(lambda s, t: least_distance(s, t, at) is not None), "a long, b long")
    same = lambda s, t: at.similar(np.frombuffer(s, _U64), np.frombuffer(t, _U64))
    return in_few_tasks(_both(likely, sets, "tokens"), rows, _PAIRS_A_TASK).mapInArrow(kept(same), "a long, b long")


def _clusters(docs: DataFrame, profiles: DataFrame, words_each: int, at: Threshold) -> tuple[DataFrame, DataFrame]:
    """Links found by comparing the nodes of a bucket with the least of them, and
    ``node, n, cluster, lo, hi, part, loose`` of the nodes that these connect; then of nodes
    that are only alike, in loose clusters whose nodes need not be similar."""
    size = _size(profiles)
    few = lambda df, times=1: in_few_tasks(df, times * size.docs)
    sizes = profiles.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("minima").alias("minima"))
    sizes = materialize(few(sizes), "sizes")
    keyed = sizes.select("node", "n", F.posexplode("minima").alias("k", "key"))
    # Aggregates are written before they are joined back, so that hot keys can be split.
    buckets = keyed.groupBy("k", "key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    buckets = materialize(few(buckets, _MINIMA), "buckets")
    pairs = few(keyed.join(buckets, ["k", "key"]), _MINIMA).filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    pairs = materialize(few(pairs, _MINIMA), "bucket-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    links = materialize(_verified(pairs, _sets(docs, profiles, nodes, words_each, size), at, pairs.count()), "bucket-links")
    labels = materialize(components(links, rows=links.count()), "clusters")
    known = sizes.select("node", "n").join(labels, "node").withColumnRenamed("label", "cluster")
    known = materialize(few(known), "cluster-nodes")
    spans = few(known.groupBy("cluster").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("nodes")))
    tight = few(known.join(spans, "cluster")).withColumn("loose", F.lit(False))
    # Nodes that were linked to none, but share two least hashes and are of like size.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(at.whole / at.part, 1.05))))
    lone = sizes.join(labels, "node", "left_anti").select("node", "n", F.col("minima")[0].alias("m0"), F.col("minima")[1].alias("m1"), size_class.alias("size_class"))
    lone = materialize(few(lone), "lone-nodes")
    like = ["m0", "m1", "size_class"]
    found = lone.groupBy(*like).agg(F.min("node").alias("cluster"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("nodes"))
    found = materialize(few(found.filter("nodes > 1")), "loose-groups")
    loose = few(lone.join(found, like)).withColumn("loose", F.lit(True))
    # Groups of large sets have fewer nodes.
    each = F.greatest(F.least(F.lit(_GROUP_NODES), F.floor(F.lit(_GROUP_TOKENS) / F.col("hi"))), F.lit(1))
    group = F.pmod(F.xxhash64("node"), F.ceil(F.col("nodes") / each)).cast("int")
    columns = ["node", "n", "cluster", "lo", "hi", group.alias("part"), "loose"]
    return links, tight.select(*columns).union(loose.select(*columns))


def _prefixes(docs: DataFrame, frequent: np.ndarray, words_each: int, at: Threshold) -> DataFrame:
    """``node, n, prefix`` of every document, equal sets once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = shared.value, set()
        for batch in batches:
            for part in _steps(batch):
                nodes, sizes, prefixes = [], [], []
                tokens, bounds = shingle_sets(part.column(1), words_each)
                for start, end in pairwise(bounds.tolist()):
                    own = tokens[start:end]
                    if not len(own) or (node := node_of(own)) in seen:
                        continue
                    seen.add(node)
                    if len(last):
                        often = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                        own = np.concatenate((own[~often], own[often]))
                    nodes.append(node)
                    sizes.append(len(own))
                    prefixes.append(own[: at.prefix(len(own))].view(np.int64))
                ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *prefixes]))
                yield _arrow([nodes, sizes, lists], schema)

    return docs.mapInArrow(own_memory(run), "node long, n int, prefix array<long>")


def run_pairs(columns: list[np.ndarray], at: Threshold) -> Iterator[list[np.ndarray]]:
    """Pairs of different units that share a token and whose sizes can be similar, as columns
    unit, unit, lo, lo, hi, hi. ``columns``: token, unit, lo, hi, with equal tokens together."""
    token = columns[0]
    if not len(token):
        return
    same = token[1:] == token[:-1]
    several = np.append(same, False) | np.append(False, same)
    token, unit, lo, hi = (c[several] for c in columns)
    order = np.lexsort((unit, lo, token))
    token, unit = token[order], unit[order]
    new = np.append(True, token[1:] != token[:-1])[: len(token)]
    once = new.copy()
    once[1:] |= unit[1:] != unit[:-1]
    # Of a token's units later ones are at least as large; beyond the limit none is similar.
    token, unit, lo, hi = token[once], unit[once], lo[order][once].astype(np.int64), hi[order][once].astype(np.int64)
    limit = hi * at.whole // at.part
    starts = np.flatnonzero(new[once])
    sizes = np.diff(np.append(starts, len(token)))
    made = lambda i, j: [c[k] for c in (unit, lo, hi) for k in (i, j)]
    ends = np.repeat(starts + sizes, sizes)
    i, step = np.flatnonzero(np.repeat(sizes <= _UNITS_AT_ONCE, sizes)), 0
    while len(i):
        step += 1
        i = i[i + step < ends[i]]
        i = i[lo[i + step] <= limit[i]]
        if len(i):
            yield made(i, i + step)
    for start, size in zip(starts[sizes > _UNITS_AT_ONCE].tolist(), sizes[sizes > _UNITS_AT_ONCE].tolist(), strict=True):
        own = slice(start, start + size)
        for k, end in enumerate((start + np.searchsorted(lo[own], limit[own], side="right")).tolist(), start):
            if end > k + 1:
                yield made(np.full(end - k - 1, k), np.arange(k + 1, end))


def _shared_tokens(rows: DataFrame, at: Threshold, size: Size) -> DataFrame:
    """``a, b`` (units) with the number of prefix tokens they share, for those pairs
    that can still reach the threshold. ``rows``: token, unit, lo, hi."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("lo_x", pa.int32()), ("lo_y", pa.int32()), ("hi_x", pa.int32()), ("hi_y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, _ROWS_AT_ONCE
        out, made = [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        def columns() -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*held, strict=True)]

        def lots() -> Iterator[list[np.ndarray]]:
            nonlocal held, rows, enough
            for batch in batches:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                rows += batch.num_rows
                if rows >= enough:
                    lot = columns()
                    # The last token may go on in the next batch.
                    cut = int(np.searchsorted(lot[0], lot[0][-1]))
                    held, rows = [[c[cut:] for c in lot]], rows - cut
                    enough = max(_ROWS_AT_ONCE, 2 * rows)
                    yield [c[:cut] for c in lot]
            if rows:
                yield columns()

        for lot in lots():
            for pairs in run_pairs(lot, at):
                out.append(pairs)
                made += len(pairs[0])
                if made >= _PAIRS_A_STEP:
                    yield full()
                    out, made = [], 0
        if out:
            yield full()

    together = in_few_tasks(rows.select("token", "unit", "lo", "hi").repartition("token"), size.tokens, _TOKENS_A_TASK)
    ordered = together.sortWithinPartitions("token")
    pairs = ordered.mapInArrow(own_memory(run), "x long, y long, lo_x int, lo_y int, hi_x int, hi_y int")
    counted = pairs.groupBy("x", "y", "lo_x", "lo_y", "hi_x", "hi_y").agg(F.count(F.lit(1)).alias("shared"))
    # What the sets have in common beyond the shared prefix tokens lies behind the
    # prefix of one of them.
    total = F.ceil((F.col("lo_x") + F.col("lo_y")) * at.part / (at.part + at.whole))
    behind = F.ceil(F.greatest("hi_x", "hi_y") * at.part / at.whole) - 1
    return counted.filter(F.col("shared") >= total - behind).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _matrix(members: DataFrame, sets: DataFrame, size: Size) -> DataFrame:
    """The token-group matrix: ``cluster, part, loose, bitmap`` of each group, with its ``nodes``
    and their ``sets`` and ``sketches``. ``members``: node, cluster, part, loose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [union_bitmap([np.frombuffer(t, _U64) for t in own]) for own in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], [*batch.schema.names, "bitmap"])

    lists = [F.collect_list(c).alias(n) for c, n in (("node", "nodes"), ("tokens", "sets"), ("sketch", "sketches"))]
    placed = in_few_tasks(members.join(sets, "node"), size.tokens, _TOKENS_A_TASK)
    groups = in_few_tasks(placed.groupBy("cluster", "part", "loose").agg(*lists), size.tokens, _TOKENS_A_TASK)
    schema = "cluster long, part int, loose boolean, nodes array<long>, sets array<binary>, sketches array<binary>, bitmap binary"
    return materialize(groups.mapInArrow(own_memory(run), schema), "matrix")


def least_distances(own: bytes, others: list[bytes], at: Threshold) -> list[tuple[int, int]]:
    """(distance, place) of those ``others`` that :func:`least_distance` gives one, nearest first."""
    by_size: dict[int, list[int]] = {}
    for i, other in enumerate(others):
        by_size.setdefault(len(other), []).append(i)
    size, x = int.from_bytes(own[:4], "little"), np.frombuffer(own, np.uint8, offset=4)
    found = []
    for length, places in by_size.items():
        packed = np.frombuffer(b"".join(others[i] for i in places), np.uint8).reshape(len(places), length)
        sizes = packed[:, :4].copy().view("<u4")[:, 0].astype(np.int64)
        y = packed[:, 4:]
        # The larger bitmap folded is the bitmap of its set with fewer cells.
        cells = min(len(x), length - 4)
        mine = np.bitwise_xor.reduce(x.reshape(-1, cells), axis=0)
        theirs = np.bitwise_xor.reduce(y.reshape(len(places), -1, cells), axis=1)
        apart = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
        fits = (apart <= size + sizes - 2 * at.overlap(size, sizes)) & (at.whole * np.minimum(size, sizes) >= at.part * np.maximum(size, sizes))
        found += [(int(apart[k]), places[k]) for k in np.flatnonzero(fits)]
    return sorted(found)


class _Parts:
    """Which nodes are connected, as far as is known."""

    def __init__(self, groups: list[tuple[list[int], bool]]):
        self.parent = {n: n for nodes, _ in groups for n in nodes}
        self.count = len(self.parent)
        for nodes, loose in groups:
            if not loose:
                for n in nodes[1:]:
                    self.join(nodes[0], n)

    def root(self, n: int) -> int:
        while self.parent[n] != n:
            self.parent[n] = n = self.parent[self.parent[n]]
        return n

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[a] = b
            self.count -= 1


def connecting_links(queries: tuple[list, list, list], group: tuple[list, list, list], bitmap: bytes, at: Threshold, loose: tuple[bool, bool]) -> list[tuple[int, int]]:
    """Links between the nodes of two groups (nodes, sets, sketches), so many that they connect
    whatever similar nodes connect. The nodes of a group that is not loose are connected
    already, so one link does for two of these. The groups may be the same one.

    Each node of the first is a query on the row of the matrix; the group is opened only to
    queries whose tokens may reach the overlap in its union."""
    known = _Parts([(queries[0], loose[0]), (group[0], loose[1])])
    out = []
    for node, packed, own in zip(*queries, strict=True):
        if known.count == 1:
            break
        tokens = np.frombuffer(packed, _U64)
        if at.whole * overlap_bound(tokens, bitmap) < at.part * len(tokens):
            continue
        for _, place in least_distances(own, group[2], at):
            other = group[0][place]
            if known.root(node) != known.root(other) and at.similar(tokens, np.frombuffer(group[1][place], _U64)):
                known.join(node, other)
                out.append((node, other))
    return out


def _opened(pairs: DataFrame, matrix: DataFrame, at: Threshold) -> DataFrame:
    """Links ``a, b`` (nodes) that connect the groups of cluster ``a`` with those of cluster
    ``b``, fewer for each pair of groups than these have nodes. A cluster may stand with itself."""
    columns = ["nodes", "sets", "sketches", "loose", "part"]
    side = lambda s, more: matrix.select(F.col("cluster").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns], *more)
    rows = pairs.select("a", "b").join(side("a", []), "a").join(side("b", ["bitmap"]), "b").filter("a != b OR a_part <= b_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for at_row in range(batch.num_rows):
                row = [c[at_row].as_py() for c in batch.columns]
                links += connecting_links(tuple(row[:3]), tuple(row[4:7]), row[8], at, (row[3], row[7]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.select(*[f"{s}_{c}" for s in "ab" for c in columns[:4]], "bitmap").mapInArrow(own_memory(run), "a long, b long")


def _joined(pairs: DataFrame, members: DataFrame, sets: DataFrame, near: DataFrame, at: Threshold, size: Size) -> DataFrame:
    """Components of the near links and of those between clusters: ``node, label``.

    Links between clusters are looked for in rounds, each only between clusters that
    earlier rounds did not connect: two members of each, then one group of each, then
    all groups of one with all groups of the other. Loose clusters are not connected in
    themselves, so all their groups are opened to each other and to their partners.
    """
    many = pairs.count()
    ends = members.groupBy("cluster").agg(
        F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("nodes"), F.bool_or("loose").alias("loose")
    )
    ends = materialize(in_few_tasks(ends, size.docs), "cluster-ends")
    named = lambda side: ends.select(*[F.col(c).alias(side if c == "cluster" else f"{side}_{c}") for c in ends.columns])
    paired = materialize(in_few_tasks(pairs.join(named("a"), "a").join(named("b"), "b"), many), "cluster-pairs")
    loose = paired.filter("a_loose OR b_loose").select("a", "b")
    loose = loose.union(ends.filter("loose").select(F.col("cluster").alias("a"), F.col("cluster").alias("b")))
    known = paired.filter("NOT a_loose AND NOT b_loose").drop("a_loose", "b_loose")
    several = (F.col("a_nodes") > 1) | (F.col("b_nodes") > 1)
    tried = known.select(F.col("a_least").alias("a"), F.col("b_least").alias("b")).union(known.filter(several).select("a_most", "b_most"))
    tried = in_few_tasks(tried.distinct(), 2 * many)
    labels = materialize(components(near.union(_verified(tried, sets, at, 2 * many)), rows=near.count() + 2 * many), "labels")
    side = lambda s: F.struct(F.col(s).alias("cluster"), F.col(f"{s}_least").alias("least"))
    ordered = F.when(F.col("a_nodes") <= F.col("b_nodes"), F.struct(side("a").alias("x"), side("b").alias("y"))).otherwise(
        F.struct(side("b").alias("x"), side("a").alias("y"))
    )
    left = known.filter(several).select(ordered.alias("p")).select(
        F.col("p.x.cluster").alias("a"), F.col("p.x.least").alias("a_least"), F.col("p.y.cluster").alias("b"), F.col("p.y.least").alias("b_least")
    )
    wanted = in_few_tasks(left.select("a", "b").union(loose).select(F.explode(F.array("a", "b")).alias("cluster")).distinct(), size.docs)
    matrix = _matrix(in_few_tasks(members.join(wanted, "cluster", "left_semi"), size.docs), sets, size)
    links = materialize(_opened(loose, matrix, at), "loose-links")
    labels = _relabelled(labels, links)
    least = matrix.groupBy("cluster").agg(F.min("part").alias("part"))
    for groups in (matrix.join(least, ["cluster", "part"], "left_semi"), matrix):
        of = lambda s: labels.select(F.col("node").alias(f"{s}_least"), F.col("label").alias(f"{s}_label"))  # noqa: B023, E731
        placed = left.join(of("a"), "a_least", "left").join(of("b"), "b_least", "left")
        apart = F.coalesce("a_label", "a_least") != F.coalesce("b_label", "b_least")
        left = materialize(in_few_tasks(placed.filter(apart).drop("a_label", "b_label"), many), "open-pairs")
        links = materialize(_opened(left, groups, at), "open-links")
        labels = _relabelled(labels, links)
    return labels


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` of the components of ``labels`` and further links together."""
    if links.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return materialize(components(known.union(links), rows=labels.count() + links.count()), "labels")


def jaccard_classes(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, words_each: int = 5, part: int = 75, whole: int = 100
) -> DataFrame:
    """Rows ``id, key, n_shingles, node, component_id``, one per row of ``docs``.

    Documents are linked when their sets of shingles have a Jaccard similarity of at
    least ``part / whole``; ``component_id`` is the smallest id reachable by links, the
    document's own included. Documents with equal sets share a ``node``. Those without
    words have an empty set, a null node and their own id. ``key`` is the MD5 of the
    text, ``first`` the (id, key) of the first document of the component. Null ids count only where
    a component has no other. Other columns are not read; an empty table gives no rows.
    """
    at = Threshold(part, whole)
    docs = _texts(docs, id_column, text)
    profiles = materialize(_profiles(docs, words_each), "profiles")
    size = _size(profiles)
    near, clustered = _clusters(docs, profiles, words_each, at)
    clustered = materialize(clustered, "groups")
    prefixes = _prefixes(docs, _frequent(profiles, size.repeated), words_each, at)
    units = _small(clustered.select("node", "cluster", "lo", "hi"), size.docs)
    rows = prefixes.join(units, "node", "left").select(
        F.explode("prefix").alias("token"),
        F.coalesce("cluster", "node").alias("unit"),
        F.coalesce("lo", "n").alias("lo"),
        F.coalesce("hi", "n").alias("hi"),
    )
    pairs = materialize(_shared_tokens(rows, at, size), "candidates")
    wanted = pairs.select(F.col("a").alias("cluster")).union(pairs.select("b")).union(clustered.filter("loose").select("cluster"))
    few = lambda df: in_few_tasks(df, size.docs)
    involved = materialize(few(wanted.distinct()), "involved")
    inside = few(clustered.select("node", "cluster", "part", "loose").join(involved, "cluster", "left_semi"))
    alone = few(involved.join(few(clustered.select("cluster").distinct()), "cluster", "left_anti"))
    members = inside.union(alone.select(F.col("cluster").alias("node"), "cluster", F.lit(0), F.lit(False)))
    members = materialize(members, "members")
    sets = _sets(docs, profiles, members.select("node"), words_each, size)
    labels = _joined(pairs, members, sets, near, at, size)
    labelled = few(profiles.filter("n is not null").select("id", "key", "node", "n").join(labels, "node", "left"))
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    least = labelled.filter("label is not null").groupBy("label").agg(
        F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")
    )
    least = materialize(few(least), "least")
    return few(labelled.join(least, "label", "left")).select(
        "id", "key", F.col("n").cast("long").alias("n_shingles"), "node",
        F.coalesce("least", "id").alias("component_id"), F.struct("first.id", "first.key").alias("first"),
    )


def first_of_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each class.

    First is the smallest id, then the smallest MD5 of the text; of rows that are
    equal in both one stays. Documents without words all stay. ``options`` as in
    :func:`jaccard_classes`.
    """
    classes = jaccard_classes(docs, id_column, text, **options).filter("node is not null")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & F.col("key").eqNullSafe(F.col("first.key"))
    found = materialize(classes.select(F.col("id").alias("_id"), F.col("key").alias("_key"), stays.alias("stays")), "classes")
    many = found.count()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("id"), F.md5(F.col(text).cast("string")).alias("key"))
    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    left = rows.join(_small(found.filter(~F.col("stays")).select("_id", "_key").distinct(), many), same, "left_anti")
    copies = _small(found.filter("stays").groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), many)
    one = left.join(copies, same, "left_semi").dropDuplicates(["id", "key"])
    return left.join(copies, same, "left_anti").union(one).select("row.*")
