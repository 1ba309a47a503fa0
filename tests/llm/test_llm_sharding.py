import collections
import hashlib
import random
import zlib

import pytest
from conftest import SF_DIR
from llm_cases import ROWS, documents, plain, with_clashes

from turnmill.llm import sharding
from turnmill.llm.queries import QUERIES


def _least_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], sum(sizes[i:j])) for i in range(j + 1)) for j in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("shards", [1, 3, 7])
def test_capacity_is_the_smallest(spark, seed, shards):
    rng = random.Random(seed)
    keys = [hashlib.sha256(f"{seed}{i}".encode()).hexdigest() for i in range(rng.choice([2, 9, 25]))]
    # Long common prefixes make the search go through several rounds.
    keys = [("00000000" if rng.random() < 0.5 else "") + k for k in keys]
    keys = sorted(k[:64] for k in keys)
    sizes = [rng.choice([1, 5, 40]) * rng.randint(1, 9) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key string, size long")
    plan = sharding.plan_shards(df, shards)
    assert plan.capacity == _least_capacity(sizes, shards)
    by = collections.Counter()
    for r in df.withColumn("shard", plan.shard(df.key)).collect():
        by[r.shard] += r.size if isinstance(r.size, int) else r["size"]
    assert max(by.values()) == plan.capacity and len(plan.cuts) == shards - 1 and list(plan.cuts) == sorted(plan.cuts)


def test_query_law(spark):
    rows = QUERIES["op1_minimax_shards"](spark, SF_DIR).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    shard_of, sizes, slots = {}, collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(data, r.shard) == r.shard
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for data in docs.values():
        groups[data] += len(data) + 1
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(groups.values())


def test_odd_rows(spark):
    docs = documents(spark)
    found = sharding.minimax_shards(docs, 4).collect()
    assert len(found) == len(ROWS)
    assert plain(sharding.minimax_shards(with_clashes(docs).drop("id"), 4).collect(), *found[0].asDict()) == plain(found, *found[0].asDict())
    assert len({r.shard for r in found if r["size"] == 1}) == 1
    assert sharding.minimax_shards(docs.limit(0), 4).collect() == []


def test_write_shards(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert plain(back.collect(), *docs.columns) == plain(docs.collect(), *docs.columns)
