import pytest
from pyspark.sql import functions as F

from turnmill.functions.tokens import batch_tokenizer, token_count, whitespace_tokens
from turnmill.operators.lengths import (
    batch_plan,
    effective_batch_size,
    length_groups,
    pack_blocks,
    truncated,
    with_token_count,
)
from turnmill.operators.ordinals import seeded_key


def test_tokens(spark):
    df = spark.createDataFrame([("  a b\t\nc ",), ("",), (" \n",), (None,), ("é x y",)], "text string")
    assert [r["n_tokens"] for r in with_token_count(df).collect()] == [3, 0, 0, 0, 2]
    cut = df.select(truncated(whitespace_tokens(F.col("text")), 2).alias("t")).first()["t"]
    assert cut == ["a", "b"]


def test_plugged_tokenizer(spark):
    characters = batch_tokenizer(lambda texts: [list(t) for t in texts])
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    assert [r[0] for r in df.select(token_count(F.col("text"), characters)).collect()] == [3, 0]


def test_pack_blocks_example(spark):
    df = spark.createDataFrame([("s", 1, 3), ("s", 2, 5), ("s", 3, 2)], "shard string, k int, n_tokens int")
    rows = pack_blocks(df, "k", 8).orderBy("k", "block").collect()
    assert [(r["k"], r["block"], r["tok_from"], r["tok_to"]) for r in rows] == [
        (1, 0, 0, 4), (2, 0, 0, 4), (2, 1, 4, 6), (3, 1, 0, 3),
    ]


def test_long_example_spans_blocks(spark):
    df = spark.createDataFrame([("s", 1, 20), ("t", 1, 0)], "shard string, k int, n_tokens int")
    rows = pack_blocks(df, "k", 8).orderBy("shard", "block").collect()
    assert [(r["tok_from"], r["tok_to"]) for r in rows] == [(0, 8), (8, 16), (16, 21), (0, 1)]


def test_blocks_are_full(spark):
    df = spark.range(500).selectExpr("'s' AS shard", "id AS k", "CAST(id * 37 % 23 AS INT) AS n_tokens")
    used = {r["block"]: r["used"] for r in pack_blocks(df, "k", 64).groupBy("block").agg(F.sum(F.expr("tok_to - tok_from")).alias("used")).collect()}
    last = max(used)
    assert all(used[b] == 64 for b in range(last))
    assert sum(used.values()) == sum(n * 37 % 23 + 1 for n in range(500))


def test_length_groups_against_a_plain_sort(spark):
    df = spark.range(350).selectExpr("id", "CAST(id * 31 % 17 AS INT) AS n_tokens")
    keyed = df.withColumn("key", seeded_key(42, "id")).collect()
    order = sorted(keyed, key=lambda r: (r["key"], r["id"]))
    expected, size = {}, 3
    for m in range(0, len(order), 50 * size):
        mega = sorted(order[m : m + 50 * size], key=lambda r: (-r["n_tokens"], r["id"]))
        for place, r in enumerate(mega):
            expected[r["id"]] = m // size + place // size
    assert {r["id"]: r["batch"] for r in length_groups(df, "id", size).collect()} == expected


def test_batch_plan_example(spark):
    plan = batch_plan(spark.range(20), "id").collect()
    assert len(plan) == 60
    assert sorted({r["step"] for r in plan}) == list(range(6))
    assert {r["micro_batch"] for r in plan} == set(range(8))
    first = [r for r in plan if r["epoch"] == 0]
    assert len({r["id"] for r in first}) == 20
    assert sum(1 for r in first if r["step"] == 0) == 16


@pytest.mark.parametrize(
    "options, steps, rows",
    [
        ({"max_steps": 5}, 5, 20 + 20 + 16),
        ({"epochs": 1.5}, 3, 20 + 16),
        ({"epochs": 1, "world_size": 2}, 1, 20),
        ({"epochs": 1, "world_size": 0}, 2, 20),
    ],
)
def test_batch_plan_lengths(spark, options, steps, rows):
    plan = batch_plan(spark.range(20), "id", **options).collect()
    assert max(r["step"] for r in plan) + 1 == steps and len(plan) == rows


def test_effective_batch_size():
    assert effective_batch_size(2, 8) == 16
    assert effective_batch_size(2, 8, 2) == 32
    assert effective_batch_size(2, 8, 0) == 16


def test_a_plan_that_ends_in_a_pass_ranks_only_what_it_needs(spark):
    examples = spark.range(5000)
    whole = {tuple(r) for r in batch_plan(examples, "id", epochs=1).collect()}
    few = batch_plan(examples, "id", max_steps=20)
    assert {tuple(r) for r in few.collect()} == {r for r in whole if r[1] < 20}
    # The filter on the bucket's first place is below the window.
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [row_number") < plan.rindex("before#") and "before" in plan[plan.index("Window [row_number") :]
