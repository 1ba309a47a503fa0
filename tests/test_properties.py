"""Properties that must hold for any input."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnmill.functions.messages import MESSAGES_TYPE
from turnmill.functions.templates import CHATML
from turnmill.operators.formats import parse_chatml
from turnmill.operators.perplexity import perplexity
from turnmill.operators.split import seeded_split

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

ROLES = st.sampled_from(["system", "user", "assistant", "tool"])
CONTENT = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30).map(
    lambda s: s.strip().replace("<|im_", "<|xx_")
)
CONVERSATION = st.lists(st.tuples(ROLES, CONTENT), min_size=1, max_size=6)


@SLOW
@given(st.lists(CONVERSATION, min_size=1, max_size=20))
def test_rendered_chatml_parses_back(spark, conversations):
    df = spark.createDataFrame(list(enumerate(conversations)), f"id int, messages {MESSAGES_TYPE}")
    text = df.select("id", CHATML.render(F.col("messages")).alias("text"))
    back = text.select("id", F.expr(parse_chatml("text")).alias("m")).orderBy("id").collect()
    assert [[tuple(t) for t in r["m"]] for r in back] == [list(c) for c in conversations]


@SLOW
@given(st.sets(st.integers(0, 10**6), min_size=1, max_size=200), st.floats(0, 1), st.integers(0, 99))
def test_split_is_exact_and_disjoint(spark, ids, ratio, seed):
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    rows = seeded_split(df, "id", ratio=ratio, seed=seed).collect()
    assert sorted(r["id"] for r in rows) == sorted(ids)
    import math

    expected = math.ceil(ratio * len(ids)) if ratio > 0 and len(ids) >= 10 else 0
    assert sum(r["split"] == "eval" for r in rows) == expected


@SLOW
@given(st.lists(st.tuples(st.floats(0, 20), st.integers(0, 3000)), min_size=1, max_size=60), st.integers(0, 9))
def test_perplexity_ignores_order_and_partitioning(spark, rows, seed):
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "loss double, n_tokens int")
    one, many = perplexity(df.coalesce(1)).first(), perplexity(df.repartition(4)).first()
    assert one["n_used"] == many["n_used"] == sum(n >= 2 for _, n in rows)
    assert (one["n_used"] == 0) or abs(one["perplexity"] - many["perplexity"]) <= 1e-9 * one["perplexity"]
