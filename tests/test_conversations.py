import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnmill.functions.messages import MESSAGES_TYPE, is_usable, with_system
from turnmill.functions.sql import strip
from turnmill.functions.templates import CHATML, ROLE_PREFIX
from turnmill.functions.text import PY_WS, human_bytes, is_blank
from turnmill.operators import conversations as ops
from turnmill.operators.formats import normalize


def frame(spark, *conversations):
    rows = [(i, c) for i, c in enumerate(conversations)]
    return spark.createDataFrame(rows, f"id int, messages {MESSAGES_TYPE}")


@pytest.mark.parametrize(
    "turns, usable",
    [
        ([("user", "q"), ("assistant", "a")], True),
        ([("user", ""), ("assistant", "a")], True),
        ([("assistant", "a"), ("user", "q")], True),
        ([("user", "q"), ("assistant", " \t  ")], False),
        ([("user", "q"), ("assistant", ""), ("assistant", "x")], True),
        ([("assistant", "a")], False),
        ([("user", "q"), ("tool", "a")], False),
        ([], False),
    ],
)
def test_usable(spark, turns, usable):
    df = frame(spark, turns)
    assert df.select(is_usable(F.col("messages"))).first()[0] is usable
    long = df.selectExpr("id", "posexplode(messages) AS (turn, m)").select("id", "turn", "m.*")
    kept = ops.usable_conversations(long, "id").filter("usable").count()
    assert kept == int(usable)


def test_with_system(spark):
    df = frame(spark, [], [("user", "q")], [("system", "s")], [("user", "q"), ("system", "s")])
    got = df.select(with_system(F.col("messages"), "P").alias("m")).collect()
    assert [[tuple(t) for t in r["m"]] for r in got] == [
        [("system", "P")],
        [("system", "P"), ("user", "q")],
        [("system", "s")],
        [("system", "P"), ("user", "q"), ("system", "s")],
    ]
    for nothing in (None, ""):
        assert df.select(F.size(with_system(F.col("messages"), nothing))).first()[0] == 0


def test_inference_prompt(spark):
    df = ops.inference_prompts(frame(spark, [("user", "q")]), CHATML, "P")
    assert df.first()["prompt"] == (
        "<|im_start|>system\nP<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    )


def test_render(parsed):
    records = parsed(
        [
            {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
            {"messages": [{"role": "user", "content": "q"}]},
            {"text": "  plain "},
            {"text": "  \n"},
        ]
    )
    unified = normalize(records)
    assert [r["text"] for r in ops.render(unified, CHATML).orderBy("id").collect()] == [
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n",
        "  plain ",
    ]
    assert ops.render(unified, ROLE_PREFIX).orderBy("id").first()["text"] == "user: q\nassistant: a"


def test_missing_template(parsed):
    chat = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    unusable = {"messages": [{"role": "user", "content": "q"}]}
    with pytest.raises(PySparkException, match="need a template"):
        ops.render(normalize(parsed([chat])), None).collect()
    assert ops.render(normalize(parsed([unusable, {"text": "t"}])), None).count() == 1


def test_strip_is_pythons(spark):
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    assert {c for c in every if not c.strip()} == set(PY_WS)
    samples = [f"{c}a{c}b{c}" for c in PY_WS] + ["", PY_WS, "​x​", "﻿x"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    got = rows.select("s", F.expr(strip("s")).alias("t"), is_blank(F.col("s")).alias("b")).collect()
    assert all(r["t"] == r["s"].strip() and r["b"] == (not r["s"].strip()) for r in got)


def test_human_bytes(spark):
    cases = {
        0: "0.00 B", 1023: "1023.00 B", 1024: "1.00 KiB", 1152: "1.12 KiB", 1536: "1.50 KiB",
        1024**2: "1.00 MiB", 15247683584: "14.20 GiB", 1024**4: "1.00 TiB", 5 * 1024**5: "5120.00 TiB",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "n bigint")
    assert {r["n"]: r["h"] for r in rows.select("n", human_bytes(F.col("n")).alias("h")).collect()} == cases
    assert math.isclose(1152 / 1024, 1.125)
