import json
import math

import pytest

from turnmill.functions.templates import ROLE_PREFIX
from turnmill.operators.formats import normalize
from turnmill.operators.ordinals import running_total, seeded_key, seeded_ordinal
from turnmill.operators.split import seeded_split
from turnmill.plans.prepare import dataset_report, head_sample, prepare_dataset
from turnmill.sources.records import read_records
from turnmill.sources.sinks import write_splits


def chat(question, answer):
    return {"messages": [{"role": "user", "content": question}, {"role": "assistant", "content": answer}]}


@pytest.fixture
def corpus(tmp_path):
    """Four sources of 9, 6, 5 and 6 records, as files of different layouts."""
    def lines(name, records):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in records) + "\n")

    lines("alpaca.jsonl", [{"instruction": f"i{n}", "input": "", "output": f"o{n}"} for n in range(9)])
    lines("openai.jsonl", [chat(f"q{n}", f"a{n}") for n in range(6)])
    lines("chatml.jsonl", [{"text": f"<|im_start|>user\nq{n}<|im_end|>\n<|im_start|>assistant\na<|im_end|>"} for n in range(5)])
    turns = [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]
    (tmp_path / "sharegpt.json").write_text(json.dumps([{"conversations": turns, "system": f"s{n}"} for n in range(6)]))
    return tmp_path


def test_record_counts(spark, corpus):
    counts = {r["file"].rsplit("/", 1)[-1]: r["count"] for r in read_records(spark, str(corpus)).groupBy("file").count().collect()}
    assert counts == {"alpaca.jsonl": 9, "openai.jsonl": 6, "chatml.jsonl": 5, "sharegpt.json": 6}


def test_prepare_dataset(spark, corpus, tmp_path):
    prepared = prepare_dataset(spark, str(corpus), template=ROLE_PREFIX, eval_ratio=0.05)
    stats = prepared.stats.first()
    assert (stats["seen"], stats["kept"], stats["num_train"], stats["num_eval"]) == (26, 26, 24, 2)
    out = str(tmp_path / "out")
    write_splits(prepared.corpus, out)
    back = spark.read.parquet(out)
    assert back.filter("split = 'eval'").count() == 2
    assert set(back.columns) == {"record_id", "file", "ordinal", "format", "text", "split"}
    lines = str(tmp_path / "lines")
    write_splits(prepared.corpus, lines, file_format="json")
    again = normalize(read_records(spark, lines, json_files="lines"), "text")
    assert sorted(r["text"] for r in again.collect()) == sorted(r["text"] for r in back.collect())
    with pytest.raises(ValueError):
        write_splits(prepared.corpus, out, file_format="csv")


def test_small_corpus_is_not_split(spark, corpus):
    stats = prepare_dataset(spark, str(corpus / "alpaca.jsonl"), eval_ratio=0.5).stats.first()
    assert (stats["num_train"], stats["num_eval"]) == (9, 0)


def test_no_usable_example(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":" "}\n{"messages":[]}\n')
    with pytest.raises(ValueError, match="none of 2 records"):
        prepare_dataset(spark, str(tmp_path))


def test_malformed_record_aborts_or_is_skipped(spark, corpus):
    (corpus / "bad.jsonl").write_text('{"foo":1}\n')
    with pytest.raises(Exception, match="no known layout"):
        prepare_dataset(spark, str(corpus))
    assert prepare_dataset(spark, str(corpus), on_error="skip").stats.first()["kept"] == 26


def test_quarantined_json_is_left_out(spark, corpus):
    (corpus / "bad.jsonl").write_text('{bad\n{"text":"t"}\n')
    prepared = prepare_dataset(spark, str(corpus), on_bad_json="quarantine")
    stats = prepared.stats.first()
    assert (stats["seen"], stats["kept"], stats["dropped"], stats["rejected"]) == (28, 27, 0, 1)
    assert [(r["reason"], r["raw"]) for r in prepared.rejected.collect()] == [("invalid JSON", "{bad")]


def test_quarantine_keeps_every_reject(spark, corpus):
    (corpus / "bad.jsonl").write_text('{bad\n{"foo":1}\n{"text":" "}\n')
    prepared = prepare_dataset(spark, str(corpus), on_bad_json="quarantine", on_error="quarantine")
    stats = prepared.stats.first()
    assert stats["seen"] == stats["kept"] + stats["dropped"] + stats["rejected"] == 29
    rows = sorted((r["ordinal"], r["reason"], r["raw"]) for r in prepared.rejected.collect())
    assert rows == [(1, "invalid JSON", "{bad"), (2, "no known layout; keys: foo", '{"foo":1}')]
    skipped = prepare_dataset(spark, str(corpus), on_bad_json="skip", on_error="skip")
    assert skipped.rejected.collect() == [] and skipped.stats.first()["rejected"] == 0


def test_head_sample_is_in_read_order(spark, corpus):
    prepared = prepare_dataset(spark, str(corpus), template=ROLE_PREFIX, eval_ratio=0)
    texts = [r["text"] for r in head_sample(prepared.corpus, 10).collect()]
    assert texts == [f"user: i{n}\nassistant: o{n}" for n in range(9)] + ["user: q0\nassistant: a"]


def test_dataset_report(parsed):
    records = parsed([chat("q", "a"), chat("q", " "), {"text": "t"}, {"text": " "}, {"foo": 1}, {"instruction": ""}])
    rows = dataset_report(normalize(records, on_error="quarantine")).collect()
    assert {(r["format"], r["status"]): r["n"] for r in rows} == {
        ("openai", "ok"): 1, ("openai", "unusable"): 1, ("openai", None): 2,
        ("text", "ok"): 1, ("text", "blank"): 1, ("text", None): 2,
        ("unknown", "malformed"): 1, ("unknown", None): 1,
        ("alpaca", "malformed"): 1, ("alpaca", None): 1, (None, None): 6,
    }


@pytest.mark.parametrize("n, ratio, expected", [(9, 0.05, 0), (10, 0.05, 1), (100, 0.07, 8), (50, 0, 0), (40, 1.0, 40)])
def test_split_size(spark, n, ratio, expected):
    split = seeded_split(spark.range(n), "id", ratio=ratio)
    assert split.filter("split = 'eval'").count() == expected
    assert split.count() == n


def test_split_ignores_partitioning(spark):
    ids = spark.range(3000)
    sides = [
        {r["id"] for r in seeded_split(ids.repartition(p), "id", ratio=0.1, seed=7).filter("split = 'eval'").collect()}
        for p in (1, 7)
    ]
    assert sides[0] == sides[1] and len(sides[0]) == 300
    other = seeded_split(ids, "id", ratio=0.1, seed=8).filter("split = 'eval'")
    assert {r["id"] for r in other.collect()} != sides[0]


def test_seeded_ordinal_is_the_global_rank(spark):
    df = spark.range(2000).withColumn("key", seeded_key(1, "id"))
    rows = seeded_ordinal(df, "key", ["id"]).collect()
    ranked = sorted(rows, key=lambda r: (r["key"], r["id"]))
    assert [r["ordinal"] for r in ranked] == list(range(2000))


def test_running_total_with_a_hot_group(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS g", "id AS k", "id % 11 AS w")
    seen: dict[str, int] = {}
    got = {r["k"]: r["before"] for r in running_total(df.repartition(5), "w", ["k"], "g").collect()}
    for r in df.orderBy("k").collect():
        assert got[r["k"]] == seen.get(r["g"], 0)
        seen[r["g"]] = seen.get(r["g"], 0) + r["w"]
    assert math.ceil(0.07 * 100) == 8


def test_intermediate_tables_can_be_dropped(spark, tmp_path):
    import os

    from turnmill import session

    kept = session._made[:]
    session._made.clear()
    df = session.materialize(spark.range(5), "tried")
    folder = session._made[0].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(folder)
    assert session.drop_intermediates(spark) == 1 and not os.path.exists(folder)
    session._made.extend(kept)


def test_sessions_keep_their_time_zone(spark):
    from turnmill.session import configure

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    spark.conf.set("spark.sql.session.timeZone", before)
