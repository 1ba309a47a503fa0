import json
import random

import pytest
from pyspark.sql import functions as F

from turnmill.functions.templates import ROLE_PREFIX
from turnmill.operators.conversations import render
from turnmill.operators.formats import normalize
from turnmill.sources.records import read_records
from turnmill.streaming.deltas import accumulate_deltas
from turnmill.streaming.ingest import start_ingest, stream_records, stream_rejected, stream_rendered
from turnmill.streaming.latency import windowed_latency


def chat(n):
    return {"messages": [{"role": "user", "content": f"q{n}"}, {"role": "assistant", "content": f"a{n}"}]}


def test_ingest_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drop(name, records):
        (source / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))

    drop("a.jsonl", [chat(1), {"text": "t"}, "{bad", "", {"foo": 1}, {"text": " "}])
    drop("b.jsonl", [{"instruction": "i", "output": "o"}, "[1]"])

    def ingest():
        rendered = stream_rendered(stream_records(spark, str(source), max_files=1), template=ROLE_PREFIX, on_error="skip")
        start_ingest(rendered, out, state).awaitTermination()

    ingest()
    drop("c.jsonl", [chat(2)])
    ingest()
    batch = render(normalize(read_records(spark, str(source), on_bad_json="skip"), on_error="skip"), ROLE_PREFIX)
    got = sorted(r["text"] for r in spark.read.parquet(out).collect())
    assert got == sorted(r["text"] for r in batch.collect()) == sorted(
        ["user: q1\nassistant: a1", "t", "user: i\nassistant: o", "user: q2\nassistant: a2"]
    )


def test_strict_ingest_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{bad\n")
    rendered = stream_rendered(stream_records(spark, str(tmp_path)))
    with pytest.raises(Exception, match="invalid JSON"):
        start_ingest(rendered, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()


def test_rejects_have_a_sink_of_their_own(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{bad\n{"text":"t"}\n{"foo":1}\n')
    records = stream_records(spark, str(tmp_path / "in"))
    start_ingest(stream_rejected(records), str(tmp_path / "r"), str(tmp_path / "rs")).awaitTermination()
    start_ingest(stream_rendered(records, on_error="quarantine"), str(tmp_path / "o"), str(tmp_path / "os")).awaitTermination()
    rows = sorted((r["reason"], r["raw"]) for r in spark.read.parquet(str(tmp_path / "r")).collect())
    assert rows == [("invalid JSON", "{bad"), ("no known layout; keys: foo", '{"foo":1}')]
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["t"]


def deltas(count=40):
    rows = [(r, seq, f" {r}.{seq}" if seq % 5 else "") for r in ("x", "y") for seq in range(count)]
    random.Random(3).shuffle(rows)
    expected = {r: "".join(f" {r}.{seq}" for seq in range(count) if seq % 5) for r in ("x", "y")}
    return rows, expected


def test_accumulate_batch_and_stream(spark, tmp_path):
    rows, expected = deltas()
    schema = "request_id string, seq bigint, delta string"
    batch = accumulate_deltas(spark.createDataFrame(rows, schema).repartition(5), "request_id")
    assert {r["request_id"]: r["text"] for r in batch.collect()} == expected

    for n in range(4):
        part = spark.createDataFrame(rows[n::4], schema).coalesce(1)
        part.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = (
        accumulate_deltas(stream, "request_id").writeStream.outputMode("update").format("memory")
        .queryName("pieces").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    )
    query.awaitTermination()
    seen = spark.table("pieces").collect()
    longest = {r: max((s["text"] for s in seen if s["request_id"] == r), key=len) for r in expected}
    assert longest == expected and len(seen) > 2


def test_windowed_latency_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr(
        "IF(id % 3 = 0, 'a', 'b') AS engine",
        "timestamp_seconds(1704067200 + id * 97) AS ts",
        "id % 50 = 0 AS is_warmup",
        "CAST(id % 7 AS DOUBLE) AS total_s",
        "CAST(id % 3 AS DOUBLE) / 10 AS ttft_s",
        "id % 11 AS gen_tokens",
    )
    source = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(source)
    batch = windowed_latency(spark.read.parquet(source), "engine")
    stream = windowed_latency(spark.readStream.schema(rows.schema).parquet(source), "engine", lateness="10 minutes")
    query = (
        stream.writeStream.outputMode("append").format("memory").queryName("windows")
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("windows").collect()}
    want = {tuple(r) for r in batch.collect()}
    # The watermark closes every window that ends ten minutes before the last run.
    last = rows.agg(F.max("ts")).first()[0]
    closed = {r for r in want if (last - r[0]).total_seconds() >= 3600 + 600}
    assert got == closed and len(closed) >= 12


def test_late_runs_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    fixed = ["'e' AS engine", "false AS is_warmup", "1D AS total_s", "0D AS ttft_s", "1L AS gen_tokens"]
    # The watermark a batch filters with is the one the batch before it ended on.
    for second in (0, 40000, 50000, 60000, 10, 80000):
        row = spark.range(1).selectExpr(f"timestamp_seconds({1704067200 + second}) AS ts", *fixed)
        row.coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        windowed_latency(stream, "engine", lateness="1 minute").writeStream.outputMode("append").format("memory")
        .queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    )
    query.awaitTermination()
    first = [r for r in spark.table("late").collect() if r["window_start"].hour == 0]
    assert [r["runs"] for r in first] == [1]
