"""Streams that keep state, and one that feeds two sinks."""

import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnmill.functions.templates import ROLE_PREFIX
from turnmill.operators.timing import request_timing
from turnmill.streaming import ingest
from turnmill.streaming.deltas import _Assembly, accumulate_deltas, finished_requests
from turnmill.streaming.ingest import read_batches, start_ingest_both, stream_records, write_batch_once
from turnmill.streaming.timing import stream_timing

PIECES = "request_id string, seq long, ts timestamp, delta string, last boolean"


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"


class Feed:
    """A folder of JSON files that are read one after the other."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.count = spark, path, schema, 0
        path.mkdir()

    def put(self, *rows):
        names = [c.split(" ")[0] for c in self.schema.split(", ")]
        file = self.path / f"{self.count:03}.json"
        file.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        os.utime(file, (1_700_000_000 + self.count,) * 2)
        self.count += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.path))

    def table(self):
        return self.spark.read.schema(self.schema).json(str(self.path))


def run(stream, tmp_path, name):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    held = [[o["numRowsTotal"] for o in p["stateOperators"]] for p in query.recentProgress]
    return held


def test_finished_requests(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", PIECES)
    feed.put(("a", 0, at(0), "He", False), ("a", 2, at(1), "o", True), ("b", 0, at(0), "part", False))
    feed.put(("a", 1, at(2), "ll", False), ("c", 0, at(3), "", True), ("b", 2, at(3), "s", False))
    # Pieces that come twice count once, the first as it was.
    feed.put(("d", 1, at(5), "y", True), ("d", 1, at(5), "Y", True), ("b", 2, at(4), "x", False))
    feed.put(("d", 0, at(6), "x", False))
    # The watermark passes the idle time of b; what came too late is dropped.
    feed.put(("e", 0, at(2000), "new", True))
    feed.put(("e1", 0, at(2000), "q", True))
    feed.put(("f", 0, at(2), "late", True), ("e2", 0, at(2001), "z", True))
    feed.put(("g", 0, at(4000), "end", True))
    held = run(finished_requests(feed.stream(), idle="60 seconds", lateness="10 seconds"), tmp_path, "out")
    rows = {r["request_id"]: (r["text"], r["pieces"], r["complete"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {
        "a": ("Hello", 3, True), "b": ("parts", 2, False), "c": ("", 1, True), "d": ("xy", 2, True),
        "e": ("new", 1, True), "e1": ("q", 1, True), "e2": ("z", 1, True), "g": ("end", 1, True),
    }
    # Nothing is kept of requests that are over.
    assert held[0] != [0] and held[-1] == [0]


class CountedState:
    """Both kinds of state of a request and its timers, with the number of calls."""

    def __init__(self):
        self.calls, self.values, self.value, self.timers = 0, {}, None, set()

    def getListState(self, *_):
        return self

    getMapState = getValueState = getListState

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "appendValue":
                self.values[len(self.values)] = given[0]
            elif name == "updateValue":
                self.values[given[0]] = given[1]
            elif name == "update":
                self.value = given[0]
            elif name == "clear":
                self.values, self.value = {}, None
            return {"get": self.value, "exists": self.value is not None, "getCurrentWatermarkInMs": 0, "containsKey": bool(given) and given[0] in list(self.values)}.get(name)

        return call


def test_calls_to_the_state_do_not_grow_with_the_pieces():
    counts = []
    for n in (10, 1000):
        state, request = CountedState(), _Assembly(1000)
        request.init(state)
        pieces = [Row(seq=i, delta=f" {i}", last=i == n, ts_ms=i) for i in range(1, n + 1)]
        assert list(request.handleInputRows(("a",), iter(pieces), state)) == []
        counts.append(state.calls)
    assert counts[0] == counts[1]


def test_finished_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    feed = Feed(spark, tmp_path / "in", PIECES)
    rows = [(f"r{r}", i, at(r + i), rng.choice(["a", "", "bc "]), i == n - 1) for r in range(30) for n in [rng.randint(1, 12)] for i in range(n)]
    rng.shuffle(rows)
    for k in range(4):
        feed.put(*rows[k::4])
    held = run(finished_requests(feed.stream(), idle="1 hour", lateness="1 hour"), tmp_path, "out")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.filter("complete").count() == 30 and held[-1] == [0]
    batch = {r["request_id"]: r["text"] for r in accumulate_deltas(feed.table(), "request_id").collect()}
    assert {r["request_id"]: r["text"] for r in found.collect() if r["text"]} == batch


def test_stream_timing_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    starts = Feed(spark, tmp_path / "starts", "request_id string, started timestamp")
    pieces = Feed(spark, tmp_path / "pieces", "request_id string, ts timestamp, delta string")
    begun = {f"r{i}": i * 3 for i in range(20)}
    said = [(r, at(s + 1 + rng.randint(0, 20)), rng.choice(["", "x"])) for r, s in begun.items() for _ in range(rng.randint(1, 9))]
    rng.shuffle(said)
    for k in range(2):
        starts.put(*[(r, at(s)) for i, (r, s) in enumerate(begun.items()) if i % 2 == k])
        pieces.put(*said[k::2])
    timing = stream_timing(starts.stream(), pieces.stream(), longest="1 minute", lateness="10 minutes")
    run(timing, tmp_path, "out")
    # A piece beyond the longest time is of no request; one behind the watermark is late.
    pieces.put(("r0", at(400), "beyond"))
    run(timing, tmp_path, "out")
    starts.put(("end", at(20_000)))
    pieces.put(("end", at(20_000), ""))
    held = run(timing, tmp_path, "out")
    pieces.put(("r1", at(5), "late"))
    run(timing, tmp_path, "out")
    found = {r["request_id"]: (r["total_s"], r["ttft_s"], r["gen_tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = pieces.table().filter("delta NOT IN ('beyond', 'late')").join(starts.table(), "request_id")
    batch = {r["request_id"]: (r["total_s"], r["ttft_s"], r["gen_tokens"]) for r in request_timing(whole).collect()}
    del batch["end"]
    assert found == batch and len(found) == 20
    assert sum(held[-1]) <= 3


def lines(path, records):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def both(spark, tmp_path):
    records = stream_records(spark, str(tmp_path / "in"), max_files=1)
    names = [str(tmp_path / n) for n in ("usable", "rejected", "state")]
    start_ingest_both(records, *names, template=ROLE_PREFIX).awaitTermination()


def sinks(spark, tmp_path):
    usable = sorted(r["text"] for r in read_batches(spark, str(tmp_path / "usable")).collect())
    return usable, sorted((r["reason"], r["raw"]) for r in read_batches(spark, str(tmp_path / "rejected")).collect())


EXPECTED = (["i1", "i2", "i3"], [("invalid JSON", "{bad"), ("no known layout; keys: foo", '{"foo": 1}'), ("no known layout; keys: foo", '{"foo": 2}')])


@pytest.mark.parametrize("ends_in", [None, "rejected", "usable", "note"])
def test_both_sinks_are_exact_when_a_batch_runs_again(spark, tmp_path, monkeypatch, ends_in):
    lines(tmp_path / "in" / "a.jsonl", [{"text": "i1"}, "{bad", {"foo": 1}, {"text": " "}])
    lines(tmp_path / "in" / "b.jsonl", [{"text": "i2"}, {"foo": 2}, ""])
    lines(tmp_path / "in" / "c.jsonl", [{"text": "i3"}])
    write, commit, ended = ingest.write_batch_once, ingest._commit, []

    def ends(rows, sink, batch_id):
        if not ended and batch_id == 1 and sink.endswith(str(ends_in)):
            ended.append(batch_id)
            # Half a batch is there already, but no note of it.
            rows.limit(0).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            raise RuntimeError("the job ends here")
        return write(rows, sink, batch_id)

    def ends_before_note(session, sink, batch_id):
        if ends_in == "note" and not ended and batch_id == 1:
            ended.append(batch_id)
            raise RuntimeError("the job ends here")
        commit(session, sink, batch_id)

    monkeypatch.setattr(ingest, "write_batch_once", ends)
    monkeypatch.setattr(ingest, "_commit", ends_before_note)
    if ends_in:
        with pytest.raises(Exception, match="ends here"):
            both(spark, tmp_path)
    both(spark, tmp_path)
    assert sinks(spark, tmp_path) == EXPECTED and bool(ended) == bool(ends_in)
    # Nothing new: nothing is written.
    both(spark, tmp_path)
    assert sinks(spark, tmp_path) == EXPECTED


def test_a_batch_is_written_once(spark, tmp_path):
    sink = str(tmp_path / "sink")
    assert write_batch_once(spark.range(3), sink, 7)
    assert not write_batch_once(spark.range(9), sink, 7)
    assert write_batch_once(spark.range(3, 5), sink, 8)
    assert sorted(r["id"] for r in read_batches(spark, sink).collect()) == [0, 1, 2, 3, 4]
    spark.range(99).write.parquet(f"{sink}/batch=9")
    assert read_batches(spark, sink).agg(F.count("*")).first()[0] == 5
