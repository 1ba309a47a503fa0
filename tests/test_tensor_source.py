"""Tensor headers as a data source: partitions by header size, filters before any file is opened."""

import json
import struct

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringStartsWith

from turnmill.sources.model_files import list_files, read_tensor_headers
from turnmill.sources.tensor_source import SOURCE, HeaderPartition, TensorHeaderReader, dealt, register_tensor_headers


def weights(path, header):
    body = header if isinstance(header, bytes) else json.dumps(header).encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(struct.pack("<Q", len(body)) + body + b"\0" * 16)


@pytest.fixture
def store(tmp_path):
    for m in range(6):
        for s in range(3):
            weights(tmp_path / f"m{m}" / f"part {s}.safetensors", {f"t{m}.{s}.{i}": {"dtype": "F32", "shape": [i, 2]} for i in range(4 + 40 * (m == 5))})
        (tmp_path / f"m{m}" / "config.json").write_text("{}")
        weights(tmp_path / f"m{m}" / "below" / "x.safetensors", {"no": {"dtype": "F32", "shape": []}})
    weights(tmp_path / "m0" / "bad.safetensors", b"{bad")
    (tmp_path / "m1" / "short.safetensors").write_bytes(b"123")
    (tmp_path / "loose.safetensors").write_bytes(b"")
    return tmp_path


def read(spark, store, **options):
    register_tensor_headers(spark)
    return spark.read.format(SOURCE).options(**options).load(str(store))


def rows(df):
    return sorted(map(str, df.select("model", "shard", "tensor", "dtype", "shape", "issue").collect()))


def test_same_rows_as_the_files(spark, store):
    assert rows(read(spark, store)) == rows(read_tensor_headers(list_files(spark, str(store))))
    assert read(spark, store).filter("issue IS NOT NULL").count() == 2
    assert rows(read(spark, f"file://{store}")) == rows(read(spark, store))


def test_filters_reach_the_source(spark, store):
    whole = read(spark, store)
    for test in ("model = 'm2'", "model IN ('m1', 'm4') AND shard = 'part 1.safetensors'", "startswith(shard, 'part') AND model > 'm3' AND tensor LIKE '%.3'", "model = 'none'", "model <> 'm2'", "model <=> 'm1'", "model IS NULL"):
        wanted = [r for r in read_tensor_headers(list_files(spark, str(store))).filter(test).collect()]
        assert rows(whole.filter(test)) == sorted(map(str, wanted))
    # What the source has taken over is shown by the scan, and is not filtered again.
    formatted = lambda test: whole.filter(test)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plan = formatted("model = 'm2' AND endswith(shard, '1.safetensors')")
    assert "EqualTo(model,m2)" in plan and "StringEndsWith(shard,1.safetensors)" in plan and " Filter" not in plan
    assert " Filter" in formatted("tensor = 't2.1.0'")


def test_only_chosen_files_are_opened(store):
    reader = TensorHeaderReader(str(store), 1 << 20)
    left = list(reader.pushFilters([EqualTo(("model",), "m3"), In(("shard",), ("part 0.safetensors", "bad.safetensors")), GreaterThan(("model",), "a"), Not(EqualTo(("model",), "x")), StringStartsWith(("tensor",), "t")]))
    assert [type(f) for f in left] == [GreaterThan, Not, StringStartsWith]
    (only,) = reader.partitions()
    assert [f[:2] for f in only.files] == [("m3", "part 0.safetensors")]


def test_partitions_follow_header_bytes(spark, store, monkeypatch):
    monkeypatch.setattr("turnmill.sources.tensor_source.OPEN_BYTES", 0)
    partitions = TensorHeaderReader(str(store), 2500).partitions()
    assert all(isinstance(p, HeaderPartition) and (p.header_bytes <= 2500 or len(p.files) == 1) for p in partitions)
    files = [f for p in partitions for f in p.files]
    assert files == sorted(files) and len(files) == 6 * 3 + 2 and len(partitions) > 3
    assert read(spark, store, partitionBytes=1).rdd.getNumPartitions() == 20


def test_dealt():
    assert dealt([], 5) == []
    assert dealt([9, 1, 2, 2, 1, 9], 5) == [[0], [1, 2, 3], [4], [5]]


def test_empty_store(spark, tmp_path):
    assert read(spark, tmp_path).collect() == []
