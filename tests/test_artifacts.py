import json
import struct

import pytest

from turnmill.operators import artifacts as ops
from turnmill.sources.model_files import list_files, read_json_files, read_tensor_headers


def weights(path, header, body=b"\0" * 64, prefix=None):
    raw = header if isinstance(header, bytes) else json.dumps(header).encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(struct.pack("<Q", len(raw) if prefix is None else prefix) + raw + body)


def text(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    good = root / "good"
    weights(good / "model-1.safetensors", {"w": {"dtype": "F32", "shape": [2, 3]}, "__metadata__": {"format": "pt"}})
    weights(good / "model-2.safetensors", {"s": {"dtype": "BF16", "shape": []}, "odd": {}})
    weights(good / "sub" / "deep.safetensors", {"x": {"dtype": "I8", "shape": [9]}})
    text(good / "model.safetensors.index.json", {"weight_map": {"w": "model-1.safetensors", "s": "model-2.safetensors"}})
    text(good / "config.json", {"architectures": ["A", "B"], "model_type": "m", "hidden_size": 8, "num_hidden_layers": 2, "vocab_size": 100})
    text(good / "tokenizer_config.json", {"tokenizer_class": "T"})
    text(good / "generation_config.json", {"top_k": 5})
    text(good / "notes.md", "not reported")
    text(good / "merges.TXT", "a b")

    broken = root / "broken"
    (broken).mkdir()
    (broken / "short.safetensors").write_bytes(b"\1\2")
    weights(broken / "cut.safetensors", b"{}", b"", prefix=500)
    weights(broken / "bad.safetensors", b"{nope")
    weights(broken / "list.safetensors", b"[1]")
    weights(broken / "fine.safetensors", {"t": {"dtype": "F16", "shape": [4]}})
    text(broken / "config.json", "{bad")
    text(broken / "model.safetensors.index.json", {"weight_map": {"a": "gone.safetensors", "b": "fine.safetensors", "c": "gone.safetensors"}})

    empty_map = root / "empty_map"
    weights(empty_map / "m.safetensors", {})
    text(empty_map / "model.safetensors.index.json", {"weight_map": {}})
    text(empty_map / "config.json", "{}")
    text(empty_map / "tokenizer.json", "{}")

    bare = root / "bare"
    text(bare / "config.json", {"architectures": []})
    text(bare / "sub" / "config.json", {"model_type": "not this one"})
    text(bare / "tokenizer.model", "x")

    spaced = root / "with space"
    weights(spaced / "m 1.safetensors", {"t": {"dtype": "F64", "shape": [5]}})
    text(spaced / "config.json", {"model_type": "sp"})
    text(spaced / "tokenizer.json", "{}")

    plain = root / "plain"
    weights(plain / "m.safetensors", {"t": {"dtype": "F64", "shape": [3, 0]}})
    text(plain / "config.json", {"model_type": "p"})
    text(plain / "tokenizer.json", "{}")
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, store):
    files = list_files(spark, store)
    return {
        "models": files.select("model").distinct(),
        "files": files,
        "tensors": read_tensor_headers(files),
        "indexes": read_json_files(spark, store, "model.safetensors.index.json"),
        "configs": read_json_files(spark, store, "config.json"),
    }


def test_listing(tables):
    rows = {(r["model"], r["rel_path"]) for r in tables["files"].collect()}
    assert ("good", "sub/deep.safetensors") in rows and ("good", "merges.TXT") in rows
    # Every file is listed; only the inventory leaves kinds out.
    assert ("good", "notes.md") in rows
    assert "content" not in tables["files"]._jdf.queryExecution().executedPlan().toString()


def test_headers(tables):
    rows = tables["tensors"].collect()
    tensors = {(r["model"], r["shard"], r["tensor"], r["dtype"], tuple(r["shape"])) for r in rows if r["tensor"]}
    assert tensors == {
        ("good", "model-1.safetensors", "w", "F32", (2, 3)),
        ("good", "model-2.safetensors", "s", "BF16", ()),
        ("good", "model-2.safetensors", "odd", "?", ()),
        ("broken", "fine.safetensors", "t", "F16", (4,)),
        ("plain", "m.safetensors", "t", "F64", (3, 0)),
        ("with space", "m 1.safetensors", "t", "F64", (5,)),
    }
    assert {(r["shard"], r["issue"]) for r in rows if r["issue"]} == {
        ("short.safetensors", "file is shorter than its length prefix"),
        ("cut.safetensors", "header is truncated"),
        ("bad.safetensors", "header is not JSON"),
        ("list.safetensors", "header is not a JSON object"),
    }


def test_dtype_breakdown(spark):
    df = spark.createDataFrame(
        [("m", "F32", [2, 3]), ("m", "BF16", []), ("big", "F32", [2**40, 2**40])],
        "model string, dtype string, shape array<bigint>",
    ).selectExpr("*", "'t' AS tensor")
    got = {(r["model"], r["dtype"]): (int(r["parameters"]), round(r["share_pct"], 6)) for r in ops.dtype_breakdown(df).collect()}
    assert got == {("m", "F32"): (6, 85.714286), ("m", "BF16"): (1, 14.285714), ("big", "F32"): (2**80, 100.0)}


def test_totals(tables):
    got = {r["model"]: int(r["parameters"]) for r in ops.parameter_totals(tables["tensors"]).collect()}
    assert got == {"good": 8, "broken": 4, "plain": 0, "with space": 5}


def test_inventory(tables):
    rows = ops.file_inventory(tables["files"]).filter("model = 'good'").collect()
    total = next(r["size"] for r in rows if r["rel_path"] is None)
    assert total == sum(r["size"] for r in rows if r["rel_path"])
    assert len(rows) == 9 and not any("notes" in (r["rel_path"] or "") for r in rows)


def test_missing_shards(tables):
    rows = ops.missing_shards(tables["indexes"], tables["files"]).collect()
    assert [(r["model"], r["shard"]) for r in rows] == [("broken", "gone.safetensors")]


def test_problems(tables):
    rows = ops.model_problems(tables["models"], tables["files"], tables["indexes"]).collect()
    incomplete = "weight shards are missing or incomplete"
    assert {(r["model"], r["problem"]) for r in rows} == {
        ("broken", "no tokenizer file"),
        ("broken", incomplete),
        ("empty_map", incomplete),
        ("bare", incomplete),
    }


def test_report_issues(tables):
    rows = ops.report_issues(**tables).collect()
    assert {(r["model"], r["issue"]) for r in rows} == {
        ("broken", "short.safetensors: file is shorter than its length prefix"),
        ("broken", "cut.safetensors: header is truncated"),
        ("broken", "bad.safetensors: header is not JSON"),
        ("broken", "list.safetensors: header is not a JSON object"),
        ("broken", "config.json is missing or invalid"),
        ("broken", "missing shard gone.safetensors"),
        ("empty_map", "config.json is missing or invalid"),
        ("bare", "no weight files"),
    }


def test_model_report(spark, store, tables):
    extra = [read_json_files(spark, store, f"{n}_config.json") for n in ("tokenizer", "generation")]
    report = ops.model_report(tables["models"], tables["files"], tables["tensors"], tables["configs"], *extra, tables["indexes"])
    got = {r["model"]: r for r in report.collect()}
    assert {m for m, r in got.items() if r["integrity_ok"]} == {"good", "plain", "with space"}
    assert got["bare"]["issues"] == ["no weight files"] and int(got["bare"]["parameters"]) == 0
    assert len(got["broken"]["issues"]) == 6 and int(got["broken"]["parameters"]) == 4
    inventory = ops.file_inventory(tables["files"]).filter("rel_path IS NULL").collect()
    assert {r["model"]: r["size"] for r in inventory} == {m: r["disk_bytes"] for m, r in got.items()}
    assert got["good"]["tokenizer_class"] == "T" and got["good"]["hidden_size"] == 8


def test_shards_of_any_suffix_and_oversized_headers(spark, tmp_path):
    model = tmp_path / "m"
    text(model / "model.safetensors.index.json", {"weight_map": {"a": "part.bin", "b": "gone.bin"}})
    (model / "part.bin").write_bytes(b"x")
    with open(model / "huge.safetensors", "wb") as out:
        out.write((150_000_000).to_bytes(8, "little"))
        out.truncate(200_000_000)
    files = list_files(spark, str(tmp_path))
    indexes = read_json_files(spark, str(tmp_path), "model.safetensors.index.json")
    assert [r["shard"] for r in ops.missing_shards(indexes, files).collect()] == ["gone.bin"]
    assert [r["issue"] for r in read_tensor_headers(files).collect()] == ["header is larger than the format allows"]


def test_facts(spark, store, tables):
    facts = ops.model_facts(
        tables["models"],
        tables["configs"],
        read_json_files(spark, store, "tokenizer_config.json"),
        read_json_files(spark, store, "generation_config.json"),
    )
    got = {r["model"]: r for r in facts.collect()}
    assert tuple(got["good"])[1:] == ("A", "m", 8, 2, 100, True, "T", '{"top_k":5}')
    assert tuple(got["broken"])[1:] == (None, None, None, None, None, False, None, None)
    assert got["bare"]["architecture"] is None and got["bare"]["config_ok"]
    assert got["bare"]["model_type"] is None
    assert got["empty_map"]["config_ok"] is False
    assert got["with space"]["model_type"] == "sp"


def test_bad_entries_and_lost_files_are_issues(spark, tmp_path):
    import json
    import struct

    from turnmill.sources.model_files import list_files, read_tensor_headers

    (tmp_path / "m").mkdir()
    header = json.dumps({"w": [1, 2]}).encode()
    (tmp_path / "m" / "bad.safetensors").write_bytes(struct.pack("<Q", len(header)) + header)
    (tmp_path / "m" / "OTHER.SAFETENSORS").write_bytes(b"not read: the suffix is case-sensitive")
    (tmp_path / "m" / "lost.safetensors").write_bytes(b"12345678")
    files = list_files(spark, str(tmp_path))
    rows = files.collect()
    kept = spark.createDataFrame([(*r[:3], r["path"] + (".gone" if r["rel_path"].startswith("lost") else "")) for r in rows], files.schema)
    got = {r["shard"]: r["issue"] for r in read_tensor_headers(kept).collect()}
    assert got == {"bad.safetensors": "header has entries that are no objects", "lost.safetensors": "file can't be read: FileNotFoundError"}


def test_directories_are_listed_in_tasks(spark, tmp_path):
    from turnmill.sources.model_files import _listed_by_spark

    for name in ("a/x.safetensors", "a/_x.safetensors", "a/.x", "a/_k=v/y.bin", "a/b/c/z", "a/z._COPYING_", "a/_metadata", "_hidden/x", ".hidden/x", "at the top", "p+q %41/m 1.safetensors"):
        text(tmp_path / name, name)
    (tmp_path / "empty").mkdir()
    (tmp_path / "a" / "no bytes").touch()
    (tmp_path / "linked").symlink_to(tmp_path / "a")
    found = list_files(spark, f"{tmp_path}/")
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(found.collect()) == 7
    assert sorted(found.collect()) == sorted(_listed_by_spark(spark, str(tmp_path), f"file:{tmp_path}").collect())
    # A store that isn't there is an error when it is listed, not only when it is read.
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_files(spark, f"{tmp_path}/no store")


def test_small_files_share_a_batch(spark, tmp_path):
    import pyarrow as pa

    from turnmill.sources.model_files import _read_headers

    for i in range(50):
        weights(tmp_path / f"{i}.safetensors", {f"t{j}": {"dtype": "F32", "shape": [i, j]} for j in range(i)})
    files = pa.RecordBatch.from_pydict({"model": ["m"] * 50, "rel_path": [f"{i}.safetensors" for i in range(50)], "path": [str(tmp_path / f"{i}.safetensors") for i in range(50)]})
    batches = list(_read_headers(iter([files])))
    assert len(batches) == 1
    assert [(r["shard"], r["tensor"], r["shape"]) for r in batches[0].to_pylist()] == [(f"{i}.safetensors", f"t{j}", [i, j]) for i in range(50) for j in range(i)]
