"""Inventory and tensor headers of a store of model directories.

A store is a folder whose direct children are model directories. Directories are
listed inside tasks; no weight is read. Of a weight file only the length prefix and
the header are read, inside tasks too.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The suffix of weight files, and a model's index file.
WEIGHTS_SUFFIX = ".safetensors"
INDEX_FILE = "model.safetensors.index.json"
_PREFIX_BYTES = 8
# Rows of a batch that goes from a task's Python worker to Spark; the tensors of a file stay together.
_ROWS_A_BATCH = 10_000
# Fixed value: the file format allows no larger header.
MAX_HEADER_BYTES = 100_000_000
# The header table's row type; `issue` is set instead of the tensor when a file is unreadable.
_HEADER_SCHEMA = "model string, shard string, tensor string, dtype string, shape array<bigint>, issue string"
_HEADER_ARROW = pa.schema(
    [
        ("model", pa.string()),
        ("shard", pa.string()),
        ("tensor", pa.string()),
        ("dtype", pa.string()),
        ("shape", pa.list_(pa.int64())),
        ("issue", pa.string()),
    ]
)
_FILE_SCHEMA = "model string, rel_path string, size long, path string"
_FILE_ARROW = pa.schema([("model", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()), ("path", pa.string())])


def is_weights(rel_path: Column) -> Column:
    """Weight files by the exact, case-sensitive suffix."""
    return rel_path.endswith(WEIGHTS_SUFFIX)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``model, rel_path, size, path`` of every file of the models below ``root``.

    One task names the models, then tasks list their directories, so the driver holds no
    file. What Spark's readers leave out is left out here. No content is opened.
    Stores that only Spark's readers open are listed by these.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(base)
    try:
        file_system(base.toString())
    except (OSError, ImportError, ValueError):
        return _listed_by_spark(spark, root, base.toString())
    if not system.exists(base) or not system.getFileStatus(base).isDirectory():
        return _listed_by_spark(spark, root, base.toString())
    named = spark.createDataFrame([(base.toString(),)], "root string").mapInArrow(_list_models, "root string, model string")
    # So many partitions even if the names are few bytes: each stands for a directory's files.
    dealt = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(_list_model_files, _FILE_SCHEMA)


def _listed_by_spark(spark: SparkSession, root: str, base: str) -> DataFrame:
    """:func:`list_files` by Spark's reader of binary files. Only its columns ``path`` and
    ``length`` are used, so no content is opened."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("length").alias("size"))
    )
    # Both sides lose their scheme, so file:/x and file:///x compare equal.
    bare = F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:/+", "/")
    prefix = "/" + base.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    below = F.expr("substring(bare, %d)" % (len(prefix) + 1))
    return (
        listed.withColumn("bare", bare)
        .withColumn("below", below)
        .filter(F.contains("below", F.lit("/")))
        .select(
            F.substring_index("below", "/", 1).alias("model"),
            F.expr("substring(below, instr(below, '/') + 1)").alias("rel_path"),
            "size",
            "path",
        )
    )


def _entries(system, folder: str) -> tuple[list, list]:
    """Folders and files of a folder, without those that Spark's readers leave out: hidden
    names and empty files. A folder that has gone holds none."""
    from pyarrow import fs

    def hidden(name: str) -> bool:
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    folders = [x for x in found if x.type == fs.FileType.Directory and (not hidden(x.base_name) or x.base_name.startswith(("_metadata", "_common_metadata")))]
    return folders, [x for x in found if x.type == fs.FileType.File and not hidden(x.base_name) and x.size]


def _list_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for root in batch.column(0).to_pylist():
            names = [x.base_name for x in _entries(*file_system(root))[0]]
            for at in range(0, len(names), _ROWS_A_BATCH):
                part = names[at : at + _ROWS_A_BATCH]
                yield pa.RecordBatch.from_pydict({"root": [root] * len(part), "model": part})


def _list_model_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for root, model in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            top = f"{root.rstrip('/')}/{model}"
            system, inner = file_system(top)
            waiting = [""]
            while waiting:
                below = waiting.pop()
                folders, files = _entries(system, f"{inner}/{below}".rstrip("/"))
                waiting += [f"{below}{x.base_name}/" for x in folders]
                rows += [(model, below + x.base_name, x.size, f"{top}/{below}{x.base_name}") for x in files]
                if len(rows) >= _ROWS_A_BATCH:
                    yield _batch(rows, _FILE_ARROW)
                    rows = []
    if rows:
        yield _batch(rows, _FILE_ARROW)


def file_system(path: str) -> tuple:
    """Arrow's file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def _header_problem(path: str) -> tuple[dict | None, str | None]:
    """The parsed header of one weight file, or what is wrong with it."""
    filesystem, inner = file_system(path)
    with filesystem.open_input_file(inner) as handle:
        prefix = handle.read(_PREFIX_BYTES)
        if len(prefix) < _PREFIX_BYTES:
            return None, "file is shorter than its length prefix"
        (length,) = struct.unpack("<Q", prefix)
        if length > handle.size() - _PREFIX_BYTES:
            return None, "header is truncated"
        if length > MAX_HEADER_BYTES:
            return None, "header is larger than the format allows"
        body = handle.read(length)
    try:
        header = json.loads(body.decode("utf-8"))
    except ValueError:
        return None, "header is not JSON"
    if not isinstance(header, dict):
        return None, "header is not a JSON object"
    return header, None


def _header_tuples(model: str, shard: str, path: str) -> list[tuple]:
    """The tensors of one weight file, or one row that says why it can't be read."""
    try:
        header, issue = _header_problem(path)
    except OSError as error:
        header, issue = None, f"file can't be read: {type(error).__name__}"
    if not issue and any(n != "__metadata__" and not isinstance(e, dict) for n, e in header.items()):
        issue = "header has entries that are no objects"
    if issue:
        return [(model, shard, None, None, None, issue)]
    return [(model, shard, name, e.get("dtype", "?"), e.get("shape", []), None) for name, e in header.items() if name != "__metadata__"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def header_rows(model: str, shard: str, path: str) -> pa.RecordBatch:
    """The tensors of one weight file, or one row that says why it can't be read."""
    return _batch(_header_tuples(model, shard, path), _HEADER_ARROW)


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for model, shard, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += _header_tuples(model, shard, path)
            if len(rows) >= _ROWS_A_BATCH:
                yield _batch(rows, _HEADER_ARROW)
                rows = []
    if rows:
        yield _batch(rows, _HEADER_ARROW)


def read_tensor_headers(files: DataFrame) -> DataFrame:
    """One row per tensor of the weight files at the top of each model directory.

    ``files`` comes from :func:`list_files`. A file whose header cannot be read
    gives one row with ``issue``; the others are read all the same.
    """
    shards = files.filter(is_weights(F.col("rel_path")) & ~F.contains("rel_path", F.lit("/")))
    return shards.select("model", "rel_path", "path").mapInArrow(_read_headers, _HEADER_SCHEMA)


def read_json_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``model, raw`` of the file ``name`` at the top of each model directory."""
    # The metadata path is percent-encoded; a plus sign in it is a plus sign.
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name)
        .text(root, wholetext=True)
        .select(path.alias("path"), F.col("value").alias("raw"))
    )
    parts = F.split("path", "/")
    depth = len([p for p in root.split(":", 1)[-1].split("/") if p])
    below = F.filter(parts, lambda p: (p != "") & ~p.endswith(":"))
    return text.filter(F.size(below) == depth + 2).select(
        F.element_at(below, -2).alias("model"), "raw"
    )
