"""Lines of files by byte range.

A file is cut into ranges of bytes, and a task reads the lines that begin in its
ranges. A line is known by its file and the byte it begins at, which no split changes,
so identity needs neither a second pass nor a copy of the text. Line numbers do need
one: the lines of each range are counted first, and a range starts from the sum of
those before it.

Files are opened from the tasks with Arrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.session import materialize
from turnmill.sources.model_files import file_system

# The largest range, and what opening a file counts for when ranges are dealt to tasks.
RANGE_BYTES = 64 << 20
OPEN_BYTES = 4 << 20
_CHUNK_BYTES = 8 << 20
_BOM = b"\xef\xbb\xbf"
# Schemes that Arrow has a file system for.
_SCHEMES = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")


def arrow_opens(path: str) -> bool:
    """Whether tasks can open a qualified path themselves."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return scheme is None or scheme[1].lower() in _SCHEMES


def file_name() -> Column:
    """The path as it is named; metadata has it percent-encoded, plus signs excepted."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file")


def byte_ranges(spark: SparkSession, path: str, range_bytes: int | None = None, **options) -> tuple[DataFrame, int]:
    """``file, path, size, start, stop`` of the ranges of the files, listed once, and how many
    tasks their bytes ask for.

    Without ``range_bytes`` small inputs are cut finer, to keep all cores busy.
    """
    listed = spark.read.format("binaryFile").options(**options).load(path)
    files = materialize(listed.select(file_name(), "path", F.col("length").alias("size")).filter("size > 0"), "files")
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    if range_bytes is None:
        share = (total["bytes"] + total["files"] * OPEN_BYTES) // max(spark.sparkContext.defaultParallelism, 1)
        range_bytes = min(RANGE_BYTES, max(OPEN_BYTES, share))
    count = total["files"] + total["bytes"] // range_bytes
    # Small ranges and small files share a task.
    tasks = max(1, min(count, (total["bytes"] + total["files"] * OPEN_BYTES) // max(range_bytes, OPEN_BYTES) + 1))
    step = F.lit(range_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)
    cut = files.select("file", "path", "size", F.explode(starts).alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + step, "size")), int(tasks)


def _line_ends(data: bytes, is_last: bool) -> np.ndarray:
    """Where lines end, their terminator included: LF, CR, or both."""
    arr = np.frombuffer(data, np.uint8)
    ends = arr == 10
    returns = np.flatnonzero(arr == 13)
    if len(returns):
        # The byte after the last one is not known yet.
        known = returns[returns < len(arr) - 1]
        ends[known[arr[known + 1] != 10]] = True
        if is_last and returns[-1] == len(arr) - 1:
            ends[-1] = True
    return np.flatnonzero(ends) + 1


def line_bounds(handle, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(place of the bytes in the file, bytes, bounds in them) of the lines that begin in
    [start, stop). The last may go on beyond it. Reads some megabytes at a time, more only
    for a longer line."""
    # The byte before tells whether a line begins at `start`.
    at = base = max(start - 1, 0)
    handle.seek(at)
    rest, begun, chunk = b"", start == 0, _CHUNK_BYTES
    while at < size:
        data = handle.read(min(chunk, size - at))
        if not data:
            raise OSError("the file is shorter than it was when it was listed")
        at += len(data)
        buffer = rest + data
        ends = _line_ends(buffer, at == size)
        if at == size and not (len(ends) and ends[-1] == len(buffer)):
            ends = np.append(ends, len(buffer))
        if not begun and not len(ends):
            if at - 1 >= stop:
                return
            rest, base = buffer[-1:], at - 1
            continue
        bounds = np.concatenate(([0], ends)) if begun else ends
        begun = True
        lines = int(np.searchsorted(base + bounds[:-1], stop))
        if lines:
            yield base, buffer, bounds[: lines + 1]
        if lines < len(bounds) - 1 or base + bounds[-1] >= stop:
            return
        chunk = _CHUNK_BYTES if lines else 2 * chunk
        rest, base = buffer[bounds[-1] :], base + int(bounds[-1])


def _opened(row: dict):
    filesystem, inner = file_system(row["path"])
    return filesystem.open_input_file(inner)


_RANGE = "file string, path string, size long, start long, stop long"


def count_lines(ranges: DataFrame, tasks: int) -> DataFrame:
    """The ranges with ``first``, the number of the first line that begins in each, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own = row.to_pylist()[0]
                with _opened(own) as handle:
                    lines = sum(len(bounds) - 1 for *_, bounds in line_bounds(handle, own["size"], own["start"], own["stop"]))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([lines], pa.int64())], [*row.schema.names, "lines"])

    counted = materialize(ranges.repartition(tasks).mapInArrow(run, _RANGE + ", lines long"), "line-counts")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1
    return counted.select("file", "path", "size", "start", "stop", first.alias("first"))


def read_range_lines(ranges: DataFrame, tasks: int) -> DataFrame:
    """``file, offset, ordinal, raw`` of every line, blank ones included; ``raw`` is binary
    and ends with the line's terminator. ``ordinal`` is null unless the ranges come from
    :func:`count_lines`. A byte-order mark at the start of a file is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = row.get("first")
                with _opened(row) as handle:
                    for base, data, bounds in line_bounds(handle, row["size"], row["start"], row["stop"]):
                        count = len(bounds) - 1
                        offsets = base + bounds[:-1]
                        ordinals = pa.nulls(count, pa.int64())
                        if number is not None:
                            ordinals = pa.array(np.arange(number, number + count))
                            number += count
                        if base == 0 and bounds[0] == 0 and data.startswith(_BOM):
                            bounds = np.concatenate(([len(_BOM)], bounds[1:]))
                        # The lines are the bytes between the bounds, as they were read.
                        raw = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
                        columns = [pa.repeat(pa.scalar(row["file"]), count), pa.array(offsets, pa.int64()), ordinals, raw]
                        yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "ordinal", "raw"])

    return ranges.repartition(tasks).mapInArrow(run, "file string, offset long, ordinal long, raw binary")
