"""Elements of JSON list documents that are larger than a task.

A document is cut into ranges of bytes. Whether a byte is inside a string depends on all
quotes before it, and which list or object it is in on all brackets before it. So each
range is first read as if it began outside a string, and as if it began inside one: it
has its number of quotes, and for both cases the change of depth. The parity of the sum
of quotes tells which case holds for a range, and the sum of depths before it at which
depth it begins. With both known, a task finds the elements that begin in its ranges by
itself, and reads the last one on beyond the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.session import materialize
from turnmill.sources.byte_ranges import _BOM, _opened

# The largest range. Its brackets, commas and quotes are held as arrays.
LIST_RANGE_BYTES = 16 << 20
_CHUNK_BYTES = 1 << 20
_OPEN, _SHUT, _COMMA, _OTHER = 1, -1, 0, 2
_KIND = np.full(256, _OTHER, np.int8)
_KIND[[ord("["), ord("{")]] = _OPEN
_KIND[[ord("]"), ord("}")]] = _SHUT
_KIND[ord(",")] = _COMMA
_BLANK = b" \t\r\n"


def marks(data: np.ndarray, backslashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the quotes that no backslash takes away, and of brackets and commas.
    ``backslashes`` stand directly before the data."""
    quotes = np.flatnonzero(data == ord('"'))
    slashes = np.flatnonzero(data == ord("\\"))
    if len(quotes) and (len(slashes) or backslashes):
        # The length of the run of backslashes that ends before each quote.
        begins = slashes[np.concatenate(([True], np.diff(slashes) > 1))] if len(slashes) else slashes
        before = quotes - 1
        after_slash = np.zeros(len(quotes), bool)
        if len(slashes):
            found = np.searchsorted(slashes, before)
            after_slash = (found < len(slashes)) & (slashes[np.minimum(found, len(slashes) - 1)] == before)
        run = np.zeros(len(quotes), np.int64)
        if after_slash.any():
            begin = begins[np.searchsorted(begins, before[after_slash], "right") - 1]
            run[after_slash] = before[after_slash] - begin + 1 + np.where(begin == 0, backslashes, 0)
        if quotes[0] == 0:
            run[0] = backslashes
        quotes = quotes[run % 2 == 0]
    return quotes, np.flatnonzero(_KIND[data] != _OTHER)


def outside(data: np.ndarray, quotes: np.ndarray, places: np.ndarray, in_string: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``places`` outside strings, and their kinds."""
    own = places[(np.searchsorted(quotes, places) + in_string) % 2 == 0]
    return own, _KIND[data[own]].astype(np.int64)


def _backslashes_before(handle, start: int) -> int:
    count = 0
    while count < start:
        step = min(1 << (6 + min(count.bit_length(), 14)), start - count)
        handle.seek(start - count - step)
        data = handle.read(step)
        run = len(data) - len(data.rstrip(b"\\"))
        count += run
        if run < step:
            break
    return count


def _range_bytes(handle, row: dict) -> tuple[np.ndarray, int]:
    """The bytes of a range and the backslashes before it; a byte-order mark reads as blanks."""
    lead = _backslashes_before(handle, row["start"])
    handle.seek(row["start"])
    data = handle.read(row["stop"] - row["start"])
    if row["start"] == 0 and data.startswith(_BOM):
        data = b"   " + data[len(_BOM) :]
    return np.frombuffer(data, np.uint8), lead


_SUMMARY = ["quotes", "first", *(f"{c}_{case}" for case in ("out", "in") for c in ("change", "low", "at_low", "above_low", "at_one"))]


def summary(data: np.ndarray, backslashes: int) -> list[int]:
    """Quotes; the first byte that is no blank (-1: none); then, for a range that begins
    outside a string and for one that begins inside: the change of depth, the lowest depth
    against the beginning, and the commas at that depth, one above it, and at depth 1.

    No byte of a list is below its depth of 1 but the end, so these three are enough to
    know the list's own commas, whatever the depth at the beginning turns out to be.
    """
    quotes, places = marks(data, backslashes)
    solid = np.flatnonzero(~np.isin(data, np.frombuffer(_BLANK, np.uint8)))
    row = [len(quotes), int(data[solid[0]]) if len(solid) else -1]
    for in_string in (0, 1):
        _, kinds = outside(data, quotes, places, in_string)
        depth = np.cumsum(kinds)
        low = min(0, int(depth.min())) if len(depth) else 0
        commas = depth[kinds == _COMMA]
        row += [int(depth[-1]) if len(depth) else 0, low, *(int((commas == d).sum()) for d in (low, low + 1, 1))]
    return row


def place_ranges(ranges: DataFrame, tasks: int) -> DataFrame:
    """The ranges of files with ``is_list``, ``begun`` (the list began before the range),
    ``in_string``, ``depth`` and ``commas`` (the list's own, before the range). Files of one
    range are not read for it; their ``is_list`` is null."""
    kept = ["file", "path", "size", "start", "stop"]
    none = {"is_list": "boolean", "begun": "boolean", "in_string": "int", "depth": "long", "commas": "long"}
    start = [F.lit(None if c == "is_list" else 0).cast(t).alias(c) for c, t in none.items()]
    small = ranges.filter("stop - start = size").select(*kept, *start)
    large = ranges.filter("stop - start < size")
    return small if large.isEmpty() else small.union(_placed(large, tasks))


def _placed(ranges: DataFrame, tasks: int) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own = row.to_pylist()[0]
                with _opened(own) as handle:
                    found = summary(*_range_bytes(handle, own))
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([x], pa.int64()) for x in found)], [*row.schema.names, *_SUMMARY])

    kept = ["file", "path", "size", "start", "stop"]
    schema = "file string, path string, size long, start long, stop long, " + ", ".join(f"{c} long" for c in _SUMMARY)
    read = materialize(ranges.repartition(tasks).mapInArrow(run, schema), "list-ranges")
    in_file = W.partitionBy("file").orderBy("start")
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    solid = F.first(F.when(F.col("first") >= 0, F.col("first")), ignorenulls=True)
    read = read.withColumns(
        {
            "in_string": (earlier("quotes") % 2).cast("int"),
            "is_list": F.coalesce(solid.over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == ord("["), F.lit(False)),
            "begun": F.coalesce(F.max(F.col("first") >= 0).over(before), F.lit(False)),
        }
    )
    case = lambda c: F.when(F.col("in_string") == 0, F.col(f"{c}_out")).otherwise(F.col(f"{c}_in"))
    read = read.select(*kept, "is_list", "begun", "in_string", *[case(c).alias(c) for c in ("change", "low", "at_low", "above_low", "at_one")])
    read = read.withColumn("depth", earlier("change"))
    own = F.lit(1) - F.col("depth")
    commas = F.when(F.col("depth") == 0, F.col("at_one")).when(own == F.col("low"), F.col("at_low")).when(own == F.col("low") + 1, F.col("above_low")).otherwise(F.lit(0))
    read = read.withColumn("own_commas", commas)
    return read.select(*kept, "is_list", "begun", "in_string", "depth", earlier("own_commas").alias("commas"))


def _separators(data: np.ndarray, backslashes: int, in_string: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Places and kinds of what separates the list's elements; depths at all brackets and
    commas; and whether a string is open and which depth holds at the end."""
    quotes, places = marks(data, backslashes)
    places, kinds = outside(data, quotes, places, in_string)
    depths = depth + np.cumsum(kinds)
    own = ((kinds == _OPEN) & (depths == 1)) | ((kinds == _COMMA) & (depths <= 1)) | ((kinds == _SHUT) & (depths <= 0))
    return places[own], kinds[own], depths[own], (in_string + len(quotes)) % 2, int(depths[-1]) if len(depths) else depth


def elements(handle, row: dict) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, ordinal, text) of the list's elements that begin in a range; a text of None
    says that the document is no list after all."""
    data, lead = _range_bytes(handle, row)
    places, kinds, depths, in_string, depth = _separators(data, lead, row["in_string"], row["depth"])
    raw = data.tobytes()
    broken = (0, 1, None)
    if row["begun"] and row["depth"] == 0 and not row["in_string"]:
        # Behind the end of the list.
        if raw.strip(_BLANK):
            yield broken
        return
    # One list and nothing behind it: it begins with [, ends with ], and is not left before.
    ends = np.flatnonzero((kinds == _SHUT) | (depths < 1))
    if len(ends):
        last = int(ends[0])
        whole = last == len(places) - 1 and kinds[last] == _SHUT and depths[last] == 0
        if not whole or raw[places[last] : places[last] + 1] != b"]" or raw[places[last] + 1 :].strip(_BLANK):
            yield broken
            return
    if len(kinds) > 1 and (kinds[1:] == _OPEN).any():
        yield broken
        return
    number = row["commas"]
    for i, (place, kind) in enumerate(zip(places.tolist(), kinds.tolist(), strict=True)):
        if kind == _SHUT:
            return
        number += kind == _COMMA
        first = row["start"] + place + 1
        if i + 1 < len(places):
            text, closed = raw[place + 1 : places[i + 1]], kinds[i + 1] == _SHUT
        else:
            trailing = len(raw) - len(raw.rstrip(b"\\"))
            more, end = _read_on(handle, row, trailing + (lead if trailing == len(raw) else 0), in_string, depth)
            if end is None:
                yield broken
                return
            text, closed = raw[place + 1 :] + more, end == _SHUT
        body = text.strip(_BLANK)
        if kind == _OPEN and closed and not body:
            # An empty list.
            continue
        yield first + len(text) - len(text.lstrip(_BLANK)), number + 1, body


def _read_on(handle, row: dict, backslashes: int, in_string: int, depth: int) -> tuple[bytes, int | None]:
    """What is behind a range up to the next separator, and its kind; None at the file's end."""
    at, parts, chunk = row["stop"], [], _CHUNK_BYTES
    handle.seek(at)
    while at < row["size"]:
        raw = handle.read(min(chunk, row["size"] - at))
        at += len(raw)
        data = np.frombuffer(raw, np.uint8)
        places, kinds, _, in_string, depth = _separators(data, backslashes, in_string, depth)
        if len(places):
            parts.append(raw[: places[0]])
            return b"".join(parts), int(kinds[0])
        parts.append(raw)
        trailing = len(raw) - len(raw.rstrip(b"\\"))
        backslashes = trailing + (backslashes if trailing == len(raw) else 0)
        chunk = min(2 * chunk, LIST_RANGE_BYTES)
    return b"", None


def read_elements(placed: DataFrame, tasks: int) -> DataFrame:
    """``file, offset, ordinal, raw, broken`` of the documents' records.

    ``placed`` comes from :func:`place_ranges`. A document that is no list is one record,
    read whole by one task. ``broken`` marks a row that only says that the document is not
    well-formed; its ``raw`` is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["offset", "ordinal", "raw"], [pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row) as handle:
                    found: list | Iterator = []
                    is_list = row["is_list"]
                    if is_list is None:
                        is_list = handle.read().removeprefix(_BOM).lstrip(_BLANK).startswith(b"[")
                        handle.seek(0)
                    if is_list:
                        found = elements(handle, row)
                    elif row["start"] == 0:
                        found = [(0, 1, handle.read().removeprefix(_BOM).strip(_BLANK))]
                    step, size = [], 0
                    for one in found:
                        step.append(one)
                        size += len(one[2] or b"")
                        if size >= _CHUNK_BYTES:
                            yield _batch(row["file"], step, names, types)
                            step, size = [], 0
                    if step:
                        yield _batch(row["file"], step, names, types)

    return placed.repartition(tasks).mapInArrow(run, "file string, offset long, ordinal long, raw binary, broken boolean")


def _batch(file: str, rows: list, names: list[str], types: list) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    broken = pa.array([raw is None for *_, raw in rows])
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), len(rows)), *columns, broken], ["file", *names, "broken"])
