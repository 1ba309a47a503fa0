"""WARC archives with an index that is written first and read by ranges.

Each task writes its records as gzip members of archive files in a shared folder
and returns one index row a record: file, offset, length, URL and digest. Reading
starts from the index: the wanted records are sorted by place, neighbouring byte
ranges are read together, and each record is decoded and checked.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import whole
from turnmill.session import materialize, new_folder

_FILE_BYTES = 512 << 20
# Ranges closer than this are read in one go, up to so many bytes.
_GAP_BYTES = 64 << 10
_READ_BYTES = 8 << 20
# Index rows of one window of a file are read by one task.
_WINDOW_BYTES = 8 << 20
# A task reads archives of about so many bytes.
_TASK_BYTES = 32 << 20
_ROWS_A_STEP = 256

# Fixed values of the format.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = (
    "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if re.match(r"^\w+:", uri) else f"file://{uri}")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _header_value(text: str) -> str:
    """Control characters would break the header lines."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", text)


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        _VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_header_value(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(x) -> int | None:
    return None if x is None or x != x else int(x)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); the index as rows.

    Payload is the html in UTF-8, a null html the empty payload. Of equal payloads
    of at least ``min_revisit_bytes`` the smallest page_id is a response and the
    others revisit it; rows that share that page_id are all responses, and a null
    page_id is one only if its payload has no other. A null URL gets no target
    line. Evaluate the result once: every evaluation writes files of its own, and
    only those of tasks that succeeded are in the index.
    """
    body = whole(F.col("html"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"),
        F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("bytes"),
    )
    repeats = (
        rows.filter(F.col("bytes") >= min_revisit_bytes)
        .groupBy("sha", "bytes")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # Written first, so that the join knows its size and pages need not be shuffled
    # when few payloads repeat.
    placed = rows.join(materialize(repeats, "repeats"), ["sha", "bytes"], "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, first in zip(batch["page_id"].astype(object), batch["url"], batch["html"], batch["first"].astype(object), strict=True):
                    if out is None or at >= _FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    page_id, first = _number(page_id), _number(first)
                    payload = html.encode()
                    digest = _digest(payload)
                    revisit = first is not None and page_id != first
                    data = gzip.compress(_record(page_id, url, payload, digest, first, revisit), 5, mtime=0)
                    out.write(data)
                    index.append((page_id, name, at, len(data), url, digest, "revisit" if revisit else "response"))
                    at += len(data)
                yield pd.DataFrame(index, columns=["page_id", "file", "offset", "length", "url", "payload_digest", "record_type"], dtype=object)
        finally:
            if out is not None:
                out.close()

    return placed.select("page_id", "url", "html", "first").mapInPandas(write, INDEX_SCHEMA)


def _parse(data: bytes) -> dict:
    head, _, block = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != _VERSION:
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn and urn != _urn(None) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def coalesced(places: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) joined into reads of neighbouring ranges."""
    file, run = None, []
    for name, offset, length in places:
        near = name == file and offset - (run[-1][0] + run[-1][1]) <= _GAP_BYTES and offset + length - run[0][0] <= _READ_BYTES
        if run and not near:
            yield file, run
            run = []
        file = name
        run.append((offset, length))
    if run:
        yield file, run


def read_records(index: DataFrame, folder: str, *, payload: bool = True) -> DataFrame:
    """The records of the given index rows, with their payload if asked for.

    A revisit has no payload; its size and digest are those of the full payload,
    from its headers. Control characters of URLs come back percent-encoded. A
    record that doesn't match its digest fails the job.
    """
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(folder)
        places = (p for b in batches for p in zip(b["file"], b["offset"].tolist(), b["length"].tolist(), strict=True))
        rows, opened, source = [], None, None
        for file, run in coalesced(places):
            if file != opened:
                if source is not None:
                    source.close()
                opened, source = file, store.open_input_file(f"{path}/{file}")
            start = run[0][0]
            source.seek(start)
            data = source.read(run[-1][0] + run[-1][1] - start)
            for offset, length in run:
                rows.append(_parse(data[offset - start : offset - start + length]))
                if len(rows) == _ROWS_A_STEP:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    window = F.floor(F.col("offset") / _WINDOW_BYTES)
    places = index.select("file", "offset", "length", window.alias("window"))
    # The index is small against the archives, so their bytes decide how many tasks read.
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_distinct("file", "window").alias("windows")).first()
    tasks = max(-(-size["bytes"] // _TASK_BYTES), min(size["windows"], 2 * index.sparkSession.sparkContext.defaultParallelism), 1)
    places = places.repartition(int(tasks), "file", "window")
    return places.sortWithinPartitions("file", "offset").drop("window").mapInPandas(read, schema + (", payload binary" if payload else ""))


def archive_pages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write all pages, then their index as a table; the index and the archive folder."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return materialize(write_archives(pages, folder, min_revisit_bytes), "warc-index"), folder
