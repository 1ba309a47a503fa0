import base64
import gzip
import hashlib
import os

from llm_cases import plain
from pyspark.sql import functions as F

from turnmill.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a.example/x", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (3, None, None), (4, "http://c.example/", ""),
    (5, "http://d.example/\r\nWARC-Type: response", "<p>line\r\n\r\nbreaks</p>"), (None, "u", "<p>same</p>"), (None, "v", "only here"),
    (6, "http://e.example/é", "é漢" * 50_000), (7, "w", "twice"), (7, "w", "twice"),
]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, SCHEMA)


def _expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and first.get(html or "") not in (None, i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return out


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    for least in (0, 1, 9):
        index, folder = warc.archive_pages(_pages(spark), min_revisit_bytes=least)
        got = warc.read_records(index, folder).collect()
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted(_expected(PAGES, least), key=str)
        bodies = {(r.page_id, r.url): bytes(r.payload) for r in got if r.record_type == "response"}
        assert bodies[6, "http://e.example/é"].decode() == PAGES[7][2] and bodies[3, None] == b""


def test_archives_are_plain_warc(spark):
    index, folder = warc.archive_pages(_pages(spark).repartition(3))
    rows = index.collect()
    for r in rows:
        with open(os.path.join(folder.removeprefix("file://"), r.file), "rb") as file:
            file.seek(r.offset)
            record = gzip.decompress(file.read(r.length))
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
        assert r.payload_digest.encode() in record
    files = {r.file for r in rows}
    sizes = sum(os.path.getsize(os.path.join(folder.removeprefix("file://"), f)) for f in files)
    assert sizes == sum(r.length for r in rows)


def test_selected_records_only(spark):
    index, folder = warc.archive_pages(_pages(spark))
    got = warc.read_records(index.filter(F.col("page_id").isin(2, 6)), folder, payload=False).collect()
    assert sorted(r.page_id for r in got) == [2, 6]


def test_ranges_are_joined():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 15 + (1 << 20), 5), ("b", 0, 7), ("b", 7, 9 << 20), ("b", 7 + (9 << 20), 1)]
    assert [(f, len(r)) for f, r in warc.coalesced(iter(places))] == [("a", 2), ("a", 1), ("b", 1), ("b", 1), ("b", 1)]


def test_files_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "_FILE_BYTES", 1)
    index, folder = warc.archive_pages(_pages(spark).coalesce(1))
    assert plain(warc.read_records(index, folder, payload=False).collect(), *COLUMNS) == plain(
        [dict(zip(COLUMNS, r, strict=True)) for r in _expected(PAGES)], *COLUMNS
    )


def test_empty_and_clashing(spark):
    index, folder = warc.archive_pages(_pages(spark).limit(0))
    assert warc.read_records(index, folder).collect() == []
    clash = _pages(spark).withColumns({c: F.lit("x") for c in ("sha", "bytes", "first", "file", "offset", "n")})
    index, folder = warc.archive_pages(clash)
    assert index.count() == len(PAGES)
