"""Lines and list elements by byte range: the same under any ranges."""

import io
import json
import random

import numpy as np
import pytest
from conftest import plan_of
from pyspark.errors import PySparkException

from turnmill.sources import byte_ranges, json_lists
from turnmill.sources.byte_ranges import arrow_opens, line_bounds
from turnmill.sources.json_lists import elements, marks, summary
from turnmill.sources.records import read_records


def split_lines(data):
    """(offset, line) of the lines that LF, CR or both end, without the terminators."""
    out, at = [], 0
    for line in _keepends(data):
        out.append((at, line.rstrip(b"\r\n")))
        at += len(line)
    return out


def _keepends(data):
    out, start, i = [], 0, 0
    while i < len(data):
        if data[i : i + 2] == b"\r\n":
            i += 1
        if data[i : i + 1] in (b"\r", b"\n"):
            out.append(data[start : i + 1])
            start = i + 1
        i += 1
    return [*out, data[start:]] if start < len(data) else out


def read_ranges(data, size):
    out = []
    for start in range(0, len(data), size):
        for base, buffer, bounds in line_bounds(io.BytesIO(data), len(data), start, min(start + size, len(data))):
            out += [(base + a, buffer[a:b].rstrip(b"\r\n")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


@pytest.mark.parametrize("chunk", [3, 17, 1 << 20])
def test_lines_are_the_same_under_any_ranges(monkeypatch, chunk):
    monkeypatch.setattr(byte_ranges, "_CHUNK_BYTES", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        data = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r", b"\r\n", b"\xc3\xa9", b"x" * 40]) for _ in range(rng.randint(0, 60)))
        wanted = split_lines(data)
        for size in (1, 2, 5, 7, 64, 1000):
            assert read_ranges(data, size) == wanted, (data, size)


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df):
    return sorted((r["record_id"].rsplit("/", 1)[-1], r["offset"], r["ordinal"], r["raw"]) for r in df.select("record_id", "offset", "ordinal", "raw").collect())


@pytest.mark.parametrize("numbers", [True, False])
def test_line_ids_do_not_depend_on_ranges(spark, tmp_path, numbers):
    lines = ["" if i % 7 == 3 else json.dumps({"text": f"é{i}", "pad": "x" * (i * 37 % 500)}) + "\r" * (i % 2) for i in range(1, 400)]
    write(tmp_path / "big.jsonl", "\ufeff" + "\n".join(lines))
    write(tmp_path / "small.jsonl", '{"text":"1"}')
    found = [rows(read_records(spark, str(tmp_path), numbers=numbers, range_bytes=n)) for n in (512, 9973, None)]
    assert found[0] == found[1] == found[2] and len(found[0]) == sum(1 for x in lines if x) + 1
    data = (tmp_path / "big.jsonl").read_bytes()
    for record_id, offset, ordinal, raw in found[0]:
        if record_id.startswith("big"):
            assert record_id == f"big.jsonl#{offset}" and data[offset:].removeprefix(b"\xef\xbb\xbf").startswith(raw.encode())
            assert ordinal == (data[:offset].count(b"\n") + 1 if numbers else None)


def test_no_copy_of_the_text_is_written(spark, tmp_path):
    from turnmill import session

    write(tmp_path / "a.jsonl", "\n".join('{"text":"%d"}' % i for i in range(2000)))
    before = len(session._made)
    records = read_records(spark, str(tmp_path), range_bytes=1000)
    names = {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in session._made[before:]}
    assert records.count() == 2000 and names == {"files", "line-counts"}
    before = len(session._made)
    plan = plan_of(read_records(spark, str(tmp_path), numbers=False))
    assert {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in session._made[before:]} == {"files"}
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_errors_name_the_byte_without_numbers(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"text":"1"}\n\n{bad\n')
    with pytest.raises(PySparkException, match="invalid JSON at byte 14 of .*a.jsonl"):
        read_records(spark, path, numbers=False).collect()


@pytest.mark.parametrize(("path", "opens"), [("/a/b", True), ("file:/a", True), ("s3a://b/k", True), ("viewfs://x/y", False), ("dbfs:/x", False)])
def test_schemes(path, opens):
    assert arrow_opens(path) is opens


def test_files_only_spark_opens_are_read_as_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("turnmill.sources.records.arrow_opens", lambda path: False)
    write(tmp_path / "a.jsonl", '{"text":"1"}\n\n{"text":"2"}')
    write(tmp_path / "b.json", '[{"text":"3"}, 4, {"text":"5"}]')
    found = read_records(spark, str(tmp_path)).select("ordinal", "offset").collect()
    assert sorted((r["ordinal"], r["offset"]) for r in found) == [(1, None), (1, None), (3, None), (3, None)]


VALUES = [1, None, True, "", "a,b", '[{"', '\\"', "\\", "\\\\\"]", {}, [], {"a": [1, {"b": "],[}"}]}, {"text": "é\u2028漢"}, [[[]]], -1.5e300, {"text": 'say "hi" \\'}]


def random_list(rng):
    dump = lambda v: json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2]))
    blank = lambda: rng.choice(["", "", " ", "\n\t ", "\r\n"])
    body = ",".join(blank() + dump(rng.choice(VALUES)) + blank() for _ in range(rng.randint(0, 25)))
    return blank() + "[" + (body or blank()) + "]" + blank()


def place(data, size):
    """What the tables of :func:`place_ranges` hold, in a loop."""
    out, quotes, depth, commas, begun = [], 0, 0, 0, False
    for start in range(0, len(data), size):
        stop = min(start + size, len(data))
        lead = len(data[:start]) - len(data[:start].rstrip(b"\\"))
        found = summary(np.frombuffer(data[start:stop], np.uint8), lead)
        case = quotes % 2
        change, low, at_low, above, one = found[2 + 5 * case : 7 + 5 * case]
        own = 1 - depth
        out.append({"start": start, "stop": stop, "size": len(data), "in_string": case, "depth": depth, "commas": commas, "begun": begun})
        commas += one if depth == 0 else at_low if own == low else above if own == low + 1 else 0
        quotes, depth, begun = quotes + found[0], depth + change, begun or found[1] >= 0
    return out


def read_list(data, size):
    return [x for row in place(data, size) for x in elements(io.BytesIO(data), row)]


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_elements_are_the_same_under_any_ranges(monkeypatch, chunk):
    monkeypatch.setattr(json_lists, "_CHUNK_BYTES", chunk)
    rng = random.Random(chunk)
    for _ in range(150):
        text = random_list(rng)
        data = text.encode()
        wanted = json.loads(text)
        for size in (1, 2, 3, 7, 31, 4096):
            found = sorted(read_list(data, size))
            assert [n for _, n, _ in found] == list(range(1, len(wanted) + 1)), (text, size)
            assert [json.loads(raw) for *_, raw in found] == wanted
            assert all(data[at:].startswith(raw) for at, _, raw in found)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 64])
def test_malformed_lists_are_noticed(size):
    """Some element does not parse, or the document is called broken, wherever it is cut."""
    rng = random.Random(size)

    def well_formed(data):
        for _, _, raw in read_list(data, size):
            if raw is None:
                return False
            try:
                json.loads(raw)
            except ValueError:
                return False
        return True

    for _ in range(400):
        text = random_list(rng).strip()
        at = rng.randrange(1, len(text) + 1)
        text = text[:at] + rng.choice(["", ",", "]", "}", "[", '"', "x", "]]", "\\"]) + text[at + rng.randint(0, 2) :]
        try:
            good = isinstance(json.loads(text), list)
        except ValueError:
            good = False
        assert well_formed(text.encode()) == good, text


def test_quotes_behind_backslashes():
    for text in ('"', '\\"', '\\\\"', '\\\\\\"', 'a\\"b"c\\\\"'):
        for cut in range(len(text) + 1):
            whole = {i for i in range(len(text)) if text[i] == '"' and (len(text[:i]) - len(text[:i].rstrip("\\"))) % 2 == 0}
            lead = len(text[:cut]) - len(text[:cut].rstrip("\\"))
            quotes, _ = marks(np.frombuffer(text[cut:].encode(), np.uint8), lead)
            assert {cut + i for i in quotes.tolist()} == {i for i in whole if i >= cut}


@pytest.mark.parametrize("policy", ["fail", "skip", "quarantine"])
def test_document_in_many_ranges(spark, tmp_path, policy):
    records = [{"text": f"é{i} \\ \"", "pad": ["x" * (i * 31 % 300)]} if i % 5 else i for i in range(300)]
    path = write(tmp_path / "d.json", "\ufeff" + json.dumps(records, indent=1, ensure_ascii=False))
    size = (tmp_path / "d.json").stat().st_size
    one, many = (rows(read_records(spark, path, on_bad_json=policy, range_bytes=n)) for n in (1 << 30, size // 9))
    assert one == many and len(one) == 240
    assert [(n, json.loads(raw)) for _, _, n, raw in sorted(one, key=lambda r: r[2])] == [(i + 1, r) for i, r in enumerate(records) if i % 5]


@pytest.mark.parametrize("tail", ["}", "] x", ",]", "", ', {"text": bad}]'])
def test_bad_document_in_many_ranges(spark, tmp_path, tail):
    body = "[" + ", ".join(json.dumps({"text": str(i)}) for i in range(200)) + tail
    path = write(tmp_path / "in" / "d.json", body)
    write(tmp_path / "in" / "good.json", '[{"text":"ok"}]')
    with pytest.raises(PySparkException, match="invalid JSON on line 1 of .*d.json"):
        read_records(spark, path, range_bytes=300).collect()
    folder = str(tmp_path / "in")
    assert [r[3] for r in rows(read_records(spark, folder, on_bad_json="skip", range_bytes=300))] == ['{"text":"ok"}']
    kept = read_records(spark, folder, on_bad_json="quarantine", range_bytes=300).select("ordinal", "raw", "problem").collect()
    # The text of a document larger than a range does not come with its reason.
    assert sorted(map(tuple, kept), key=str) == [(1, '{"text":"ok"}', None), (1, None, "invalid JSON")]
    kept = read_records(spark, folder, on_bad_json="quarantine").select("ordinal", "raw", "problem").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, '{"text":"ok"}', None), (1, body, "invalid JSON")], key=str)


def test_beyond_the_limit_is_a_reason_in_quarantine(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("turnmill.sources.records.VARIANT_LIMIT_BYTES", 10)
    path = write(tmp_path / "a.jsonl", '{"text":"not closed"\n{"text":"a longer one is fine"}\n')
    kept = read_records(spark, path, on_bad_json="quarantine").orderBy("ordinal").collect()
    assert [r["problem"] for r in kept] == ["a record is beyond the size limit of VARIANT", None]
