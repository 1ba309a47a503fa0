"""Reading record files."""

import json

import pytest
from pyspark.errors import PySparkException

from turnmill.operators import ordinals
from turnmill.sources.records import in_read_order, read_records


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def texts(df):
    rows = df.orderBy(*in_read_order(df)).collect()
    return [(r["file"].rsplit("/", 1)[-1], r["ordinal"], json.loads(r["raw"]).get("text")) for r in rows]


def test_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"text":"1"}\n\n   \n {"text":"2"} \n[1]\n"s"\n3\nnull\n{"text":"3"}')
    assert texts(read_records(spark, path)) == [("a.jsonl", 1, "1"), ("a.jsonl", 4, "2"), ("a.jsonl", 9, "3")]


@pytest.mark.parametrize(
    "content, expected",
    [
        ('[{"text":"a"}, 5, "{\\"text\\":\\"s\\"}", null, {"text":"b"}]', [(1, "a"), (5, "b")]),
        ('\n {"text":"a"}\n', [(1, "a")]),
        ("7", []),
        ("[]", []),
        ("[ \n ]", []),
        ('"x"', []),
        ("null", []),
    ],
)
def test_documents(spark, tmp_path, content, expected):
    path = write(tmp_path / "d.json", content)
    assert [t[1:] for t in texts(read_records(spark, path))] == expected


@pytest.mark.parametrize("content", ["[{]", '[{"text":"a"}] x', '{"text":"a"} x', " ", "{bad", '[1],[2]', '[{"text":"a"},]', "[", '[{"text":"a"}'])
def test_bad_document_fails(spark, tmp_path, content):
    path = write(tmp_path / "d.json", content)
    with pytest.raises(PySparkException, match="invalid JSON on line 1 of .*d.json"):
        read_records(spark, path).collect()


def test_zero_byte_document_holds_nothing(spark, tmp_path):
    assert texts(read_records(spark, write(tmp_path / "d.json", ""))) == []


def test_directory(spark, tmp_path):
    write(tmp_path / "a" / "z.jsonl", '{"text":"2"}\n{"text":"3"}')
    write(tmp_path / "a.JSONL", '{"text":"4"}')
    write(tmp_path / "b.Json", '[{"text":"5"}]')
    write(tmp_path / "c.txt", "not read")
    found = texts(read_records(spark, str(tmp_path)))
    assert [t[2] for t in found] == ["2", "3", "4", "5"]


def test_other_suffix_is_a_document(spark, tmp_path):
    assert len(texts(read_records(spark, write(tmp_path / "x.dat", '[{"text":"a"}]')))) == 1


def test_missing_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_records(spark, str(tmp_path / "none"))
    write(tmp_path / "readme.txt", "x")
    with pytest.raises(FileNotFoundError):
        read_records(spark, str(tmp_path))


BAD = ["{bad", '{"text":"a"} x', '{"text":"a"}{"b":1}', '{"text":"a"},{"b":1}', '{"text":"a"}],[', "{'text':'a'}", '{"text":"a\tb"}']


@pytest.mark.parametrize("line", BAD)
def test_bad_line_names_file_and_line(spark, tmp_path, line):
    path = write(tmp_path / "a.jsonl", '{"text":"1"}\n\n' + line + "\n")
    with pytest.raises(PySparkException, match="invalid JSON on line 3 of .*a.jsonl"):
        read_records(spark, path).collect()


def test_bad_line_policies(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"text":"1"}\n' + "\n".join(BAD) + "\n[2]\n")
    assert texts(read_records(spark, path, on_bad_json="skip")) == [("a.jsonl", 1, "1")]
    kept = read_records(spark, path, on_bad_json="quarantine")
    assert kept.filter("problem IS NOT NULL").count() == len(BAD)
    assert kept.count() == len(BAD) + 1
    with pytest.raises(ValueError):
        read_records(spark, path, on_bad_json="ignore")


def test_python_numbers(spark, tmp_path):
    lines = '{"text":"a","x":NaN}\n{"text":"b","x":[Infinity,-Infinity]}\n'
    assert [t[2] for t in texts(read_records(spark, write(tmp_path / "a.jsonl", lines)))] == ["a", "b"]
    document = '[{"text":"a","x":NaN}, {"text":"b"}]'
    assert [t[2] for t in texts(read_records(spark, write(tmp_path / "d.json", document)))] == ["a", "b"]


def test_numbering_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordinals, "_BROADCAST_BLOCKS", 0)
    write(tmp_path / "a.jsonl", '{"text":"1"}\n\n{"text":"3"}')
    write(tmp_path / "b.jsonl", '{"text":"1"}')
    assert [t[1:] for t in texts(read_records(spark, str(tmp_path)))] == [(1, "1"), (3, "3"), (1, "1")]


def test_invalid_utf8_is_bad(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", b'{"text":"\xff"}\n{"text":"ok"}\n')
    rows = read_records(spark, path, on_bad_json="quarantine").orderBy("ordinal").collect()
    assert [r["problem"] for r in rows] == ["invalid UTF-8", None]


@pytest.mark.parametrize(
    "line, size",
    [('{"text":"ok"' + " " * (17 << 20) + "}", 2), ('{"text":"%s"}' % ("a" * (25 << 20)), 25 << 20), ('{"x":[%s0],"text":"ok"}' % ("12345678," * (5 << 20)), 2)],
    ids=["padding", "string", "list"],
)
def test_large_records_are_read(spark, tmp_path, line, size):
    path = write(tmp_path / "a.jsonl", line + '\n{"text":"ab"}\n')
    rows = read_records(spark, path).selectExpr("length(try_variant_get(v, '$.text', 'string')) AS n").collect()
    assert sorted(r["n"] for r in rows) == sorted([size, 2])


def test_beyond_the_variant_limit_the_job_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("turnmill.sources.records.VARIANT_LIMIT_BYTES", 10)
    path = write(tmp_path / "a.jsonl", '{"text":"not closed"\n{"text":"a longer one is fine"}\n')
    with pytest.raises(PySparkException, match="size limit of VARIANT"):
        read_records(spark, path, on_bad_json="skip").collect()


def test_names_are_decoded(spark, tmp_path):
    write(tmp_path / "a b+c%20é.jsonl", '{"text":"1"}\n')
    write(tmp_path / "d e.json", '[{"text":"2"}]')
    assert sorted(t[0] for t in texts(read_records(spark, str(tmp_path)))) == ["a b+c%20é.jsonl", "d e.json"]


@pytest.mark.parametrize("before, after", [(None, "64"), ("64", "1"), ("1", None)])
def test_splits_may_change_before_the_action(spark, tmp_path, before, after):
    """Neither rows nor their numbers depend on how files are split later."""
    name = "spark.sql.files.minPartitionNum"
    for f in range(3):
        write(tmp_path / f"{f}.jsonl", "\n".join("" if i % 9 == 4 else '{"text":"%d"}' % i for i in range(1, 20_001)))

    def use(value):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)

    try:
        use(before)
        records = read_records(spark, str(tmp_path))
        use(after)
        rows = records.selectExpr("record_id", "ordinal", "try_variant_get(v, '$.text', 'int') AS t").collect()
    finally:
        use(None)
    assert len(rows) == len({r["record_id"] for r in rows}) == 3 * sum(i % 9 != 4 for i in range(1, 20_001))
    assert all(r["ordinal"] == r["t"] for r in rows)


def test_line_numbers_across_blocks(spark, tmp_path):
    lines = [("" if i % 7 == 3 else json.dumps({"text": str(i), "pad": "x" * (i % 50)})) for i in range(1, 3001)]
    write(tmp_path / "big.jsonl", "\n".join(lines))
    write(tmp_path / "small.jsonl", '{"text":"1"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = read_records(spark, str(tmp_path))
        rows = records.selectExpr("file", "ordinal", "try_variant_get(v, '$.text', 'string') AS t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(int(r["t"]) == r["ordinal"] for r in rows)
    assert len(rows) == sum(1 for line in lines if line) + 1


def test_spark_written_lines(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.range(20).selectExpr("CAST(id AS STRING) AS text").repartition(3).write.json(out)
    records = read_records(spark, out, json_files="lines")
    assert sorted(int(t[2]) for t in texts(records)) == list(range(20))
    assert records.select("record_id").distinct().count() == 20
