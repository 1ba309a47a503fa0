"""Read raw JSON records from files and directories.

``.jsonl`` files hold a record a line. A ``.json`` file holds one document, a list of
records or a single record. Both are read in byte ranges, many tasks to a large file;
a record is known by its file and the byte it begins at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import sql
from turnmill.functions.json import VARIANT_LIMIT_BYTES, parse_strict, parse_strict_list
from turnmill.operators.ordinals import number_lines
from turnmill.operators.staging import with_computed
from turnmill.session import configure, materialize
from turnmill.sources.byte_ranges import arrow_opens, byte_ranges, count_lines, file_name, read_range_lines
from turnmill.sources.json_lists import LIST_RANGE_BYTES, place_ranges, read_elements

LINE_FILES = "*.[jJ][sS][oO][nN][lL]"
DOCUMENT_FILES = "*.[jJ][sS][oO][nN]"


def _file_status(spark: SparkSession, path: str):
    """The Hadoop file status, so any file system Spark can read works."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        raise FileNotFoundError(f"no such path: {path}")
    return fs.getFileStatus(hadoop_path)


def _provenance() -> list[Column]:
    return [
        file_name(),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    ]


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every line of the line files with where it came from; blank lines included."""
    scan = spark.read.options(**options).text(path)
    return scan.select(*_provenance(), F.expr(sql.strip("value")).alias("raw"))


# The reason of a record that has no value and is so long that it may be the parser's
# limit and not the record's fault.
BEYOND_LIMIT = "a record is beyond the size limit of VARIANT"


def _malformed(raw: Column, value: Column, utf8: Column) -> Column:
    return (
        F.when(~utf8, F.lit("invalid UTF-8"))
        .when(value.isNull() & (F.octet_length(raw) > VARIANT_LIMIT_BYTES), F.lit(BEYOND_LIMIT))
        .when(value.isNull(), F.lit("invalid JSON"))
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse non-blank lines into ``v``; ``problem`` says why one could not be."""
    present = lines.filter(F.col("raw") != "")
    parsed = with_computed(present, v=F.expr(parse_strict("raw")))
    return parsed.withColumn("problem", _malformed(F.col("raw"), F.col("v"), F.is_valid_utf8("raw")))


def read_documents(
    spark: SparkSession, path: str, *, on_bad_json: str = "fail", range_bytes: int | None = None, **options
) -> DataFrame:
    """Records of the JSON document files: ``file, offset, ordinal, raw, v, problem``.

    Records of a list are numbered from 1. A document that is not well-formed is one bad
    record, number 1, and none of its elements comes out, wherever the fault is; unless the
    job fails anyway, that is looked for in a pass of its own. The bad record's ``raw`` is the
    document, or null for one that is larger than a range.
    """
    ranges, tasks = byte_ranges(spark, path, range_bytes or LIST_RANGE_BYTES, **options)
    found = read_elements(place_ranges(ranges, tasks), tasks)
    found = found.withColumn("raw", F.col("raw").cast("string"))
    parsed = with_computed(found, v=F.expr(parse_strict("raw")))
    problem = F.when(F.col("broken"), F.lit("invalid JSON")).otherwise(_malformed(F.col("raw"), F.col("v"), F.is_valid_utf8("raw")))
    parsed = parsed.select("file", "offset", "ordinal", "raw", "v", problem.alias("problem"))
    if on_bad_json == "fail":
        return parsed.withColumn("ordinal", F.when(F.col("problem").isNull(), F.col("ordinal")).otherwise(F.lit(1)))
    # Broken documents are few; the largest reason in order stands for all of a document's.
    bad = materialize(parsed.filter("problem IS NOT NULL").groupBy("file").agg(F.max("problem").alias("problem")), "bad-documents")
    good = parsed.join(bad.select("file"), "file", "left_anti")
    whole = spark.read.options(**options).text(path, wholetext=True).filter(F.col("_metadata.file_size") <= (range_bytes or LIST_RANGE_BYTES))
    texts = whole.select(file_name(), F.expr(sql.strip("value")).alias("raw"))
    none = [F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("ordinal")]
    rejected = bad.join(texts, "file", "left").select("file", *none, "raw", F.lit(None).cast("variant").alias("v"), "problem")
    return good.select(rejected.columns).union(rejected)


def _whole_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same from files that only Spark can open: a document is read by one task."""
    documents = (
        spark.read.options(**options)
        .text(path, wholetext=True)
        .select(file_name(), F.expr(sql.strip("value")).alias("raw"))
    )
    elements = f"""CASE WHEN startswith(raw, '[') THEN {parse_strict_list("raw")}
        ELSE array({parse_strict("raw")}) END"""
    parsed = with_computed(documents, elements=F.expr(elements))
    bad = F.expr("elements IS NULL OR (NOT startswith(raw, '[') AND elements[0] IS NULL)")
    exploded = parsed.select(
        "file",
        F.when(bad, F.col("raw")).alias("bad_document"),
        F.is_valid_utf8("raw").alias("utf8"),
        F.posexplode_outer("elements").alias("index", "v"),
    )
    return exploded.select(
        "file",
        F.lit(None).cast("long").alias("offset"),
        (F.coalesce("index", F.lit(0)) + 1).cast("bigint").alias("ordinal"),
        F.coalesce("bad_document", F.to_json("v")).alias("raw"),
        "v",
        F.when(~F.col("utf8"), F.lit("invalid UTF-8"))
        .when(F.col("bad_document").isNotNull(), F.lit("invalid JSON"))
        .alias("problem"),
    )


def read_records(
    spark: SparkSession,
    path: str,
    *,
    on_bad_json: str = "fail",
    json_files: str = "document",
    line_files: str = LINE_FILES,
    document_files: str = DOCUMENT_FILES,
    numbers: bool = True,
    range_bytes: int | None = None,
) -> DataFrame:
    """Raw records under ``path``: a file, or a directory searched recursively.

    Columns: ``record_id`` (file and place), ``file``, ``offset`` (the byte at which the
    record's line or list element begins), ``ordinal`` (line number, or index in a document),
    ``raw`` and the parsed ``v``. Values that are not objects are left out.

    ``numbers=False`` leaves line numbers out (null): they take a pass that counts the lines
    of every range. Errors then name the byte instead of the line. Neither rows nor ids
    depend on ``range_bytes``, the size of the ranges that tasks read.

    ``on_bad_json`` is ``"fail"`` (the job fails, naming file and line), ``"skip"``
    or ``"quarantine"`` (bad records stay, with ``problem`` set and ``v`` null).
    ``json_files="lines"`` reads ``.json`` files by line too, as Spark writes them;
    ``line_files`` names the files of a directory that are always read so,
    ``document_files`` those that are documents otherwise.
    """
    if json_files not in ("document", "lines"):
        raise ValueError("json_files must be 'document' or 'lines'")
    if on_bad_json not in ("fail", "skip", "quarantine"):
        raise ValueError("on_bad_json must be 'fail', 'skip' or 'quarantine'")
    configure(spark)
    parts: list[DataFrame] = []
    status = _file_status(spark, path)
    by_range = arrow_opens(status.getPath().toString())

    def lines(**options) -> DataFrame:
        if not by_range:
            return _numbered_lines(spark, path, **options)
        ranges, tasks = byte_ranges(spark, path, range_bytes, **options)
        found = read_range_lines(count_lines(ranges, tasks) if numbers else ranges, tasks)
        return parse_lines(found.withColumn("raw", F.expr(sql.strip("CAST(raw AS STRING)"))))

    def documents(**options) -> DataFrame:
        if not by_range:
            return _whole_documents(spark, path, **options)
        return read_documents(spark, path, on_bad_json=on_bad_json, range_bytes=range_bytes, **options)

    if status.isDirectory():
        for glob, is_lines in ((line_files, True), (document_files, json_files == "lines")):
            options = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
            if not _has_files(spark, path, options):
                continue
            parts.append(lines(**options) if is_lines else documents(**options))
        if not parts:
            raise FileNotFoundError(f"no .jsonl or .json files under {path}")
    elif path.lower().endswith(".jsonl") or json_files == "lines":
        parts.append(lines())
    else:
        parts.append(documents())
    columns = ["file", "offset", "ordinal", "raw", "v", "problem"]
    records = reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))
    place = F.coalesce("offset", "ordinal")
    records = records.select(F.concat_ws("#", "file", place).alias("record_id"), *columns)
    return apply_json_policy(records, on_bad_json)


def _has_files(spark: SparkSession, path: str, options: dict[str, str]) -> bool:
    """Whether any file matches; empty files count, and no path comes to the driver."""
    files = spark.read.format("binaryFile").options(**options).load(path).select("path")
    return not files.isEmpty()


def _numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Numbered lines of files that only Spark can open. They are scanned once and written
    with their block and place; counting and parsing read that copy, so neither depends on
    how the files are split when a later action runs."""
    numbered = parse_lines(number_lines(materialize(read_lines(spark, path, **options), "lines")))
    return numbered.withColumn("offset", F.lit(None).cast("long"))


def apply_json_policy(records: DataFrame, on_bad_json: str) -> DataFrame:
    problem = F.col("problem")
    objects = F.col("raw").startswith("{")
    if on_bad_json == "quarantine":
        return records.filter(problem.isNotNull() | objects)
    line = F.format_string("%s on line %d of %s", problem, F.col("ordinal"), F.col("file"))
    byte = F.format_string("%s at byte %d of %s", problem, F.col("offset"), F.col("file"))
    where = F.when(F.col("ordinal").isNull(), byte).otherwise(line)
    # A record that may only be too large is never left out silently.
    fatal = problem.isNotNull() if on_bad_json == "fail" else problem == BEYOND_LIMIT
    checked = F.when(fatal, F.raise_error(where).cast("boolean")).otherwise(problem.isNull() & objects)
    return records.filter(checked).drop("problem")


def in_read_order(df: DataFrame) -> list[Column]:
    """Sort keys for the order files are read in: path part by part, then place."""
    places = [c for c in ("offset", "ordinal") if c in df.columns]
    return [F.split("file", "/"), *[F.col(c) for c in places]]
