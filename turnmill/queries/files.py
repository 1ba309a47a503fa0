"""Record files by byte range, folders of both kinds, and the guards of a preparation."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import PY_WS
from turnmill.operators.conversations import render
from turnmill.operators.formats import normalize
from turnmill.plans.prepare import prepare_dataset
from turnmill.queries import adapters as a
from turnmill.session import new_folder
from turnmill.sources.records import read_records

# Ids a document or file holds, and ranges that cut each of them many times.
IDS_A_FILE = 64
DOCUMENT_RANGE = 1500
LINE_RANGE = 700


def _conv_id() -> Column:
    return F.try_variant_get(F.col("v"), "$.conv_id", "bigint").alias("conv_id")


def _written_lots(lines: DataFrame, path: str) -> str:
    """Text files of a lot each, from ``lot, place, value``, in order of place."""
    placed = lines.repartition("lot").sortWithinPartitions("lot", "place")
    placed.select("lot", "value").write.partitionBy("lot").text(path)
    return path


def _json_documents(spark, sf_dir) -> DataFrame:
    """The mixed records as elements of list documents, each read in many ranges.

    A list begins with a null, which counts as an element and is no record.
    """
    fields = a.mixed_fields(spark, sf_dir).withColumn("lot", F.expr(f"conv_id div {IDS_A_FILE}"))
    raw = F.to_json(F.struct(*[c for c in fields.columns if c != "lot"]))
    rows = fields.select("lot", F.col("conv_id").alias("place"), F.concat(F.lit(" , "), raw).alias("value"))
    lots = fields.select("lot").distinct()
    ends = [lots.select("lot", F.lit(place).cast("long").alias("place"), F.lit(mark).alias("value")) for place, mark in ((-1, "[ null"), (1 << 62, "]"))]
    path = _written_lots(rows.union(ends[0]).union(ends[1]), new_folder(spark, "documents"))
    records = read_records(spark, path, document_files="*.txt", range_bytes=DOCUMENT_RANGE)
    unified = normalize(records.select(_conv_id(), "ordinal", "v", "raw"), on_error="quarantine")
    return unified.select("conv_id", "ordinal", "format")


def _line_offsets(spark, sf_dir) -> DataFrame:
    """Where every record's line begins: files of both line ends, blank lines among them."""
    turns = a.turns(spark, sf_dir).groupBy("conv_id").agg(F.sum(F.length("content")).alias("size"))
    body = F.format_string('{"conv_id":%d,"pad":"%s"}', F.col("conv_id"), F.repeat(F.lit("é"), (F.col("size") % 300).cast("int")))
    value = F.concat(body, F.when(F.col("conv_id") % 2 == 1, "\r").otherwise(""), F.when(F.col("conv_id") % 3 == 0, "\n ").otherwise(""))
    lots = turns.select(F.expr(f"conv_id div {IDS_A_FILE}").alias("lot"), F.col("conv_id").alias("place"), value.alias("value"))
    path = _written_lots(lots, new_folder(spark, "offsets"))
    records = read_records(spark, path, line_files="*.txt", numbers=False, range_bytes=LINE_RANGE)
    return records.select(_conv_id(), "offset")


def _mixed_folder(spark, sf_dir) -> DataFrame:
    """A folder with line files and, in a folder below, documents of one record each."""
    path = new_folder(spark, "mixed")
    fields = a.mixed_fields(spark, sf_dir)
    raw = F.to_json(F.struct(*fields.columns))
    fields.filter("conv_id % 3 <> 1").select(raw.alias("value")).write.text(f"{path}/lines")
    fields.filter("conv_id % 3 = 1").write.option("maxRecordsPerFile", 1).json(f"{path}/documents/one")
    records = read_records(spark, path, line_files="*.txt")
    kind = F.when(F.col("file").endswith(".json"), "document").otherwise("lines")
    first = F.when(F.col("file").endswith(".json"), F.col("ordinal"))
    unified = normalize(records.select(_conv_id(), kind.alias("kind"), first.alias("number"), "v", "raw"), on_error="quarantine")
    return unified.select("conv_id", "kind", "number", "format")


# Texts that hold nothing: by document, one of these takes the place of the text.
_BLANKS = ("", " ", "\t\r\n", PY_WS, "  ")


def _with_blanks(spark, sf_dir) -> DataFrame:
    """Plain-text records of which every fourth is blank."""
    blank = F.element_at(F.array(*map(F.lit, _BLANKS)), (F.expr("doc_id div 4") % len(_BLANKS) + 1).cast("int"))
    text = F.when(F.col("doc_id") % 4 == 3, blank).otherwise(F.col("text"))
    records = a.documents(spark, sf_dir, "text").select("doc_id", F.to_json(F.struct(text.alias("text"))).alias("raw"))
    return a.parsed(records)


def _blank_texts(spark, sf_dir) -> DataFrame:
    """What is left of the plain texts once blank ones are dropped."""
    kept = render(normalize(_with_blanks(spark, sf_dir)), None)
    return kept.select("doc_id", F.length("text").cast("long").alias("n_chars"))


def _guards(spark, sf_dir) -> DataFrame:
    """What the guards say: of chat records without a template, of plain texts without one,
    of a corpus in which nothing is usable, and of the same corpus with its usable records."""
    chats = normalize(a.parsed(a.records_in(spark, sf_dir, "openai")))
    texts = normalize(_with_blanks(spark, sf_dir))
    blank = new_folder(spark, "blank-corpus")
    _with_blanks(spark, sf_dir).filter("doc_id % 4 = 3").select(F.col("raw").alias("value")).write.text(f"{blank}/blank.txt")
    whole = new_folder(spark, "whole-corpus")
    _with_blanks(spark, sf_dir).select(F.col("raw").alias("value")).write.text(f"{whole}/whole.txt")

    def said(run) -> tuple[str, int]:
        try:
            return "passed", run()
        except PySparkException as error:
            return ("needs a template" if "need a template" in str(error) else "other error"), 0
        except ValueError as error:
            return "no usable example", int(str(error).split("none of ")[1].split(" ")[0])

    prepared = lambda path: prepare_dataset(spark, path, line_files="*.txt").corpus.count()
    rows = [
        ("chat without template", *said(lambda: render(chats, None).count())),
        ("text without template", *said(lambda: render(texts, None).count())),
        ("corpus of blanks", *said(lambda: prepared(blank))),
        ("corpus", *said(lambda: prepared(whole))),
    ]
    return spark.createDataFrame(rows, "guard string, outcome string, records long")


QUERIES = {
    "json_documents": _json_documents,
    "line_offsets": _line_offsets,
    "mixed_folder": _mixed_folder,
    "blank_texts": _blank_texts,
    "guards": _guards,
}

_BLANK_IDS = "doc_id % 4 = 3 OR text IS NULL OR " + a.sql_strip("text") + " = ''"

ORACLES = {
    "json_documents": f"""
        WITH {a.SQL_CONV}, {a.SQL_DETECTED}
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id // {IDS_A_FILE} ORDER BY conv_id) + 1 AS ordinal, format FROM detected""",
    "line_offsets": f"""
        WITH sizes AS (SELECT conv_id, sum(length(text)) AS size FROM conversations GROUP BY conv_id),
        lines AS (
          SELECT conv_id, length('{{"conv_id":' || conv_id || ',"pad":""}}') + 2 * (size % 300)
            + CASE WHEN conv_id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END + 1 AS bytes
          FROM sizes)
        SELECT conv_id, CAST(coalesce(sum(bytes) OVER (PARTITION BY conv_id // {IDS_A_FILE} ORDER BY conv_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lines""",
    "mixed_folder": f"""
        WITH {a.SQL_CONV}, {a.SQL_DETECTED}
        SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN 'document' ELSE 'lines' END AS kind,
               CASE WHEN conv_id % 3 = 1 THEN 1::BIGINT END AS number, format FROM detected""",
    "blank_texts": f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE NOT ({_BLANK_IDS})",
    "guards": f"""
        WITH n AS (SELECT count(*) FILTER (NOT ({_BLANK_IDS})) AS kept, count(*) FILTER (doc_id % 4 = 3) AS blank FROM documents)
        SELECT 'chat without template' AS guard, 'needs a template' AS outcome, 0::BIGINT AS records
        UNION ALL SELECT 'text without template', 'passed', kept FROM n
        UNION ALL SELECT 'corpus of blanks', 'no usable example', blank FROM n
        UNION ALL SELECT 'corpus', 'passed', kept FROM n""",
}
