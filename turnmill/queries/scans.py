"""Reading and writing files derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators.formats import normalize
from turnmill.plans.prepare import prepare, prepare_dataset, rejects
from turnmill.queries import adapters as a
from turnmill.session import new_folder
from turnmill.sources.records import read_records
from turnmill.sources.sinks import write_splits
from turnmill.streaming.ingest import start_ingest, stream_records, stream_rejected, stream_rendered


IDS_A_FILE = 16


def _written_records(spark, sf_dir) -> str:
    """The mixed records as JSON line files below a new shared folder."""
    path = new_folder(spark, "records")
    a.mixed_fields(spark, sf_dir).write.json(path)
    return path


def _scan_records(spark, sf_dir) -> DataFrame:
    records = read_records(spark, _written_records(spark, sf_dir), json_files="lines")
    conv_id = F.try_variant_get(F.col("v"), "$.conv_id", "bigint")
    unified = normalize(records.withColumn("conv_id", conv_id), on_error="quarantine")
    return unified.select("conv_id", "format")


def _line_ordinals(spark, sf_dir) -> DataFrame:
    """Every record's line number in files of 16 ids each, written in id order."""
    path = new_folder(spark, "ordered")
    lots = a.mixed_fields(spark, sf_dir).withColumn("lot", F.expr(f"conv_id div {IDS_A_FILE}"))
    lots.repartition("lot").sortWithinPartitions("lot", "conv_id").write.partitionBy("lot").json(path)
    conv_id = F.try_variant_get(F.col("v"), "$.conv_id", "bigint")
    return read_records(spark, path, json_files="lines").select(conv_id.alias("conv_id"), "ordinal")


def _split_sink(spark, sf_dir) -> DataFrame:
    """The prepared corpus, written by split and read back."""
    path = new_folder(spark, "corpus")
    records = a.parsed(a.mixed_records(spark, sf_dir)).drop("raw")
    write_splits(prepare(records, "conv_id", on_error="skip"), path)
    return spark.read.parquet(path).select("conv_id", "format", "text", "split")


def _stream_ingest(spark, sf_dir) -> DataFrame:
    """The mixed records taken in as a stream of files, then read back."""
    source, out = new_folder(spark, "incoming"), new_folder(spark, "ingested")
    lines = a.mixed_fields(spark, sf_dir)
    lines.write.json(source)
    rendered = stream_rendered(stream_records(spark, source, files="*.json"), on_error="skip")
    start_ingest(rendered, out, new_folder(spark, "ingest-state")).awaitTermination()
    return spark.read.parquet(out).select("format", "text")


def damaged_records(spark, sf_dir) -> str:
    """The mixed records as line files in which every 25th line lacks its last character."""
    path = new_folder(spark, "damaged")
    fields = a.mixed_fields(spark, sf_dir)
    raw = F.to_json(F.struct(*fields.columns))
    short = F.expr("substring(raw, 1, length(raw) - 1)")
    lines = fields.select("conv_id", raw.alias("raw"))
    lines.select(F.when(F.col("conv_id") % 25 == 8, short).otherwise(F.col("raw")).alias("value")).write.text(path)
    return path


def _reasons(rejected: DataFrame) -> DataFrame:
    # A damaged record has no value to read its id from.
    conv_id = F.regexp_extract("raw", '"conv_id":([0-9]+)', 1).cast("bigint")
    return rejected.select(conv_id.alias("conv_id"), F.col("reason").alias("error"))


def _prepared_rejects(spark, sf_dir) -> DataFrame:
    """What a preparation from files puts into quarantine."""
    records = read_records(spark, damaged_records(spark, sf_dir), on_bad_json="quarantine", line_files="*.txt")
    return _reasons(rejects(records))


def _stream_rejects(spark, sf_dir) -> DataFrame:
    """What a stream of the same files puts into quarantine, read back."""
    source, out = damaged_records(spark, sf_dir), new_folder(spark, "rejected")
    rejected = stream_rejected(stream_records(spark, source, files="*.txt"))
    start_ingest(rejected, out, new_folder(spark, "rejected-state")).awaitTermination()
    return _reasons(spark.read.parquet(out))


def _prepare_folder(spark, sf_dir) -> DataFrame:
    """The file-based preparation over a folder of record files."""
    path = _written_records(spark, sf_dir)
    prepared = prepare_dataset(spark, path, eval_ratio=0, on_error="quarantine", json_files="lines")
    return prepared.corpus.select("format", "text")


def _prepare_stats(spark, sf_dir) -> DataFrame:
    path = _written_records(spark, sf_dir)
    return prepare_dataset(spark, path, eval_ratio=0.05, on_error="quarantine", json_files="lines").stats


QUERIES = {
    "prepare_folder": _prepare_folder,
    "prepare_stats": _prepare_stats,
    "prepared_rejects": _prepared_rejects,
    "stream_rejects": _stream_rejects,
    "scan_records": _scan_records,
    "line_ordinals": _line_ordinals,
    "split_sink": _split_sink,
    "stream_ingest": _stream_ingest,
}

def rejected_sql() -> str:
    """Reasons for the damaged files; every record there has a conv_id of its own."""
    keys = """CASE WHEN conv_id % 25 = 7 THEN 'conv_id, note'
      WHEN conv_id % 6 = 2 THEN concat_ws(', ', 'conv_id', 'input', 'note',
        CASE WHEN len(replies) > 0 THEN 'output' END, CASE WHEN len(systems) > 0 THEN 'system' END)
      ELSE concat_ws(', ', CASE WHEN len(replies) > 0 AND conv_id % 12 <> 10 THEN 'completion' END, 'conv_id',
        'note', CASE WHEN len(users) > 0 THEN 'prompt' END,
        CASE WHEN len(replies) > 0 AND conv_id % 12 = 10 THEN 'response' END,
        CASE WHEN len(systems) > 0 THEN 'system' END) END"""
    return f"""WITH {a.SQL_CONV}, {a.SQL_DETECTED}
        SELECT conv_id, CASE WHEN conv_id % 25 = 8 THEN 'invalid JSON' ELSE 'no known layout; keys: ' || {keys} END AS error
        FROM detected JOIN conv USING (conv_id) WHERE format IS NULL OR conv_id % 25 = 8"""


ORACLES = {
    "prepare_folder": a.SQL_MIXED + " SELECT format, text FROM mixed_rendered",
    "prepare_stats": a.SQL_MIXED + """,
        n AS (
          SELECT count(*) AS seen, count(*) FILTER (format IS NULL) AS rejected,
                 (SELECT count(*) FROM mixed_rendered) AS kept FROM detected)
        SELECT seen, seen - rejected - kept AS dropped, rejected, kept,
          CAST(CASE WHEN kept >= 10 THEN kept - ceil(0.05::DOUBLE * kept) ELSE kept END AS BIGINT) AS num_train,
          CAST(CASE WHEN kept >= 10 THEN ceil(0.05::DOUBLE * kept) ELSE 0 END AS BIGINT) AS num_eval
        FROM n""",
    "prepared_rejects": rejected_sql(),
    "stream_rejects": rejected_sql(),
    "scan_records": f"WITH {a.SQL_CONV}, {a.SQL_DETECTED} SELECT conv_id, format FROM detected",
    "line_ordinals": f"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id // {IDS_A_FILE} ORDER BY conv_id) AS ordinal
        FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "split_sink": a.SQL_MIXED + """,
        ranked AS (
          SELECT conv_id, format, text, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) AS place,
                 count(*) OVER () AS n FROM mixed_rendered)
        SELECT conv_id, format, text,
          CASE WHEN n >= 10 AND place <= ceil(0.05::DOUBLE * n) THEN 'eval' ELSE 'train' END AS split
        FROM ranked""",
    "stream_ingest": a.SQL_MIXED + " SELECT format, text FROM mixed_rendered",
}
