"""Streams with state and with two outputs, run over files made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.queries import adapters as a
from turnmill.queries import runs
from turnmill.queries.scans import damaged_records, rejected_sql
from turnmill.session import new_folder
from turnmill.streaming.deltas import finished_requests
from turnmill.streaming.ingest import read_batches, start_ingest_both, stream_records
from turnmill.streaming.timing import stream_timing

# The files of a table come in any order, so nothing in them is late.
LATENESS = "400 days"
FILES = 4


def _as_stream(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a stream of files, in pieces that don't follow their order: two batches,
    each of at least a file for every core."""
    spark = rows.sparkSession
    path, files = new_folder(spark, name), max(FILES, 2 * spark.sparkContext.defaultParallelism)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(path)


def _run(stream: DataFrame, out: str, state: str) -> None:
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    query.trigger(availableNow=True).start().awaitTermination()


def _stream_finished(spark, sf_dir) -> DataFrame:
    """Every reply put together from its pieces, once its last piece and all others came."""
    pieces = runs.deltas(spark, sf_dir).select("request_id", "seq", "ts", "delta", "last")
    out, state = new_folder(spark, "finished"), new_folder(spark, "finished-state")
    _run(finished_requests(_as_stream(pieces, "pieces"), lateness=LATENESS, idle=LATENESS), out, state)
    return spark.read.parquet(out)


def _stream_timing(spark, sf_dir) -> DataFrame:
    """Latency from a stream of starts and a stream of pieces. A pair of rows of a much later
    time, added when all others were read, closes the requests."""
    pieces = runs.deltas(spark, sf_dir)
    starts = pieces.groupBy("request_id").agg(F.min("started").alias("started"))
    pieces = pieces.select("request_id", "ts", "delta")
    folders = [new_folder(spark, "starts"), new_folder(spark, "timed-pieces")]
    streams = []
    for rows, folder in zip((starts, pieces), folders, strict=True):
        rows.repartition(FILES, F.xxhash64(*rows.columns)).write.parquet(folder)
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES // 2).parquet(folder))
    out, state = new_folder(spark, "timing"), new_folder(spark, "timing-state")
    timing = stream_timing(*streams, longest="2 days", lateness=LATENESS)
    _run(timing, out, state)
    much_later = F.lit("2030-01-01 00:00:00").cast("timestamp")
    end = spark.range(1).select(F.lit("end").alias("request_id"), much_later.alias("started"), much_later.alias("ts"), F.lit("").alias("delta"))
    end.select(starts.columns).write.mode("append").parquet(folders[0])
    end.select(pieces.columns).write.mode("append").parquet(folders[1])
    _run(timing, out, state)
    found = spark.read.parquet(out).filter("request_id <> 'end'")
    return found.withColumns({c: F.round(c, 6) for c in ("total_s", "ttft_s")})


def _stream_both(spark, sf_dir) -> DataFrame:
    """Usable and unusable records of the same files, read once, in two sinks."""
    records = stream_records(spark, damaged_records(spark, sf_dir), files="*.txt", max_files=2)
    out, rejected = new_folder(spark, "usable"), new_folder(spark, "unusable")
    start_ingest_both(records, out, rejected, new_folder(spark, "both-state")).awaitTermination()
    usable = read_batches(spark, out).select(F.lit("usable").alias("sink"), F.col("format").alias("what"), F.length("text").cast("long").alias("n_chars"))
    # A damaged record has no value to read its id from.
    return usable.union(read_batches(spark, rejected).select(F.lit("unusable"), "reason", F.lit(None).cast("long")))


QUERIES = {"stream_finished": _stream_finished, "stream_timing": _stream_timing, "stream_both": _stream_both}

ORACLES = {
    "stream_finished": """
        SELECT conv_id || '-' || turn AS request_id, text, CAST(len(string_split(text, ' ')) AS BIGINT) AS pieces, TRUE AS complete
        FROM conversations WHERE role = 'assistant'""",
    "stream_timing": runs.ORACLES["request_timing"],
    "stream_both": f"""
        {a.SQL_MIXED}
        SELECT 'usable' AS sink, format AS what, CAST(length(text) AS BIGINT) AS n_chars FROM mixed_rendered WHERE conv_id % 25 <> 8
        UNION ALL SELECT 'unusable', error, NULL FROM ({rejected_sql()})""",
}
