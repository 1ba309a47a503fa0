"""Corpus ingestion as files arrive."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnmill.functions import sql
from turnmill.functions.templates import CHATML, Template
from turnmill.operators.conversations import render
from turnmill.operators.formats import normalize
from turnmill.session import configure
from turnmill.sources.records import LINE_FILES, file_name, parse_lines


def stream_records(
    spark: SparkSession, path: str, *, files: str = LINE_FILES, max_files: int | None = None
) -> DataFrame:
    """Parsed records of the line files that appear below ``path``.

    A line's number needs the whole file, so rows carry ``file`` only. Lines
    that are not JSON have ``problem`` set.
    """
    configure(spark)
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    lines = reader.text(path).select(file_name(), F.expr(sql.strip("value")).alias("raw"))
    return parse_lines(lines).filter(F.col("problem").isNotNull() | F.col("raw").startswith("{"))


def stream_rendered(
    records: DataFrame,
    *,
    fmt: str = "auto",
    template: Template | None = CHATML,
    default_system: str | None = None,
    on_error: str = "raise",
) -> DataFrame:
    """The same normalise, filter and render steps as in batch; all stateless.

    Strict like batch unless told otherwise. With ``"quarantine"`` send
    :func:`stream_rejected` of the same records to a sink of its own.
    """
    if on_error == "raise":
        bad = F.col("problem").isNotNull()
        fail = F.raise_error(F.concat_ws(": ", "file", "problem")).cast("boolean")
        records = records.filter(F.when(bad, fail).otherwise(F.lit(True)))
    good = records.filter(F.col("problem").isNull()).drop("problem")
    return render(normalize(good, fmt, default_system=default_system, on_error=on_error), template)


def stream_rejected(records: DataFrame, *, fmt: str = "auto", default_system: str | None = None) -> DataFrame:
    """``file, reason, raw`` of the records that don't parse or have no known layout."""
    bad = records.filter(F.col("problem").isNotNull()).select("file", F.col("problem").alias("reason"), "raw")
    good = records.filter(F.col("problem").isNull()).drop("problem")
    unified = normalize(good, fmt, default_system=default_system, on_error="quarantine")
    failed = unified.filter(F.col("error").isNotNull()).select("file", F.col("error").alias("reason"), "raw")
    return bad.unionByName(failed)


def start_ingest(rendered: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder until the files present now are done."""
    return (
        rendered.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_MANIFEST = "_batches"


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _commit(spark: SparkSession, sink: str, batch_id: int) -> None:
    """Note that a batch of the sink is whole. The note is empty and made in one step."""
    note = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{_MANIFEST}/{batch_id}")
    note.getFileSystem(spark._jsc.hadoopConfiguration()).create(note, True).close()


def write_batch_once(rows: DataFrame, sink: str, batch_id: int) -> bool:
    """Write a batch into a folder of its own below ``sink``, unless it is there already;
    whether it was written. Half-written batches are replaced."""
    spark = rows.sparkSession
    if _exists(spark, f"{sink}/{_MANIFEST}/{batch_id}"):
        return False
    rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    _commit(spark, sink, batch_id)
    return True


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of the batches that are whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{_MANIFEST}")
    notes = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    batches = sorted(int(note.getPath().getName()) for note in notes if note.getPath().getName().isdigit())
    return spark.read.option("basePath", sink).parquet(*[f"{sink}/batch={n}" for n in batches]).drop("batch")


def _write_both(batch: DataFrame, batch_id: int, *, out: str, rejected: str, fmt: str, template: Template | None, default_system: str | None) -> None:
    batch = batch.persist()
    try:
        bad = batch.filter(F.col("problem").isNotNull()).select("file", F.col("problem").alias("reason"), "raw")
        good = batch.filter(F.col("problem").isNull()).drop("problem")
        unified = normalize(good, fmt, default_system=default_system, on_error="quarantine").persist()
        try:
            write_batch_once(render(unified, template).drop("raw"), out, batch_id)
            failed = unified.filter(F.col("error").isNotNull()).select("file", F.col("error").alias("reason"), "raw")
            write_batch_once(bad.unionByName(failed), rejected, batch_id)
        finally:
            unified.unpersist()
    finally:
        batch.unpersist()


def start_ingest_both(
    records: DataFrame,
    out: str,
    rejected: str,
    checkpoint: str,
    *,
    fmt: str = "auto",
    template: Template | None = CHATML,
    default_system: str | None = None,
) -> StreamingQuery:
    """Send usable records to ``out`` and the others, with their reason, to ``rejected``.

    The files are read once for both: ``records`` is what :func:`stream_records` gives. Each
    batch has a folder of its own in either sink, and a note once it is whole. A batch that
    is run again, because the job ended between the two writes, writes only what has no
    note yet. Read the sinks with :func:`read_batches`.
    """
    write = partial(_write_both, out=out, rejected=rejected, fmt=fmt, template=template, default_system=default_system)
    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
