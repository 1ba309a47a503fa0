"""From raw records to a rendered, split corpus."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.messages import is_usable
from turnmill.functions.templates import CHATML, Template
from turnmill.operators.conversations import render, with_rendered
from turnmill.operators.formats import normalize, status
from turnmill.operators.split import seeded_split
from turnmill.session import materialize
from turnmill.sources.records import in_read_order, read_records


@dataclass(frozen=True)
class Prepared:
    """A corpus, its one-row count table, and what was put into quarantine.

    ``stats`` has ``seen = kept + dropped + rejected``, ``num_train`` and ``num_eval``.
    ``rejected`` has ``record_id, file, ordinal, reason, raw``; it is empty unless
    ``on_bad_json`` or ``on_error`` is ``"quarantine"``.
    """

    corpus: DataFrame
    stats: DataFrame
    rejected: DataFrame
    text_field: str = "text"


_REJECTED = ["record_id", "file", "ordinal", "reason", "raw"]


def prepare(
    records: DataFrame,
    id_column: str = "record_id",
    *,
    fmt: str = "auto",
    template: Template | None = CHATML,
    eval_ratio: float = 0.05,
    seed: int = 42,
    default_system: str | None = None,
    on_error: str = "raise",
) -> DataFrame:
    """Normalise, filter, render and split parsed records.

    The split must know the ids of all usable records before it can label one.
    The rendered corpus is therefore written once to the shared folder, and the
    ids are read back from there instead of parsing every record a second time.
    """
    unified = normalize(records, fmt, default_system=default_system, on_error=on_error)
    rendered = render(unified, template)
    if eval_ratio > 0:
        rendered = materialize(rendered, "rendered")
    return seeded_split(rendered, id_column, ratio=eval_ratio, seed=seed)


def prepare_dataset(
    spark: SparkSession,
    path: str,
    *,
    fmt: str = "auto",
    template: Template | None = CHATML,
    eval_ratio: float = 0.05,
    seed: int = 42,
    default_system: str | None = None,
    on_bad_json: str = "fail",
    on_error: str = "raise",
    **reading,
) -> Prepared:
    """Prepare the files under ``path``. ``reading`` goes to :func:`read_records`.

    The rendered corpus is written once to the shared folder; split, counts and
    later reads start from there. A corpus without a usable example is an error.
    """
    records = read_records(spark, path, on_bad_json=on_bad_json, **reading)
    # Kept and rejected records come from one pass, which also counts them.
    read, made = Observation(), Observation()
    records = records.observe(read, F.count(F.lit(1)).alias("n"))
    unified = normalize(records, fmt, default_system=default_system, on_error=on_error)
    none = F.lit(None).cast("string")
    problem = F.col("problem") if on_bad_json == "quarantine" else none
    reason = F.coalesce(problem, F.col("error") if on_error == "quarantine" else none)
    rendered = with_rendered(unified.withColumn("reason", reason), template)
    raw = F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw")
    rows = rendered.select("record_id", "file", "ordinal", "format", "text", "reason", raw).filter("text IS NOT NULL OR reason IS NOT NULL")
    counts = [F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("rejected")]
    written = materialize(rows.observe(made, *counts), "rendered")
    rejected = written.filter("reason IS NOT NULL").select(*_REJECTED)
    # Records that "skip" leaves out are dropped, not rejected.
    total, n_kept, n_rejected = read.get["n"], made.get["kept"], made.get["rejected"]
    require_examples(total, n_kept, path)
    kept = written.filter("reason IS NULL").drop("reason", "raw")
    corpus = seeded_split(kept, "record_id", ratio=eval_ratio, seed=seed)
    stats = corpus.agg(
        F.lit(total).alias("seen"),
        F.lit(total - n_kept - n_rejected).alias("dropped"),
        F.lit(n_rejected).alias("rejected"),
        F.count(F.lit(1)).alias("kept"),
        F.count_if(F.col("split") == "train").alias("num_train"),
        F.count_if(F.col("split") == "eval").alias("num_eval"),
    )
    return Prepared(corpus, stats, rejected)


def rejects(records: DataFrame, fmt: str = "auto", *, bad_json: bool = True, errors: bool = True) -> DataFrame:
    """``record_id, file, ordinal, reason, raw`` of records that could not be used:
    those with a ``problem``, and those in no known layout."""
    parts = []
    good = records
    if "problem" in records.columns:
        parts.append(records.filter(F.col("problem").isNotNull() & F.lit(bad_json)).withColumnRenamed("problem", "reason"))
        good = records.filter(F.col("problem").isNull()).drop("problem")
    failed = normalize(good, fmt, on_error="quarantine").filter(F.col("error").isNotNull() & F.lit(errors))
    parts.append(failed.withColumnRenamed("error", "reason"))
    return reduce(DataFrame.unionByName, (p.select(*_REJECTED) for p in parts))


def require_examples(seen: int, kept: int, source: str) -> None:
    """Fail when nothing usable came out of ``source``."""
    if kept == 0:
        raise ValueError(f"{source}: none of {seen} records gave a usable example")


def head_sample(corpus: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` examples in read order."""
    return corpus.orderBy(*in_read_order(corpus)).limit(n)


def dataset_report(normalized: DataFrame) -> DataFrame:
    """Records by format and fate, with a total per format and overall.

    ``normalized`` must hold the malformed records too (``on_error="quarantine"``).
    A total row has null in the columns it sums over.
    """
    fate = status(normalized, is_usable(F.col("messages")))
    labelled = normalized.select(
        F.coalesce("format", F.lit("unknown")).alias("format"), fate.alias("status")
    )
    return labelled.rollup("format", "status").agg(F.count(F.lit(1)).alias("n"))
