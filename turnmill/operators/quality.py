"""Quality limits that a corpus sets itself.

Each language's quantiles of a few measures are taken from mergeable sketches: one
aggregate over the corpus, of a few kilobytes a language and measure, that can be stored
and merged with those of later parts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.session import materialize

MEASURES = ("n_chars", "repeated_lines", "letters")
# The quantiles below and above which a document is left out; None for no limit.
LIMITS: dict[str, tuple[float | None, float | None]] = {
    "n_chars": (0.05, 0.95),
    "repeated_lines": (None, 0.95),
    "letters": (0.05, None),
}
# A group of at most so many rows has exact quantiles; of a larger one their rank is off by
# about RANK_ERROR of its rows.
SKETCH_SIZE = 8192
RANK_ERROR = 0.001


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_chars``, and the shares of lines that are repeats and of characters that are
    letters. A null or empty text has 0 of all."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.length(body)
    lines = F.split(body, "\n")
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
    return docs.withColumns(
        {
            "n_chars": size.cast("double"),
            "repeated_lines": F.when(size > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0),
            "letters": F.when(size > 0, letters / size).otherwise(0.0),
        }
    )


def quantile_sketches(measured: DataFrame, *groups: str) -> DataFrame:
    """A row a group with the sketch of each measure, from one pass."""
    return measured.groupBy(*groups).agg(*[F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE)).alias(c) for c in MEASURES])


def merge_sketches(sketches: DataFrame, *groups: str) -> DataFrame:
    """The sketches of several parts of a corpus as those of the whole."""
    return sketches.groupBy(*groups).agg(*[F.kll_merge_agg_double(c, F.lit(SKETCH_SIZE)).alias(c) for c in MEASURES])


def quality_limits(sketches: DataFrame, *groups: str, limits: Mapping[str, tuple[float | None, float | None]] = LIMITS) -> DataFrame:
    """``<measure>_low`` and ``<measure>_high`` of each group; null for no limit.

    The limit at p is the value of rank ``ceil(p * n)``, off by at most the sketch's error.
    """

    def limit(measure: str, p: float | None) -> Column:
        return F.lit(None).cast("double") if p is None else F.kll_sketch_get_quantile_double(measure, F.lit(p))

    columns = [limit(c, p).alias(f"{c}_{side}") for c, ends in limits.items() for side, p in zip(("low", "high"), ends, strict=True)]
    return sketches.select(*groups, *columns)


def within_limits(measured: DataFrame, limits: DataFrame, *groups: str) -> DataFrame:
    """Add ``outside``, the measures in which a row is below or above its group's limits, and
    ``keep``, whether there are none. Rows of a group without limits stay.

    The limits are one row a group; they are written, so that their size decides the join.
    """
    named = materialize(limits.withColumnsRenamed({g: f"_{g}" for g in groups}), "limits")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    joined = measured.join(named, same, "left")
    low = lambda c: F.coalesce(F.col(c) < F.col(f"{c}_low"), F.lit(False))
    high = lambda c: F.coalesce(F.col(c) > F.col(f"{c}_high"), F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(low(c) | high(c), F.lit(c)) for c in MEASURES]))
    return joined.withColumn("outside", reasons).withColumn("keep", F.size("outside") == 0).drop(*named.columns)
