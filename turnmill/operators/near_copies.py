"""Near copies of whole conversations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators.staging import with_computed
from turnmill.session import materialize

WORDS_A_SHINGLE = 5
# Signatures of 96 least hashes, in 24 bands of 4: two conversations with a similarity of 0.75
# share a band with a probability of 0.9999, with 0.3 with one of 0.18.
BANDS, ROWS_A_BAND = 24, 4
THRESHOLD = 0.75
_ROWS_A_STEP = 256


def conversation_text(messages: Column) -> Column:
    """Roles and contents of a conversation's messages, one after the other."""
    return F.array_join(F.flatten(F.transform(messages, lambda m: F.array(m["role"], F.coalesce(m["content"], F.lit(""))))), "\n")


def words(text: Column) -> Column:
    """The words of a text, case apart."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def shingles(own: Column, words_each: int = WORDS_A_SHINGLE) -> Column:
    """The distinct runs of so many words, as hashes; all words of a shorter text are one.
    Empty without words. Pass a column that is computed already: it is read for every run."""
    count = F.greatest(F.size(own) - F.lit(words_each - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(own, i, words_each), " ")))
    return F.when(F.size(own) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _factors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.Philox(key=[seed, 1]))
    return draw.integers(1, 1 << 63, BANDS * ROWS_A_BAND, np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, BANDS * ROWS_A_BAND, np.uint64)


def _bands(sets: DataFrame, seed: int) -> DataFrame:
    """``id, band, key`` of every set that is not empty."""
    factors, terms = _factors(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_A_STEP):
                part = batch.slice(at, _ROWS_A_STEP)
                keys = []
                for row in range(part.num_rows):
                    own = part.column(1)[row].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
                    for step in range(0, len(own), 4096):
                        mixed = own[step : step + 4096, None] * factors + terms
                        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
                    # The rows of a band as one number.
                    grouped = least.reshape(BANDS, ROWS_A_BAND)
                    key = np.zeros(BANDS, np.uint64)
                    for k in range(ROWS_A_BAND):
                        key = (key ^ grouped[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                    keys.append(key.view(np.int64))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
                bands = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(bands), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], ["id", "band", "key"])

    return sets.filter(F.size("shingles") > 0).select("id", "shingles").mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, band int, key long")


def near_copies(conversations: DataFrame, id_column: str, text: str = "text", *, threshold: float = THRESHOLD, seed: int = 7) -> DataFrame:
    """``id, copy_of``: conversations that are similar to one with a smaller id.

    Similar is a Jaccard similarity of word shingles of at least ``threshold``; ``copy_of`` is
    the smallest id that was found so. Candidates are the least ids of the buckets a
    conversation shares; every candidate is compared exactly, so nothing is called a copy
    that is none, and a bucket with a third of all rows gives one candidate a row, not pairs.
    A copy is missed if in no bucket the least id is similar to it. Ids are unique and not
    null; texts without words are no copies.
    """
    split = with_computed(conversations.select(F.col(id_column).alias("id"), F.col(text).alias("text")), words=words(F.col("text")))
    sets = materialize(split.select("id", shingles(F.col("words")).alias("shingles")), "shingles")
    bands = materialize(_bands(sets, seed), "bands")
    # Written before it is joined back, so that a hot bucket can be split.
    least = materialize(bands.groupBy("band", "key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most"), "buckets")
    pairs = bands.join(least, ["band", "key"]).filter("least < id").select("id", "least").distinct()
    pairs = materialize(pairs, "candidates")
    own = sets.select("id", "shingles")
    other = sets.select(F.col("id").alias("least"), F.col("shingles").alias("others"))
    compared = pairs.join(own, "id").join(other, "least")
    common = F.size(F.array_intersect("shingles", "others"))
    similar = common >= F.lit(threshold) * (F.size("shingles") + F.size("others") - common)
    return compared.filter(similar).groupBy("id").agg(F.min("least").alias("copy_of"))


def drop_near_copies(conversations: DataFrame, id_column: str, text: str = "text", **options) -> DataFrame:
    """The conversations that :func:`near_copies` does not name."""
    copies = near_copies(conversations, id_column, text, **options).select(F.col("id").alias("_copy"))
    return conversations.join(copies, F.col(id_column) == F.col("_copy"), "left_anti")


def first_arrivals(conversations: DataFrame, text: str = "text", time: str = "ts", *, within: str = "1 day") -> DataFrame:
    """Of a stream's conversations with the same words, case and blanks apart, the first that
    arrives; a repeat more than ``within`` later may come through again. What is kept for it
    is one digest a conversation, until the watermark passes."""
    digest = F.sha2(F.array_join(words(F.col(text)), " "), 256)
    return conversations.withWatermark(time, within).withColumn("_words", digest).dropDuplicatesWithinWatermark(["_words"]).drop("_words")
