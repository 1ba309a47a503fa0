"""Token-weighted perplexity, and a bigram model to score texts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions.text import is_blank
from turnmill.functions.tokens import Tokenizer, whitespace_tokens
from turnmill.operators.staging import with_computed
from turnmill.session import materialize

UNKNOWN = "<unk>"


def perplexity(losses: DataFrame, *groups: str, max_length: int | None = 1024) -> DataFrame:
    """``exp(sum(loss * n) / sum(n))`` with ``n`` the predicted tokens of an example.

    ``losses`` has one row per example: ``n_tokens`` and its mean ``loss``.
    Examples with fewer than two tokens do not count. ``max_length`` is the
    length the model read at most. A group without tokens gives ``(NaN, 0)``.
    """
    read = F.col("n_tokens")
    if max_length is not None:
        read = F.least(read, F.lit(max_length))
    predicted = F.when(read >= 2, read - 1)
    total = F.sum(predicted)
    return losses.groupBy(*groups).agg(
        F.when(total > 0, F.exp(F.sum(F.col("loss") * predicted) / total))
        .otherwise(F.lit(float("nan")))
        .alias("perplexity"),
        F.count(predicted).alias("n_used"),
    )


def _pair_counts(texts: DataFrame, tokens: Column, *groups: str) -> DataFrame:
    """Counts of (prev, next), summed in the map stage before they are shuffled.

    The last token of a text has a null successor, so every token is some ``prev``.
    """
    tokenized = with_computed(texts.select(*groups, tokens.alias("t")), t=F.col("t"))
    # The array is not copied: each row looks its successor up in it.
    placed = tokenized.select(*groups, "t", F.posexplode("t").alias("place", "prev"))
    pairs = placed.select(*groups, "prev", F.get("t", F.col("place") + 1).alias("next"))
    real = pairs.filter(F.col("prev").isNotNull())
    return real.groupBy(*groups, "prev", "next").agg(F.count(F.lit(1)).alias("times"))


class BigramModel:
    """Add-k bigram counts of a training text column, as two tables.

    ``pairs``: prev, next, pair_count. ``words``: prev, prev_count, one row per
    known word, also those that are never followed by another. Both are written
    to the shared folder, since scoring reads them several times.
    """

    def __init__(
        self,
        train: DataFrame,
        text: str = "text",
        *,
        k: float = 1.0,
        tokenizer: Tokenizer = whitespace_tokens,
    ):
        self.k = k
        self.tokenizer = tokenizer
        counted = materialize(_pair_counts(train, tokenizer(F.col(text))), "pairs")
        has_next = F.col("next").isNotNull()
        self.pairs = counted.filter(has_next).withColumnRenamed("times", "pair_count")
        followed = F.sum(F.when(has_next, F.col("times")))
        words = counted.groupBy("prev").agg(F.coalesce(followed, F.lit(0)).alias("prev_count"))
        self.words = materialize(words, "words")

    def _tokens(self, text: str, max_length: int | None) -> Column:
        tokens = self.tokenizer(F.col(text))
        return tokens if max_length is None else F.slice(tokens, 1, max_length)

    def vocabulary_size(self) -> Column:
        """Known words plus the unknown word, as a scalar subquery."""
        others = F.count(F.when(F.col("prev") != UNKNOWN, 1))
        return self.words.agg((others + 1).alias("size")).scalar()

    def surprise(
        self, texts: DataFrame, *groups: str, text: str = "text", max_length: int | None = None
    ) -> DataFrame:
        """Summed ``-ln p`` and number of predictions of ``texts``, per group.

        Equal pairs are counted first, so the joins see each distinct pair of a
        group once, however often it occurs.
        """
        seen = _pair_counts(texts, self._tokens(text, max_length), *groups)
        known_next = self.words.select(F.col("prev").alias("next"), F.lit(True).alias("known"))
        resolved = (
            seen.filter(F.col("next").isNotNull())
            .join(known_next, "next", "left")
            .withColumn("next", F.when(F.col("known"), F.col("next")).otherwise(UNKNOWN))
            .join(self.words, "prev", "left")
            .withColumn(
                "prev", F.when(F.col("prev_count").isNotNull(), F.col("prev")).otherwise(UNKNOWN)
            )
        )
        # Unknown words have become equal, so their pairs are summed again.
        resolved = resolved.groupBy(*groups, "prev", "next", "prev_count").agg(F.sum("times").alias("times"))
        # A training text may hold the unknown word itself; then it has counts too.
        unknown = self.words.filter(F.col("prev") == UNKNOWN)
        unknown_count = unknown.agg(F.max("prev_count").alias("c")).scalar()
        matched = resolved.join(self.pairs, ["prev", "next"], "left")
        seen_before = F.coalesce(F.col("prev_count"), unknown_count, F.lit(0))
        p = (F.coalesce(F.col("pair_count"), F.lit(0)) + self.k) / (
            seen_before + self.k * self.vocabulary_size()
        )
        return matched.groupBy(*groups).agg(
            F.sum(-F.log(p) * F.col("times")).alias("nll"),
            F.sum("times").alias("predictions"),
        )

    def losses(
        self, texts: DataFrame, *ids: str, text: str = "text", max_length: int | None = None
    ) -> DataFrame:
        """Mean ``-ln p`` and token count of every example with two tokens or more."""
        summed = self.surprise(texts, *ids, text=text, max_length=max_length)
        return summed.select(
            *ids,
            (F.col("predictions") + 1).alias("n_tokens"),
            (F.col("nll") / F.col("predictions")).alias("loss"),
        )

    def perplexity(
        self, texts: DataFrame, *groups: str, text: str = "text", max_length: int | None = None
    ) -> DataFrame:
        """The same figure as :func:`perplexity` over :meth:`losses`, without a
        row per example: only group totals leave the joins."""
        scored = texts if isinstance(texts.schema[text].dataType, T.ArrayType) else texts.filter(~is_blank(F.col(text)))
        scorable = F.size(self._tokens(text, max_length)) >= 2
        used = scored.groupBy(*groups).agg(F.count_if(scorable).alias("n_used"))
        totals = self.surprise(scored, *groups, text=text, max_length=max_length)
        value = F.when(F.col("predictions") > 0, F.exp(F.col("nll") / F.col("predictions")))
        return used.join(totals, list(groups), "left").select(
            *groups, value.otherwise(F.lit(float("nan"))).alias("perplexity"), "n_used"
        )
