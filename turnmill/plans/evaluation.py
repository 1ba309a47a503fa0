"""Score datasets with a model and report perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.functions.text import is_blank
from turnmill.operators.perplexity import BigramModel, perplexity


def evaluation_report(
    model: BigramModel,
    corpus: DataFrame,
    dataset: str,
    order: list[Column | str],
    id_column: str,
    *,
    max_samples: int = 200,
    max_length: int = 1024,
) -> DataFrame:
    """Perplexity of the first ``max_samples`` examples of every dataset.

    ``order`` gives the read order inside a dataset. Texts are read up to
    ``max_length`` tokens, as a model with that context would.
    """
    # The rank filter runs in each task before the exchange.
    place = F.row_number().over(W.partitionBy(dataset).orderBy(*order))
    chosen = corpus.withColumn("place", place).filter(F.col("place") <= max_samples)
    scored = chosen.filter(~is_blank(F.col("text")))
    losses = model.losses(scored, dataset, id_column, max_length=max_length)
    return perplexity(losses, dataset, max_length=max_length)
