"""Tokenizers as column builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tokenizer = Callable[[Column], Column]

_BLANKS = " \t\n\r\f"
_SPACES = "[ \\t\\n\\r\\f]+"


def whitespace_tokens(text: Column) -> Column:
    """Runs of characters between ASCII blanks; null gives no tokens."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, _SPACES))


def given_tokens(tokens: Column) -> Column:
    """For a column that holds token arrays already."""
    return tokens


def batch_tokenizer(encode: Callable[[list[str]], Sequence[Sequence[str]]]) -> Tokenizer:
    """Wrap a third-party tokenizer that encodes a list of texts at a time.

    Runs as an Arrow-batched pandas UDF; ``encode`` must be picklable.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([list(t) for t in encode(texts.fillna("").tolist())], dtype=object)

    return tokens


def token_count(text: Column, tokenizer: Tokenizer = whitespace_tokens) -> Column:
    return F.size(tokenizer(text))
