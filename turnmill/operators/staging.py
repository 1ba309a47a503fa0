"""Evaluate expensive columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose results later columns and filters reuse.

    The optimizer inlines a plain projection into every expression that refers
    to it, so a filter on parsed JSON parses the text again. A generator's
    output is never inlined.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
