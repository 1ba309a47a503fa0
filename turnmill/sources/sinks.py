"""Write a prepared corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_splits(prepared: DataFrame, path: str, *, file_format: str = "parquet") -> None:
    """One folder per split below ``path``.

    ``parquet`` keeps every column. ``json`` writes one ``{"text": ...}`` object
    per line, which the record reader takes back as plain text.
    """
    if file_format == "json":
        prepared.select("text", "split").write.partitionBy("split").json(path)
    elif file_format == "parquet":
        prepared.write.partitionBy("split").parquet(path)
    else:
        raise ValueError("file_format must be 'parquet' or 'json'")
