"""Rows that every operator must take: nulls, empty and long texts, ties, clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word" * 60_000 + " " + " ".join(f"w{i}" for i in range(20_000))
NEAR = " ".join(f"near{i}" for i in range(60))

ROWS = [
    (1, "The quick brown fox\njumps over\nthe lazy dog\nand runs away", "en", "src0", 50),
    (2, "The quick brown fox\njumps over\nthe lazy dog\nand runs away", "en", "src0", 50),
    (2, "The quick brown fox\njumps over\nthe lazy dog\nand runs away", "en", "src0", 50),
    (3, None, None, None, None),
    (4, None, "en", "src1", None),
    (5, "", "en", "src1", 0),
    (6, " \t\n ", "fr", "src2", 4),
    (None, "no id at all, but a text", "en", "src3", 24),
    (None, None, None, None, None),
    (7, LONG, "en", "src4", len(LONG)),
    (8, NEAR, "de", "src5", len(NEAR)),
    (9, NEAR + " more", "de", "src6", len(NEAR) + 5),
    (10, "0123 4567 !!!", "en", "src7", 13),
    (11, "The  quick brown fox\njumps over\r\nthe lazy dog\nand runs\taway", "en", "src0", 50),
    (12, "<|endoftext|> émigré 漢字 \U0001f600 it's 123", "fr", "src8", 30),
]

# Names that the operators use for columns of their own.
CLASHING = [
    "id", "key", "_key", "_id", "_row", "_text", "size", "shard", "slot", "bucket", "row", "vector", "cells", "node", "n", "hash", "chunk", "cut", "lang_pred",
    "score", "ids", "n_tokens", "decoded", "digest", "tokens", "weight", "budget", "epoch", "domain", "removed", "n_lines", "words", "label", "features", "url_",
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def plain(rows, *columns):
    """Rows as sorted tuples; nulls sort first."""
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda t: [(x is not None, str(type(x)), x) for x in t])
