"""Perplexity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.tokens import given_tokens, whitespace_tokens
from turnmill.operators.lengths import with_token_count
from turnmill.operators.perplexity import BigramModel, perplexity
from turnmill.operators.split import seeded_split
from turnmill.plans.evaluation import evaluation_report
from turnmill.plans.prepare import prepare
from turnmill.queries import adapters as a
from turnmill.queries.batches import _TOKENS
from turnmill.session import materialize


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _perplexity_by_lang(spark, sf_dir) -> DataFrame:
    documents = a.documents(spark, sf_dir, "lang", "text")
    losses = with_token_count(documents).withColumn("loss", (F.col("doc_id") % 97) / 10.0 + 0.5)
    return _rounded(perplexity(losses, "lang"), "perplexity")


def _held_out(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training and held-out token arrays. The held-out ones are written, since they are read
    again; training reads its texts once, so their tokens are counted as they are cut."""
    split = seeded_split(a.documents(spark, sf_dir, "lang", "text"), "doc_id", ratio=0.05, seed=42)
    tokens = split.select("doc_id", "lang", "split", whitespace_tokens(F.col("text")).alias("tokens"))
    return tokens.filter("split = 'train'"), materialize(tokens.filter("split = 'eval'"), "tokens")


def _bigram_perplexity(spark, sf_dir) -> DataFrame:
    train, held_out = _held_out(spark, sf_dir)
    return _rounded(BigramModel(train, "tokens", tokenizer=given_tokens).perplexity(held_out, "lang", text="tokens"), "perplexity")


def _bigram_losses(spark, sf_dir) -> DataFrame:
    train, held_out = _held_out(spark, sf_dir)
    return _rounded(BigramModel(train, "tokens", tokenizer=given_tokens).losses(held_out, "doc_id", text="tokens"), "loss")


# Limits that a table of a hundred conversations reaches.
FEW_SAMPLES, SHORT = 5, 24


def _eval_report(spark, sf_dir, **limits) -> DataFrame:
    """A model of ``documents`` scored on the prepared conversations, by layout."""
    model = BigramModel(a.documents(spark, sf_dir, "text"))
    corpus = prepare(a.parsed(a.mixed_records(spark, sf_dir)), "conv_id", eval_ratio=0.0, on_error="skip")
    corpus = corpus.select("conv_id", "format", "text").withColumnRenamed("format", "dataset")
    return _rounded(evaluation_report(model, corpus, "dataset", ["conv_id"], "conv_id", **limits), "perplexity")


QUERIES = {
    "perplexity_by_lang": _perplexity_by_lang,
    "bigram_perplexity": _bigram_perplexity,
    "bigram_losses": _bigram_losses,
    "eval_report": _eval_report,
    "eval_report_limits": lambda s, d: _eval_report(s, d, max_samples=FEW_SAMPLES, max_length=SHORT),
}

_SPLIT = """
split AS (
  SELECT doc_id, lang, text,
         row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= ceil(0.05::DOUBLE * count(*) OVER ()) AS held
  FROM documents)"""


def _model_sql(train: str) -> str:
    """Bigram tables of the relation ``train`` (text)."""
    return f"""
train_tokens AS (SELECT {_TOKENS} AS t FROM {train}),
words AS (
  SELECT prev, sum(followed) AS prev_count FROM (
    SELECT unnest(t) AS prev, unnest(range(1, len(t) + 1)) < len(t) AS followed FROM train_tokens)
  GROUP BY prev),
pairs AS (
  SELECT prev, next, count(*) AS pair_count FROM (
    SELECT unnest(t[1:len(t) - 1]) AS prev, unnest(t[2:]) AS next FROM train_tokens WHERE len(t) > 1)
  GROUP BY prev, next),
vocab AS (SELECT count(*) + 1 AS size FROM words WHERE prev <> '<unk>')"""


def _scored_sql(source: str, ids: str, limit: str = "") -> str:
    """Negative log likelihood of every prediction of ``source`` (ids, text)."""
    return f"""
eval_tokens AS (SELECT {ids}, ({_TOKENS}){limit} AS t FROM {source}),
eval_pairs AS (
  SELECT {ids}, unnest(t[1:len(t) - 1]) AS prev0, unnest(t[2:]) AS next0 FROM eval_tokens WHERE len(t) > 1),
known AS (
  SELECT {ids}, CASE WHEN p.prev IS NULL THEN '<unk>' ELSE prev0 END AS prev,
         CASE WHEN n.prev IS NULL THEN '<unk>' ELSE next0 END AS next
  FROM eval_pairs e LEFT JOIN words p ON e.prev0 = p.prev LEFT JOIN words n ON e.next0 = n.prev),
scored AS (
  SELECT {ids}, -ln((coalesce(pair_count, 0) + 1.0::DOUBLE)
                    / (coalesce(prev_count, 0) + 1.0::DOUBLE * (SELECT size FROM vocab))) AS nll
  FROM known k LEFT JOIN pairs b ON k.prev = b.prev AND k.next = b.next LEFT JOIN words w ON k.prev = w.prev)"""


def _report_sql(samples: int, length: int) -> str:
    return a.SQL_MIXED + f""",
        sample AS (
          SELECT * FROM (
            SELECT conv_id, format AS dataset, text,
                   row_number() OVER (PARTITION BY format ORDER BY conv_id) AS place FROM mixed_rendered)
          WHERE place <= {samples}),
        {_model_sql("documents")}, {_scored_sql("sample", "conv_id, dataset", f"[1:{length}]")}
        SELECT dataset, round(exp(sum(nll) / count(*)), 6) AS perplexity,
               CAST(count(DISTINCT conv_id) AS BIGINT) AS n_used FROM scored GROUP BY dataset"""


ORACLES = {
    "perplexity_by_lang": f"""
        WITH l AS (
          SELECT lang, (doc_id % 97) / 10.0::DOUBLE + 0.5::DOUBLE AS loss,
                 least(len({_TOKENS}), 1024) AS n FROM documents)
        SELECT lang, round(exp(sum(loss * (n - 1)) / sum(n - 1)), 6) AS perplexity,
               CAST(count(*) AS BIGINT) AS n_used
        FROM l WHERE n >= 2 GROUP BY lang""",
    "bigram_perplexity": f"""
        WITH {_SPLIT}, train AS (SELECT text FROM split WHERE held = false),
        held AS (SELECT doc_id, lang, text FROM split WHERE held),
        {_model_sql("train")}, {_scored_sql("held", "doc_id, lang")}
        SELECT lang, round(exp(sum(nll) / count(*)), 6) AS perplexity,
               CAST(count(DISTINCT doc_id) AS BIGINT) AS n_used FROM scored GROUP BY lang""",
    "bigram_losses": f"""
        WITH {_SPLIT}, train AS (SELECT text FROM split WHERE held = false),
        held AS (SELECT doc_id, text FROM split WHERE held),
        {_model_sql("train")}, {_scored_sql("held", "doc_id")}
        SELECT doc_id, CAST(count(*) + 1 AS BIGINT) AS n_tokens, round(avg(nll), 6) AS loss
        FROM scored GROUP BY doc_id""",
    "eval_report": _report_sql(200, 1024),
    "eval_report_limits": _report_sql(FEW_SAMPLES, SHORT),
}
