"""From raw documents to encoded training text, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import bpe, jaccard, langid, line_dedup, mixing
from turnmill.llm.queries import MIX_LEVELS, MIX_WEIGHTS, vocabulary, with_domain
from turnmill.session import new_folder

# A text whose cosine with every learned language is below this is in none of them; with n
# trigrams, below this times the root of n / (n + FEW_TRIGRAMS). The cosine of a text that
# is in a language grows with the root of its trigrams while they are few.
MIN_LANGUAGE_SCORE = 0.1
FEW_TRIGRAMS = 100
MAX_EPOCHS = 2
SEED = 11


def _with_text(docs: DataFrame, names: list[str], row: str = "_row") -> DataFrame:
    """``docs`` as they were, from ``row``, with the text that stands beside it."""
    changed: dict[str, Column] = {"text": F.col("_text")}
    if "n_chars" in names:
        size = F.length("_text")
        changed["n_chars"] = F.when(F.col("_changed"), size.cast("long")).otherwise(F.col(f"{row}.n_chars"))
    return docs.select(*[changed[c].alias(c) if c in changed else F.col(row)[c].alias(c) for c in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages that the table names.

    Null texts, texts without letters and texts unlike every language go; how alike a text
    has to be follows its number of trigrams, by one rule for every length. Languages are
    learned from the documents themselves, each row counting, rows without an id too; a
    document's own label doesn't decide. Equal texts get equal decisions.
    """
    profiles = langid.learn_profiles(docs)
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    found = langid.identify(rows, profiles, ["_row"], text="_text")
    least = MIN_LANGUAGE_SCORE * F.sqrt(F.col("n_trigrams") / (F.col("n_trigrams") + FEW_TRIGRAMS))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)
    return found.filter(known).select("_row.*")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; n_chars follows the text.

    Documents of which nothing is left go.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct("*").alias("_row"))
    clean = line_dedup.remove_passages(rows, "_id", "_text").withColumn("_changed", F.col("removed_lines") > 0)
    left = ~F.col("_changed") | (F.trim(F.regexp_replace("_text", r"\s+", " ")) != "")
    return _with_text(clean.filter(left), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class under 5-word shingles and similarity 0.75."""
    return jaccard.first_of_classes(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, once for each epoch they are in.

    As many words as there are, dealt to domains, languages and sources by weight, none
    more than twice. The document in which a source's share ends comes whole.
    """
    placed = with_domain(docs.select("doc_id", "text", "lang", "source"))
    chosen = mixing.mix(placed, MIX_LEVELS, MIX_WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED)
    # Rows that are equal in id and text are chosen alike: one entry for all of them.
    times = chosen.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in MIX_LEVELS[1:]]).agg(
        F.collect_set("epoch").alias("_epochs")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("_key"))
    for c in MIX_LEVELS[1:]:
        same = same & F.col(c).cast("string").eqNullSafe(F.col(f"_{c}"))
    joined = docs.select(F.struct("*").alias("_row"), "doc_id", "text", *MIX_LEVELS[1:]).join(times, same)
    return joined.select("_row", F.explode("_epochs")).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids`` (little-endian 32-bit), ``n_tokens``, and whether the ids
    decode to the text; a null text counts as empty."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    done = bpe.encode_documents(rows, vocabulary(), text="_text", keep=["_row"], decoded=True)
    same = F.col("decoded") == F.coalesce(F.col("_row.text"), F.lit(""))
    made = {"ids": F.col("ids"), "n_tokens": F.col("n_tokens"), "round_trip": same}
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in made]
    return done.select(*own, *[x.alias(c) for c, x in made.items()])


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
# Hyperdimensional profiles, rolling hashes and the automaton have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = new_folder(spark, f"pipeline-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
