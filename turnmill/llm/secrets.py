"""Secret scanning with a random forest that removes false positives.

Candidates are runs of credential characters with a digit among them, and whatever
stands after a credential's name and = or :. Each gets
features of its length, character classes and transitions between them, of how much
of it dictionary words cover, of the path it is in, and of the words beside it. A
random forest learned from labelled findings tells secrets from card numbers,
identifiers and the like. DataFrame and SQL operations and Spark's own forest only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import SPACES, whole
from turnmill.session import materialize

# At least twelve characters that credentials are made of, a digit among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
# A credential's name.
_NAME = r"(?i:token|passw(?:or)?d|passwd|passphrase|pwd|secret|credential|authorization|(?:api|access|private|auth|account|encryption|signing|ssh|master)[_.-]?key)"
# A whole key, of any length, that a name is in. It is tried once, where it begins.
_KEY = r"(?<![\w.-])(?=[\w.-]*?" + _NAME + r")[\w.-]++"
_CLOSED = r"[\"'`\])]{0,2}"
_ASSIGN = _CLOSED + r"\s?(?::=|=>|[=:]{1,2})\s?"
_SCHEME = r"(?:[\"'`]?(?i:bearer|basic|token)\s?)?"
# In one word: up to the closing quote; without quotes, to the end of the word or the next pair.
_PAIR = _KEY + _ASSIGN + r"(?:\"[^\"]+|'[^']+|`[^`]+|[^\"'`]\S*?(?=[&;,][\"'{]?[\w.-]++[\"']?[=:]|$))"
_LEAD = _KEY + _ASSIGN + _SCHEME + "$"
# A value may begin with the sign, if the name is the word before.
_SIGN = r"^(?::=|=>|[=:]{1,2})"
_OPEN, _CLOSE = r"[\"'`({\[<]*", r"[\"'`)}\]>,;]+$"
# Words that name a credential, and words of paths with made-up ones.
_NAMING = r"(?i)(token|passw|secret|api|key|auth|cred|bearer)"
_PRACTICE = r"(?i)(test|example|sample|mock|fixture|demo|doc)"
_BUCKETS = 8
_MAX_DICTIONARY = 20_000
_MIN_DICTIONARY_DOCS = 3
_MAX_LABELLED = 20_000
FINDING = ["id", "path", "word_at", "value_at", "value", "before", "before_2", "prefix", "after"]

FEATURES = [
    "length", "digits", "uppers", "lowers", "marks", "distinct", "runs", "lower_digit", "digit_lower", "upper_digit",
    "digit_upper", "hexadecimal", "coverage", "path_depth", "path_length", "path_practice", "path_bucket", "named_before",
    "named_prefix", "assigned", "quoted", "before_bucket", "before_length", "after_length",
]


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row for each candidate of each whole text, with the words beside it.

    ``word_at`` is the place of its word among those between ASCII white space, from
    0; ``value_at`` its place in the word. Null texts have none.
    """
    body = F.col(text)
    rows = docs.filter(body.rlike(CANDIDATE) | body.rlike(_NAME)).select(
        F.col(id_column).alias("id"), whole(F.col(path).cast("string")).alias("path"), F.split(F.trim(F.regexp_replace(body, SPACES, " ")), " ").alias("words")
    )
    around = F.transform(
        "words",
        lambda w, i: F.struct(
            i.alias("word_at"), w.alias("word"), F.get("words", i - 2).alias("before_2"),
            F.get("words", i - 1).alias("before"), F.get("words", i + 1).alias("after"),
            F.concat_ws(" ", F.get("words", i - 3), F.get("words", i - 2), F.get("words", i - 1)).alias("lead"),
        ),
    )
    of_interest = lambda s: s["word"].rlike(CANDIDATE) | s["word"].rlike(_NAME) | s["lead"].rlike(_NAME)
    found = rows.select("id", "path", F.explode(F.filter(around, of_interest)).alias("s")).select("id", "path", "s.*")
    word = F.col("word")
    runs = F.transform(F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)), lambda v: F.struct(v.alias("value"), F.call_function("substring_index", word, v, F.lit(1)).alias("prefix")))
    named = F.concat(_pairs(word), _led(word, F.col("lead")))
    more = F.filter(named, lambda n: (n["value"] != "") & ~F.exists(runs, lambda r: r["value"] == n["value"]))
    values = F.concat(runs, F.array_distinct(more))
    one = found.select("id", "path", "word_at", "before_2", "before", "after", F.posexplode(values).alias("value_at", "v"))
    return one.select(
        "id", "path", "word_at", "value_at", "v.value", whole(F.col("before")).alias("before"), whole(F.col("before_2")).alias("before_2"),
        "v.prefix", whole(F.col("after")).alias("after"),
    )


def _pairs(word: Column) -> Column:
    """Values and what is before them, of the pairs of a name and a value in a word."""
    def pair(match: Column) -> Column:
        head = F.regexp_extract(match, r"^[\w.-]++" + _ASSIGN + _OPEN, 0)
        value = F.regexp_replace(F.substr(match, F.length(head) + 1), _CLOSE, "")
        return F.struct(value.alias("value"), F.concat(F.call_function("substring_index", word, match, F.lit(1)), head).alias("prefix"))

    return F.transform(F.regexp_extract_all(word, F.lit(_PAIR), F.lit(0)), pair)


def _led(word: Column, lead: Column) -> Column:
    """The value that a word is, if a name and the sign end before it or in its first characters."""
    head = F.when(lead.rlike(_LEAD), F.regexp_extract(word, "^" + _OPEN, 0)).otherwise(F.regexp_extract(word, _SIGN + _OPEN, 0))
    value = F.regexp_replace(F.substr(word, F.length(head) + 1), _CLOSE, "")
    # Signs and schemes alone are no values.
    told = (lead.rlike(_LEAD) & ~word.rlike(r"^[\"'`]?(?i:bearer|basic|token)$") & ~word.rlike(r"^[=:>]+$")) | (
        lead.rlike(_KEY + _CLOSED + "$") & word.rlike(_SIGN)
    )
    return F.when(told & (value != ""), F.array(F.struct(value.alias("value"), head.alias("prefix")))).otherwise(
        F.array().cast("array<struct<value:string,prefix:string>>")
    )


def dictionary(docs: DataFrame, text: str = "text", min_docs: int = _MIN_DICTIONARY_DOCS, size: int = _MAX_DICTIONARY) -> DataFrame:
    """The ``size`` words of letters that are in most documents, ``min_docs`` at least.

    All documents are counted. ``size`` bounds the table, which is broadcast, and says what
    coverage means: the share of a value that common words make up. No candidate is left
    out for it.
    """
    words = F.explode(F.array_distinct(F.split(F.lower(whole(F.col(text))), r"[^\p{L}]+"))).alias("word")
    counted = docs.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = counted.filter((F.length("word") > 2) & (F.col("n") >= min_docs))
    return materialize(often.orderBy(F.desc("n"), "word").limit(size).select("word"), "dictionary")


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def _flag(test: Column) -> Column:
    return test.cast("double")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` (rows of :func:`candidates`, further columns pass) with ``FEATURES``.

    ``words``: the dictionary, of bounded size. Coverage is the share of the value's
    characters in parts of letters that are dictionary words.
    """
    value, size = F.col("value"), F.length("value").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    parts = found.select("value", F.explode(F.array_distinct(F.split(F.lower(value), "[^a-z]+"))).alias("word")).distinct()
    known = parts.join(F.broadcast(words), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    joined = found.join(known, "value", "left")
    return joined.withColumns(
        {
            "length": size,
            "digits": _count(value, "[0-9]") / size,
            "uppers": _count(value, "[A-Z]") / size,
            "lowers": _count(value, "[a-z]") / size,
            "marks": _count(value, "[^A-Za-z0-9]") / size,
            "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double"),
            "runs": F.length(kinds) / size,
            "lower_digit": _count(value, "[a-z](?=[0-9])") / size,
            "digit_lower": _count(value, "[0-9](?=[a-z])") / size,
            "upper_digit": _count(value, "[A-Z](?=[0-9])") / size,
            "digit_upper": _count(value, "[0-9](?=[A-Z])") / size,
            "hexadecimal": _flag(value.rlike("^[0-9a-f]+$")),
            "coverage": F.coalesce(F.col("covered"), F.lit(0)) / size,
            "path_depth": _count(F.col("path"), "/"),
            "path_length": F.length("path").cast("double"),
            "path_practice": _flag(F.col("path").rlike(_PRACTICE)),
            "path_bucket": F.pmod(F.xxhash64("path"), F.lit(_BUCKETS)).cast("double"),
            "named_before": _flag(F.col("before").rlike(_NAMING) | F.col("before_2").rlike(_NAMING)),
            "named_prefix": _flag(F.col("prefix").rlike(_NAMING)),
            "assigned": _flag(F.col("prefix").rlike("[=:]") | F.col("before").rlike("[=:]$")),
            "quoted": _flag(F.col("prefix").rlike("[\"'`]$")),
            "before_bucket": F.pmod(F.xxhash64(F.lower("before")), F.lit(_BUCKETS)).cast("double"),
            "before_length": F.length("before").cast("double"),
            "after_length": F.length("after").cast("double"),
        }
    ).drop("covered")


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train_forest(
    labelled: DataFrame, *, trees: int = 20, depth: int = 6, seed: int = 5, max_labelled: int = _MAX_LABELLED
) -> RandomForestClassificationModel | None:
    """A forest from rows of :func:`features` with ``label`` (0 or 1; null rows are
    left out). Findings of equal value, before, prefix and label count once. At most
    ``max_labelled`` of each label are used, those with the least hashes. None if the
    labels aren't of both kinds."""
    names = ["value", "before", "prefix", "label"]
    rows = labelled.filter(F.col("label").isNotNull()).groupBy(*names).agg(F.min(F.struct(*FEATURES)).alias("f"))
    key = F.xxhash64(F.lit(seed), "value", "before", "prefix")
    kinds = [rows.filter(F.col("label") == kind).orderBy(key, "value", "before", "prefix").limit(max_labelled) for kind in (0, 1)]
    rows = kinds[0].union(kinds[1])
    rows = materialize(rows.select(F.col("label").cast("double").alias("label"), *[F.col("f")[c].alias(c) for c in FEATURES]), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(rows))


def judge(rows: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """``rows`` (of :func:`features`) with ``score``, the forest's probability of a
    secret, and ``secret`` (at least a half). Without a forest every candidate counts."""
    if forest is None:
        return rows.withColumns({"score": F.lit(1.0), "secret": F.lit(True)})
    scored = forest.transform(_vectors(rows))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.withColumn("score", score).withColumn("secret", F.col("score") >= 0.5).drop("features", "rawPrediction", "probability", "prediction")


def reviewed_label(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` that a table of reviewed findings (``id, value, label``) has
    for them. Of several labels of a finding the largest counts, so a secret stays one."""
    known = reviewed.groupBy(F.col("id").alias("_id"), F.col("value").alias("_value")).agg(F.max("label").alias("label"))
    known = materialize(known, "reviewed")
    return rows.join(known, (F.col("id") == F.col("_id")) & (F.col("value") == F.col("_value")), "left").drop("_id", "_value")


def scan_secrets(docs: DataFrame, label: Column | DataFrame, id_column: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Judged candidates of all documents: ``FINDING`` columns, ``score``, ``secret``.

    ``label`` is a table of reviewed findings, ``id, value, label`` (0 or 1), or a column that
    gives 0 or 1 for a finding (its ``FINDING`` and ``FEATURES`` columns) that was reviewed,
    null for others. A null path counts as empty. Repeated rows give repeated findings, and
    equal findings equal scores; tables without candidates give no rows.
    """
    found = materialize(candidates(docs, id_column, text, path), "findings")
    rows = materialize(features(found, dictionary(docs, text)), "finding-features")
    labelled = reviewed_label(rows, label) if isinstance(label, DataFrame) else rows.withColumn("label", label)
    return judge(rows, train_forest(labelled)).select(*FINDING, "score", "secret")
