"""URL filtering by rules and, where none fits, by two character language models.

URLs that a rule allows teach one Markov model, URLs that a rule blocks the other. A
model's order varies: the probability of a character after a context is smoothed with
that after the context without its first character, in proportion to how seldom the
longer context was seen, down to single characters. So a context counts as far back as
it was seen. A URL's score is the difference of its log-likelihoods under both models by
its length; the cutoff is calibrated on URLs with a rule that taught neither model.

Counts, probabilities and scores are DataFrame operations over tables of n-grams. The
tables grow with the URLs; nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.session import materialize

# Characters of the longest context.
ORDER = 4
# How many sightings the shorter context is worth.
STRENGTH = 2.0
# Marks that stand before a URL and after it.
_START, _END = "\x02", "\x03"
# Log ratios are whole millionths, so that sums don't depend on their order.
_UNIT = 1_000_000
# Scores are told apart by thousandths.
_BIN = _UNIT // 1000
# URLs whose MD5 begins with one of these calibrate: 3 of 16.
_CALIBRATING = ["0", "1", "2"]
# An n-gram with at least this share of all places is joined by broadcast: so many at most.
_FREQUENT = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest of the ``rules`` (verdict, host/path) that fits,
    both null where none does. A rule fits its host and its subdomains, and every path that
    begins with its own. Of equally long ones that fit, the first in order of text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own, slash, below = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + below)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def places(urls: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``gram`` for each character of ``url`` and its end: that
    character after the ``ORDER`` before it."""
    url = F.col("url")
    own = F.when(url == "", F.array().cast("array<string>")).otherwise(F.split(url, ""))
    chars = F.concat(F.array_repeat(F.lit(_START), ORDER), own, F.array(F.lit(_END)))
    split = urls.select(*keep, chars.alias("_chars"))
    gram = lambda i: F.concat(*[F.get("_chars", i + j) for j in range(ORDER + 1)])
    ends = F.sequence(F.lit(0), F.size("_chars") - ORDER - 1)
    return split.select(*keep, F.explode(F.transform(ends, gram)).alias("gram"))


def _smoothed(seen: str, below: str, context: str) -> Column:
    """The probability of a character, from its count after a context, its probability
    after the shorter one, and the count of the context."""
    return (F.col(seen).cast("double") + F.lit(STRENGTH) * F.col(below)) / (F.col(context).cast("double") + F.lit(STRENGTH))


def log_ratios(counted: DataFrame) -> DataFrame | None:
    """``gram, weight, uses``: the logarithm of what the accepting model says over what the
    rejecting one says, in millionths. ``counted`` has ``gram, accepted, rejected, uses``.
    None if either model has seen nothing.
    """
    both = ("accepted", "rejected")
    sums = [F.sum(c).alias(c) for c in both]
    levels = [counted]
    for _ in range(ORDER):
        shorter = levels[0].groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(*sums)
        levels.insert(0, materialize(shorter, "url-grams"))
    whole = levels[0].agg(F.count(F.lit(1)).alias("symbols"), *sums).first()
    if not whole["accepted"] or not whole["rejected"]:
        return None
    start = levels[0].withColumns({f"{c}_below": F.lit(1.0) / F.lit(float(whole["symbols"])) for c in both})
    start = start.withColumns({f"{c}_context": F.lit(whole[c]) for c in both})
    known = start.select("gram", *[_smoothed(c, f"{c}_below", f"{c}_context").alias(f"{c}_below") for c in both])
    for order, level in enumerate(levels[1:], 1):
        known = materialize(known.withColumnRenamed("gram", "_shorter"), "url-probabilities")
        context = F.substring("gram", 1, order)
        contexts = level.groupBy(context.alias("_context")).agg(*[F.sum(c).alias(f"{c}_context") for c in both])
        contexts = materialize(contexts, "url-contexts")
        joined = level.join(known, F.substr("gram", F.lit(2)) == F.col("_shorter")).join(contexts, context == F.col("_context"))
        more = ["uses"] if order == ORDER else []
        known = joined.select("gram", *more, *[_smoothed(c, f"{c}_below", f"{c}_context").alias(f"{c}_below") for c in both])
    ratio = F.log(F.col("accepted_below")) - F.log(F.col("rejected_below"))
    return known.select("gram", F.round(ratio * _UNIT).cast("long").alias("weight"), "uses")


def scores(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """``row, score``: thousandths of the log-likelihood difference a character, rounded down.

    ``urls`` has ``row`` and ``url``, ``weights`` is what :func:`log_ratios` gives. N-grams that
    every URL holds are few and are joined by broadcast, so no n-gram of the shuffle join has
    more than a small share of all places.
    """
    weights = materialize(weights.filter("uses > 0"), "url-weights")
    uses = weights.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n")).first()["n"]
    frequent = F.col("uses") * _FREQUENT >= F.lit(uses)
    own = places(urls, "row")
    hot = own.join(F.broadcast(weights.filter(frequent).select("gram", "weight")), "gram")
    rest = own.join(weights.filter(~frequent).select("gram", "weight"), "gram")
    summed = hot.select("row", "weight").union(rest.select("row", "weight")).groupBy("row").agg(F.sum("weight").alias("sum"), F.count(F.lit(1)).alias("n"))
    by = F.col("n") * _BIN
    return summed.select("row", F.call_function("div", F.col("sum") - F.pmod("sum", by), by).alias("score"))


def calibrate(scored: DataFrame) -> int:
    """The cutoff at which the shares of accepted URLs below it and of rejected URLs from it
    on have the smallest sum; the nearest to 0 of equal ones, then the least. 0 if a kind is
    missing. ``scored`` has ``score`` and ``accepted`` (boolean).

    Scores are sums of logarithms by length, so there are some ten thousand of them at
    most, whatever the number of URLs.
    """
    ones = scored.groupBy("score").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    # One more candidate above all scores, and 0.
    more = [ones.agg((F.max("score") + 1).alias("score")).filter("score is not null"), ones.limit(1).select(F.lit(0).cast("long").alias("score"))]
    for extra in more:
        ones = ones.unionByName(extra.withColumns({"good": F.lit(0).cast("long"), "bad": F.lit(0).cast("long")}))
    ones = ones.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    below = W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    counted = ones.select(
        "score", F.coalesce(F.sum("good").over(below), F.lit(0)).alias("good_lost"), F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("bad_found"),
        F.sum("good").over(whole).alias("all_good"), F.sum("bad").over(whole).alias("all_bad"),
    )
    wide = [F.col(c).cast("decimal(18,0)") for c in ("good_lost", "bad_found", "all_good", "all_bad")]
    cost = wide[0] * wide[3] + (wide[3] - wide[1]) * wide[2]
    best = counted.filter("all_good > 0 and all_bad > 0").orderBy(cost, F.abs("score"), "score").select("score").first()
    return best["score"] if best else 0


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, score`` of every row.

    ``verdict`` is the longest fitting rule's; where none fits, ``allow`` if the score is at
    least the calibrated cutoff, else ``block``. ``score`` is null where the models were not
    asked. A null URL counts as empty and is scored as such; without URLs of both verdicts
    to learn from everything that no rule fits is allowed. Repeated rows teach each time and
    are judged alike. An empty table gives no rows; other columns are not looked at.
    """
    address = F.coalesce(pages[url], F.lit(""))
    rows = pages.select(pages[id_column].alias("id"), address.alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    rule, told = fitting_rule(F.col("host"), F.col("path"), rules)
    held = F.substring(F.md5("url"), 1, 1).isin(_CALIBRATING)
    rows = rows.select("*", rule.alias("rule"), told.alias("told"), held.alias("held"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "urls")
    asked = F.col("told").isNull() | F.col("held")
    marks = rows.select("url", *[(~asked & (F.col("told") == kind)).cast("long").alias(c) for c, kind in (("accepted", "allow"), ("rejected", "block"))], asked.cast("long").alias("uses"))
    names = ["accepted", "rejected", "uses"]
    found = places(marks.withColumns({c: F.coalesce(c, F.lit(0)) for c in names}), *names)
    counted = materialize(found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names]), "url-grams")
    weights = log_ratios(counted)
    columns = ["id", "host", "path", "rule", "verdict", "score"]
    if weights is None:
        return rows.select("id", "host", "path", "rule", F.coalesce("told", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("score"))
    scored = materialize(scores(rows.filter(asked).select("row", "url"), weights), "url-scores")
    judged = rows.filter("told is null").join(scored, "row")
    cutoff = calibrate(rows.filter("told is not null").join(scored, "row").select("score", (F.col("told") == "allow").alias("accepted")))
    verdict = F.when(F.col("score") >= cutoff, "allow").otherwise("block")
    decided = rows.filter("told is not null").select("id", "host", "path", "rule", F.col("told").alias("verdict"), F.lit(None).cast("long").alias("score"))
    return decided.union(judged.withColumn("verdict", verdict).select(*columns))
