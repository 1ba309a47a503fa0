"""Mixing sources to target weights by hierarchical budgets.

The token budget goes down a tree of domains, languages and sources. A node's
children share its budget by weight; a child that cannot use its share, because
its documents hold fewer tokens even when repeated, leaves the rest to its siblings,
and only what all siblings together can't use goes to the parents' siblings. Each
leaf then takes the first tokens of its seeded epochs: whole epochs first, then the
start of one more, each in its own order. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.llm.common import SPACES, whole
from turnmill.session import materialize

_WIDE = "decimal(38,0)"
# Documents of a leaf whose place is found in one task: those of one bucket.
_BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(whole(text), rf"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def weight_of(name: Column, weights: Mapping[str, int], default: int = 1) -> Column:
    """A whole-number weight by name; ``default`` for names without one."""
    out = F.lit(default)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Give each row with ``budget`` (of its parent), ``cap`` and ``weight`` its ``own``.

    Children are taken in the order in which they fill up as the level rises: one is
    full if its cap is at most its share of what is left after those before it.
    The others divide the rest by weight, in whole tokens, without losing any.
    """
    full_first = W.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")), name)
    before = full_first.rowsBetween(W.unboundedPreceding, -1)
    whole_group = W.partitionBy(*parent)
    used = F.coalesce(F.sum("cap").over(before), F.lit(0))
    taken = F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = children.withColumn("left", (F.col("budget") - used).cast(_WIDE)).withColumn(
        "weight_left", (F.sum("weight").over(whole_group) - taken).cast(_WIDE)
    )
    full = F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight")
    # Once a child has room left, all after it have.
    ranked = ranked.withColumn("full", F.min(full.cast("int")).over(full_first.rowsBetween(W.unboundedPreceding, 0)) == 1)
    open_caps = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole_group)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole_group)
    upto = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(full_first.rowsBetween(W.unboundedPreceding, 0))
    ranked = ranked.select("*", (F.col("budget") - open_caps).alias("rest"), open_weight.alias("open"), upto.alias("upto"))
    part = lambda w: F.expr(f"cast(floor(cast(rest as {_WIDE}) * cast({w} as decimal(18,0)) div open) as long)")
    own = F.when(F.col("full"), F.col("cap")).otherwise(part("upto") - part("(upto - weight)"))
    return ranked.withColumn("own", own.cast("long")).drop("left", "weight_left", "full", "rest", "open", "upto")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], budget: Column, max_epochs: int) -> DataFrame:
    """Rows of ``leaves`` (levels, ``tokens``, a positive ``<level>_weight`` each) with ``target``.

    ``budget`` may refer to ``total``, the tokens of all leaves. ``target`` is at most
    ``max_epochs`` times the leaf's tokens; if the whole tree can't use the budget,
    every leaf is full. The table has one row a leaf, whatever the documents.
    """
    everything = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    grown = everything.select(F.least(budget, F.col("total") * max_epochs).cast("long").alias("budget"))
    parents = grown.withColumn("root", F.lit(0))
    above: list[str] = ["root"]
    rooted = leaves.withColumn("root", F.lit(0))
    for depth, level in enumerate(levels):
        path = [*levels[: depth + 1]]
        caps = rooted.groupBy("root", *path).agg((F.sum("tokens") * max_epochs).alias("cap"), F.max(f"{level}_weight").alias("weight"))
        keys = F.lit(True)
        named = parents.select(*[F.col(c).alias(f"_{c}") for c in above], "budget")
        for c in above:
            keys = keys & F.col(c).eqNullSafe(F.col(f"_{c}"))
        children = caps.join(named, keys).drop(*[f"_{c}" for c in above])
        parents = _share(children, above, level).select("root", *path, F.col("own").alias("budget"))
        above = ["root", *path]
    named = parents.select(*[F.col(c).alias(f"_{c}") for c in levels], F.col("budget").alias("target"))
    keys = F.lit(True)
    for c in levels:
        keys = keys & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return leaves.join(named, keys).drop(*[f"_{c}" for c in levels])


def epoch_key(seed: int, epoch: Column, id_column: str, text_key: str) -> Column:
    """The place of a document in an epoch's order, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_column).cast("string"), F.lit("-")), F.col(text_key)))


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    *,
    budget: Column | None = None,
    max_epochs: int = 2,
    seed: int = 11,
    id_column: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """Rows ``id, text_key, <levels>, tokens, epoch, take_tokens``: the documents of the mixture.

    ``weights[level][name]`` is a positive whole number, 1 where none is given.
    ``budget`` is in tokens and may refer to ``total`` (all tokens, the default);
    ``tokens`` is a document's number of tokens, its words by default. Epoch e is the
    leaf's documents in the order of a seeded hash; a document belongs to the mixture
    once for each epoch it is in. The last document of a leaf is the one in which the
    budget ends, and ``take_tokens`` says how many of its tokens are within. Documents
    without tokens are never chosen, nor are leaves without any. A null id or level
    is a value like others. Rows that are equal in id and text come in the same
    epochs; where the end falls among such rows all of them are taken, and the last
    have fewer tokens, or none, within.
    """
    body = F.col(text)
    rows = docs.select(
        F.col(id_column).alias("id"),
        *[F.col(c).cast("string").alias(c) for c in levels],
        (word_count(body) if tokens is None else tokens).cast("long").alias("tokens"),
        F.md5(whole(body)).alias("text_key"),
    )
    rows = materialize(rows.filter("tokens > 0"), "mix-documents")
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    for c in levels:
        leaves = leaves.withColumn(f"{c}_weight", weight_of(F.col(c), weights.get(c, {})))
    targets = materialize(leaf_budgets(leaves, levels, F.col("total") if budget is None else budget, max_epochs), "leaf-budgets")
    targets = targets.select(
        *[F.col(c).alias(f"_{c}") for c in levels],
        F.expr("target div tokens").alias("epochs"),
        F.expr("target % tokens").alias("over"),
    )
    keys = F.lit(True)
    for c in levels:
        keys = keys & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = rows.join(targets, keys).drop(*[f"_{c}" for c in levels])
    columns = ["id", "text_key", *levels, "tokens"]
    full = placed.filter("epochs > 0").select(
        *columns, F.explode(F.sequence(F.lit(1).cast("long"), "epochs")).alias("epoch"), F.col("tokens").alias("take_tokens")
    )
    # The epoch that is taken in part: sums for ranges of the order find the range in
    # which the budget ends; only the documents of that range are ranked.
    started = placed.filter("over > 0").withColumn("epoch", F.col("epochs") + 1)
    started = started.withColumn("place", epoch_key(seed, F.col("epoch"), "id", "text_key"))
    started = started.withColumn("range", F.substring("place", 1, _BUCKET_DIGITS))
    earlier = W.partitionBy(*levels).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = started.groupBy(*levels, "range").agg(F.sum("tokens").alias("size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in levels], F.col("range").alias("_range"), "size", "before")
    known = started.join(sums, keys & (F.col("range") == F.col("_range"))).drop(*[f"_{c}" for c in levels], "_range")
    inside = known.filter(F.col("before") + F.col("size") <= F.col("over"))
    cut = known.filter((F.col("before") < F.col("over")) & (F.col("before") + F.col("size") > F.col("over")))
    upto = W.partitionBy(*levels).orderBy("place", "id").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    left = F.col("over") - F.col("start")
    last = cut.filter(left > 0).select(*columns, "epoch", F.least("tokens", left).alias("take_tokens"))
    return full.union(inside.select(*columns, "epoch", F.col("tokens").alias("take_tokens"))).union(last)
