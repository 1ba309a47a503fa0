"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import in_few_tasks as _in_few_tasks
from turnmill.session import materialize

def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars about their least nodes: then no
    node has two edges to lesser ones, or one to a lesser and one to a greater."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    nodes = _in_few_tasks(nodes, 2 * edges.count())
    row = nodes.agg(F.sum("down"), F.count_if((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()
    return row[0] or 0, row[1] == 0


# Both stars take written edges, whose number costs next to nothing. Where it is small, the least
# neighbours are in few tasks as well as the edges that come of them.
def _large_star(edges: DataFrame) -> DataFrame:
    many = 2 * edges.count()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(_in_few_tasks(least, many), "u").filter("v > u")
    # Equal edges are put together by the small star that follows.
    return _in_few_tasks(joined.select(F.col("v").alias("u"), F.col("m").alias("v")), many)


def _small_star(edges: DataFrame) -> DataFrame:
    many = edges.count()
    least = _in_few_tasks(edges.groupBy("u").agg(F.min("v").alias("m")), many)
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _in_few_tasks(_in_few_tasks(moved, many).union(least.select("u", F.col("m").alias("v"))).distinct(), 2 * many)


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Rows ``node, label`` for every node of a link; label is the component's least node.

    Each round joins every node with the least of its neighbours; no node's
    neighbours are gathered, and rounds grow with the logarithm of the nodes. They end when
    all edges are stars, for which no further round is taken. Null ends and links of a node
    with itself are left out. ``rows``, if known, is the most links that there can be; few are
    written by few tasks.
    """
    greater = F.greatest(a, b)
    edges = links.filter(f"{a} != {b}").select(greater.alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges if rows is None else _in_few_tasks(edges, rows), "links")
    many, done = _state(edges)
    while not done:
        edges = materialize(_small_star(materialize(_large_star(edges), "larger")), "stars")
        many, done = _state(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(_in_few_tasks(stars.select(F.col("label").alias("node"), "label").distinct(), many))
