"""Connected components of small tables of links."""

from pathlib import Path

from pyspark.sql import functions as F

from turnmill import session
from turnmill.llm import components as comp


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """With many shuffle partitions, each held to its number, a small table is in few files."""
    written = []
    keep = comp.materialize
    monkeypatch.setattr(comp, "materialize", lambda df, name: written.append(df.rdd.getNumPartitions()) or keep(df, name))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.range(60).filter("id % 20 != 19").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        got = {r["node"]: r["label"] for r in comp.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: n - n % 20 for n in range(60)}
    assert len(written) > 2 and max(written[1:]) <= spark.sparkContext.defaultParallelism


def test_many_edges_keep_their_tasks(spark):
    edges = spark.range(0, 100, 1, 8).select(F.col("id").alias("u"), F.col("id").alias("v"))
    few = spark.sparkContext.defaultParallelism
    assert comp._in_few_tasks(edges, 10**9).rdd.getNumPartitions() == 8
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert comp._in_few_tasks(edges, 10).rdd.getNumPartitions() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_written_table_leaves_no_shuffle_files(spark):
    name = session._REMOVE_SHUFFLES
    before = spark.conf.get(name, None)
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {f for f in local.rglob("shuffle_*.data")}
    there = files()
    df = spark.range(100_000).groupBy((F.col("id") % 9973).alias("k")).agg(F.sum("id").alias("s"))
    table = session.materialize(df)
    assert not files() - there
    # Only the write has the setting; frames that run again keep their files.
    assert spark.conf.get(name, None) == before
    assert table.count() == 9973 and sorted(table.collect()) == sorted(df.collect())


def test_stars_take_no_further_round(spark, monkeypatch):
    """A round that would change nothing is not run, and stars at the start need none."""
    rounds, keep = [], comp._small_star
    monkeypatch.setattr(comp, "_small_star", lambda edges: rounds.append(1) or keep(edges))
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 1), (4, 3), (3, 4), (2, 2), (None, 6)], "a int, b int")
    assert {r["node"]: r["label"] for r in comp.components(stars).collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    assert not rounds
    path = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert {r["node"]: r["label"] for r in comp.components(path).collect()} == {1: 1, 2: 1, 3: 1}
    assert len(rounds) == 1
    assert comp.components(stars.filter("false")).count() == 0
