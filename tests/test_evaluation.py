import collections
import math

import pytest
from pyspark.sql import functions as F

from turnmill.operators import checkpoints as ck
from turnmill.operators.perplexity import BigramModel, perplexity
from turnmill.operators.timing import benchmark_summary, mark_warmup, request_timing
from turnmill.plans.evaluation import evaluation_report


def losses(spark, rows):
    return spark.createDataFrame(rows, "g string, loss double, n_tokens int")


def test_perplexity_example(spark):
    row = perplexity(losses(spark, [("a", 1.0, 3), ("a", 2.0, 5), ("a", 9.0, 1)]), "g").first()
    assert row["perplexity"] == pytest.approx(math.exp(10 / 6)) and row["n_used"] == 2


def test_perplexity_truncates_and_handles_nothing(spark):
    df = losses(spark, [("a", 1.0, 3000), ("a", 3.0, 2), ("b", 1.0, 1), ("b", 1.0, 0)])
    got = {r["g"]: r for r in perplexity(df, "g").collect()}
    assert got["a"]["perplexity"] == pytest.approx(math.exp((1023 + 3) / 1024))
    assert math.isnan(got["b"]["perplexity"]) and got["b"]["n_used"] == 0
    whole = perplexity(df.filter("g = 'a'"), max_length=None).first()
    assert whole["perplexity"] == pytest.approx(math.exp((2999 + 3) / 3000))
    empty = perplexity(df.filter("false")).first()
    assert math.isnan(empty["perplexity"]) and empty["n_used"] == 0


TRAIN = ["a b a b c", "b", "c a a", "", "<unk> a"]
EVAL = {1: "a b z a", 2: "q", 3: "b", 4: "z z", 5: "c <unk> a"}


def by_hand(train, text, k=1.0):
    words = {w for t in train for w in t.split()} | {"<unk>"}
    pairs, firsts = collections.Counter(), collections.Counter()
    for t in train:
        w = t.split()
        pairs.update(zip(w, w[1:]))
        firsts.update(w[:-1])
    w = [x if x in words else "<unk>" for x in text.split()]
    return [-math.log((pairs[p] + k) / (firsts[p[0]] + k * len(words))) for p in zip(w, w[1:])]


def test_bigram_losses(spark):
    model = BigramModel(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    texts = spark.createDataFrame(list(EVAL.items()), "id int, text string")
    got = {r["id"]: (r["n_tokens"], r["loss"]) for r in model.losses(texts, "id").collect()}
    assert set(got) == {1, 4, 5}
    for i, (n, loss) in got.items():
        nll = by_hand(TRAIN, EVAL[i])
        assert n == len(nll) + 1 and loss == pytest.approx(sum(nll) / len(nll))


def test_group_perplexity_equals_the_one_over_losses(spark):
    model = BigramModel(spark.createDataFrame([(t,) for t in TRAIN], "text string"), k=0.5)
    texts = spark.createDataFrame([(i % 2, i, t) for i, t in EVAL.items()] + [(2, 9, "x")], "g int, id int, text string")
    direct = {r["g"]: r for r in model.perplexity(texts, "g").collect()}
    by_example = {r["g"]: r for r in perplexity(model.losses(texts, "g", "id"), "g").collect()}
    for g, row in by_example.items():
        assert direct[g]["perplexity"] == pytest.approx(row["perplexity"]) and direct[g]["n_used"] == row["n_used"]
    assert math.isnan(direct[2]["perplexity"]) and direct[2]["n_used"] == 0


def test_evaluation_report_takes_the_head(spark):
    model = BigramModel(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    corpus = spark.createDataFrame([("d", i, "a b c a b") for i in range(30)] + [("e", 1, "a b")], "ds string, id int, text string")
    rows = {r["ds"]: r for r in evaluation_report(model, corpus, "ds", ["id"], "id", max_samples=7, max_length=3).collect()}
    assert rows["d"]["n_used"] == 7 and rows["e"]["n_used"] == 1
    nll = by_hand(TRAIN, "a b c")
    assert rows["d"]["perplexity"] == pytest.approx(math.exp(sum(nll) / 2))


RUNS = "engine string, run_index int, is_warmup boolean, prompt_tokens bigint, gen_tokens bigint, total_s double, ttft_s double"


def test_benchmark_example(spark):
    rows = [
        ("e", 0, True, 1, 99, 50.0, 9.0),
        ("e", 1, False, 5, 10, 2.0, 0.5),
        ("e", 2, False, 6, 20, 4.0, 0.5),
        ("one", 0, False, 1, 1, 2.0, 0.5),
        ("slow", 0, False, 1, 4, 2.0, 3.0),
        ("zero", 0, False, 1, 4, 0.0, 0.0),
        ("cold", 0, True, 1, 4, 1.0, 0.0),
    ]
    got = {r["engine"]: r for r in benchmark_summary(spark.createDataFrame(rows, RUNS), "engine").collect()}
    e = got["e"]
    assert (e["runs"], e["prompt_tokens"], e["gen_tokens"], e["avg_total_s"]) == (2, 6, 20, 3.0)
    assert e["overall_tps"] == pytest.approx(20 / 3) and e["decode_tps"] == pytest.approx(7.6)
    assert got["one"]["decode_tps"] == got["one"]["overall_tps"] == 0.5
    assert got["slow"]["decode_tps"] == 2.0
    assert got["zero"]["overall_tps"] == 0.0 and "cold" not in got


def test_mark_warmup(spark):
    df = spark.range(20).selectExpr("IF(id < 15, 'hot', 'x') AS engine", "id AS run_index")
    marked = mark_warmup(df, warmup=2).filter("is_warmup")
    assert sorted((r["engine"], r["run_index"]) for r in marked.collect()) == [("hot", 0), ("hot", 1), ("x", 15), ("x", 16)]
    assert mark_warmup(df, warmup=0).filter("is_warmup").count() == 0


def test_request_timing(spark):
    rows = [("r", 0, ""), ("r", 250, "a"), ("r", 900, "b"), ("s", 100, "")]
    df = spark.createDataFrame(rows, "request_id string, ms int, delta string").selectExpr(
        "request_id", "delta", "timestamp '2024-01-01 00:00:00' AS started", "timestamp_millis(1704067200000 + ms) AS ts"
    )
    got = {r["request_id"]: r for r in request_timing(df).collect()}
    assert (got["r"]["total_s"], got["r"]["ttft_s"], got["r"]["gen_tokens"]) == (0.9, 0.25, 2)
    assert got["s"]["ttft_s"] is None and got["s"]["gen_tokens"] == 0


def test_checkpoints(spark):
    rows = [("a", 10, 2.0), ("a", 20, 1.0), ("a", 30, 1.0), ("a", 40, None), ("b", 5, float("nan")), ("c", 1, 3.0)]
    df = spark.createDataFrame(rows, "run string, step bigint, eval_loss double")
    assert {r["run"]: r["step"] for r in ck.latest(df).collect()} == {"a": 40, "b": 5, "c": 1}
    assert sorted(r["step"] for r in ck.retained(df, 2).filter("run = 'a'").collect()) == [30, 40]
    assert {r["run"]: r["step"] for r in ck.best(df).collect()} == {"a": 20, "c": 1}
    assert {r["run"]: r["step"] for r in ck.best(df, greater_is_better=True).collect()} == {"a": 10, "c": 1}
    assert ck.best(df, has_eval=False).count() == 0
    assert ck.latest(df.filter(F.lit(False))).count() == 0


def test_training_tokens_are_not_written_and_pairs_are_not_copied(spark, monkeypatch, tmp_path):
    from turnmill.operators import perplexity as module
    from turnmill.queries import evaluation

    texts = [(i, "en", f"a b{i} c", "s", 3) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    written, keep = [], evaluation.materialize
    monkeypatch.setattr(evaluation, "materialize", lambda df, name: written.append(df.count()) or keep(df, name))
    train, held = evaluation._held_out(spark, str(tmp_path))
    assert written == [2] and held.count() == 2 and train.count() == 38
    counted = module._pair_counts(train, F.col("tokens"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan and "slice" not in plan
    got = {(r["prev"], r["next"]): r["times"] for r in counted.collect()}
    assert got[("c", None)] == 38 and len(got) == 2 * 38 + 1
    few = spark.createDataFrame([([],), (None,), (["x"],), (["x", None, "y"],)], "t array<string>")
    assert {(r["prev"], r["next"]): r["times"] for r in module._pair_counts(few, F.col("t")).collect()} == {("x", None): 2, ("y", None): 1}
