"""The shape of the physical plans, which is what decides how jobs scale."""

import re

import pytest
from conftest import SF_DIR, optimized, plan_of

from turnmill.operators import checkpoints as ck
from turnmill.operators.formats import normalize
from turnmill.operators.timing import mark_warmup
from turnmill.plans.prepare import head_sample
from turnmill.queries import QUERIES
from turnmill.queries import adapters as a

CORPUS = [n for n in QUERIES if n.startswith(("normalize", "render", "detect", "format", "prepared", "dataset"))]
# Files are opened and cut into lines by Arrow tasks; all after that stays in the JVM.
FROM_FILES = {"prepared_rejects"}


@pytest.mark.parametrize("name", CORPUS)
def test_corpus_plans_stay_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    if name in FROM_FILES:
        # One reader in each branch of the plan, right above the table of ranges.
        plan, readers = re.subn(r"MapInArrow run\(.*", "", plan)
        assert readers == 2
    assert not re.search(r"Python|ArrowEval|MapInArrow|CartesianProduct|NestedLoop", plan)


def test_records_are_parsed_once(spark):
    unified = normalize(a.parsed(a.mixed_records(spark, SF_DIR)), on_error="skip")
    plan = optimized(unified.filter("text <> ''").select("conv_id", "text"))
    assert len(re.findall(r"from_json|JsonToStructs", plan, re.I)) == 1


def test_normalising_does_not_shuffle(spark):
    records = a.parsed(a.table(spark, SF_DIR, "documents").selectExpr("doc_id", "text AS raw"))
    assert "Exchange" not in plan_of(normalize(records, on_error="skip"))


@pytest.mark.parametrize("name", ["split_exact", "prepared_dataset", "length_groups", "batch_plan", "pack_blocks", "line_ordinals", "windowed_latency"])
def test_no_full_table_in_one_task(spark, name):
    """Single-partition exchanges only follow an aggregate (a bounded table)."""
    plan = plan_of(QUERIES[name](spark, SF_DIR)).splitlines()
    for number, line in enumerate(plan):
        if "Exchange SinglePartition" in line:
            below = " ".join(plan[number + 1 : number + 4])
            assert "HashAggregate" in below or "Window" in below, below


@pytest.mark.parametrize("name", ["bigram_perplexity", "bigram_losses", "eval_report", "token_counts", "truncate_tokens"])
def test_texts_are_not_dealt_round_robin(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "RoundRobin" not in plan
    assert len(re.findall(r"FileScan.*documents\.parquet", plan)) <= 3


def test_split_does_not_shuffle_the_rows(spark):
    main = plan_of(QUERIES["split_exact"](spark, SF_DIR))
    assert "Subquery" in main and "BroadcastNestedLoopJoin" not in main


def test_head_sample_is_a_top_k(spark):
    rows = spark.range(100).selectExpr("'a/b' AS file", "id AS ordinal", "'x' AS text")
    assert "TakeOrderedAndProject" in plan_of(head_sample(rows, 5))


def test_missing_shards_is_an_anti_join(spark):
    assert "LeftAnti" in plan_of(QUERIES["missing_shards"](spark, SF_DIR))


def test_rank_filters_run_before_the_exchange(spark):
    orders = a.table(spark, SF_DIR, "orders").selectExpr("o_custkey AS run", "o_orderkey AS step", "o_totalprice AS eval_loss")
    runs = a.table(spark, SF_DIR, "events").selectExpr("event_type AS engine", "event_id AS run_index")
    assert re.search(r"WindowGroupLimit .*Partial", plan_of(ck.retained(orders)))
    assert "BroadcastHashJoin" in plan_of(mark_warmup(runs)) and "SortMergeJoin" not in plan_of(mark_warmup(runs))


@pytest.mark.parametrize("name", ["latest_checkpoint", "best_checkpoint", "benchmark_summary", "perplexity_by_lang", "usable_conversations", "windowed_latency"])
def test_groups_are_aggregated_before_the_shuffle(spark, name):
    assert "partial_" in plan_of(QUERIES[name](spark, SF_DIR))


def test_scans_read_only_what_they_need(spark):
    assert re.search(r"ReadSchema: struct<conv_id:bigint,role:string,text:string>", plan_of(QUERIES["usable_conversations"](spark, SF_DIR)))
    assert "ReadSchema: struct<doc_id:bigint>" in plan_of(QUERIES["batch_plan"](spark, SF_DIR))
