import collections
import glob
import os
import re

import duckdb
import pytest
from conftest import SF_DIR
from llm_cases import ROWS, documents, with_clashes
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from turnmill.llm.queries import ORACLES, QUERIES, vocabulary


def test_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len(cp.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r[n] for n in names) for r in df.collect()) == collections.Counter(cursor.fetchall())


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows(spark, place):
    stage = cp.STAGES[place][1]
    docs = documents(spark)
    got = stage(spark, docs, SF_DIR)
    assert got.columns[: len(docs.columns)] == docs.columns
    if place < 4:
        assert got.dtypes == docs.dtypes
    rows = got.collect()
    clash = with_clashes(docs)
    made = {"ids", "n_tokens", "round_trip"} if place == 4 else set()
    again = stage(spark, clash, SF_DIR)
    assert set(again.columns) - made == set(clash.columns) - made and again.count() == len(rows)
    assert stage(spark, docs.limit(0), SF_DIR).collect() == []


def test_language_stage_keeps_short_texts(spark):
    kept = cp.identify_language(spark, documents(spark), SF_DIR).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in ROWS if any(c.isalpha() for c in r[1] or ""))


def test_language_stage_has_one_rule_for_every_length(spark):
    """Letters of no learned language go, from some ten on; short texts of a language stay."""
    words = "the quick brown fox jumps over a lazy dog and runs away from it".split()
    english = [(i, " ".join(words[i % 5 : i % 5 + 3 + i % 9]), "en", "s", None) for i in range(60)]
    other = [(100 + n, "漢字仮名交文" * n, None, "s", None) for n in (2, 10, 30, 300)]
    kept = {r.doc_id for r in cp.identify_language(spark, documents(spark, english + other), SF_DIR).collect()}
    assert kept == {r[0] for r in english}


def test_line_stage_follows_the_text(spark):
    rows = cp.remove_repeated_lines(spark, documents(spark), SF_DIR).collect()
    assert all(r.n_chars == len(r.text) for r in rows if r.text and r.doc_id not in (1, 2, 10, 11, 12, None))
    # The chunks of 1 stay, what both rows of 2 repeat of them is cut; the lines of 11 differ.
    assert sorted(r.doc_id for r in rows if "quick brown fox\njumps" in (r.text or "")) == [1, 11]


def test_near_copies_leave_one(spark):
    rows = cp.drop_near_copies(spark, documents(spark), SF_DIR).collect()
    assert collections.Counter(r.doc_id for r in rows)[1] == 1 and not {2, 9, 11} & {r.doc_id for r in rows}


def test_mixture_takes_as_many_words_as_there_are(spark):
    rows = cp.mix_sources(spark, documents(spark), SF_DIR).collect()
    words = sum(len((r.text or "").split()) for r in rows)
    assert words >= sum(len((r[1] or "").split()) for r in ROWS)
    assert max(collections.Counter((r.doc_id, r.text) for r in rows).values()) <= 2 * 2


def test_run(spark):
    library = Tokenizer.from_file(vocabulary())
    rows = cp.run(spark, SF_DIR).collect()
    assert len(rows) > 100 and all(r.round_trip for r in rows)
    for r in rows[:20]:
        assert r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids) == len(r.ids) // 4
