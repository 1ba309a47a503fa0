"""Every registered query against its SQL on the smallest tables."""

import collections
import glob
import os

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from turnmill.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "format", "text", "split"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    mine = collections.Counter(tuple(str(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    index = [names.index(c) for c in columns]
    theirs = collections.Counter(tuple(str(r[i]) for i in index) for r in cursor.fetchall())
    assert mine == theirs
    assert sum(mine.values()) > 0
