"""Each registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from fabulagraph.plans import inventory
from fabulagraph.plans.queries import ORACLE_SQL, QUERIES

assert inventory

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def _rows(frame):
    cols = sorted(frame.columns)
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted(([cell(v) for v in r] for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = _rows(QUERIES[name](spark, DATA).toPandas()), _rows(duck.execute(ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def _values(rows, name):
    return [r[name] for r in rows]


#: What holds of the results of queries without SQL.
HOLDS = {
    "correlation_verdicts": lambda rows: len(rows) == 3 and all(-1 <= r.r <= 1 and 0 <= r.p <= 1 and r.verdict == ("NO EFFECT" if r.p >= 0.05 else "INCREASES" if r.r > 0 else "DECREASES") for r in rows),
    "bootstrap_ci": lambda rows: len(rows) == 5 and all(r.low <= r.high for r in rows),
    "story_graph": lambda rows: "error" not in _values(rows, "kind") and {"sentence", "activation", "final"} <= set(_values(rows, "kind")) and all(0 <= r.score <= 5 for r in rows if r.score is not None),
    "tagged_words": lambda rows: all(r.nouns == sorted(set(r.nouns)) and len(r.content) == len(set(r.content)) for r in rows) and any(r.nouns for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert HOLDS[name](QUERIES[name](spark, DATA).collect())
