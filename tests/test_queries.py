"""Every registered query against its SQL, both over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__  # registers all queries
from ostinato.plans.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}" if abs(value) > 1e-12 else "0"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if hasattr(value, "as_tuple"):
        return plain(float(value))
    return str(value) if not isinstance(value, int) else str(int(value))


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def near(a: str, b: str) -> bool:
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-8, abs_tol=1e-12)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = table_of(df.columns, df.collect()), table_of(columns, want.fetchall())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(near, g, w))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert os.path.exists(SF_DIR)


@pytest.mark.parametrize("name", ["bigram_counts", "asof_last_click", "overlap_weight", "boundary_f1", "lag_profile"])
def test_plans_have_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
