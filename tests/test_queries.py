"""Every registered query with SQL against DuckDB, on the smallest driver tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = contract.SMOKE
NAMES = [n for n in contract.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_like_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    found = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*sorted(df.columns)).collect()) == plain([[r[names.index(c)] for c in sorted(names)] for r in found.fetchall()])


def test_plans(spark, db):
    """Filters and columns reach the scan; top-n doesn't sort everything; grouping shuffles once before its check."""
    def physical(name):
        return contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()

    plan = physical("agg_expr_arg")
    assert "PushedFilters: [IsNotNull(l_" in plan and "LessThan(l_quantity,24.0)" in plan and "l_orderkey" not in plan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in physical("topn_rows_desc") and "Sort " not in physical("topn_rows_desc")
    grouped = contract.queries()["group_multi"](spark, FOLDER)
    grouped.collect()
    final = grouped._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") <= 1  # the group count reads the same shuffle


def test_entry(spark, db):
    assert contract.entry(spark).count() >= 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
