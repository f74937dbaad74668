"""Registered queries over more groups than gathered results may have by default."""

import pytest
from pyspark.sql import functions as F

from gridlark import queries

MANY = 10_500


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """orders with one row of each customer, and eleven more of every tenth one."""
    folder = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(MANY * 12).select(F.col("id").alias("o_orderkey"), (F.col("id") % MANY).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.col("id").cast("double").alias("o_totalprice"))
    rows = rows.where("o_orderkey < {0} or o_custkey % 10 = 0".format(MANY))
    rows.withColumns({"o_orderdate": F.lit("2024-01-02").cast("timestamp"), "o_orderpriority": F.lit("low")}).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_having(spark, folder):
    found = queries.QUERIES["having_alias"](spark, folder).collect()
    assert sorted((r.o_custkey, r.n) for r in found) == [(float(k), 12.0) for k in range(0, MANY, 10)]


def test_first_groups(spark, folder):
    found = queries.QUERIES["topn_groups"](spark, folder).collect()
    total = lambda k: float(sum(k + i * MANY for i in range(12)))
    assert [(r.o_custkey, r.total) for r in found] == [(float(k), total(k)) for k in range(MANY - 10, MANY - 210, -10)]


def test_values(spark, tmp_path):
    """A step that the text queries share with those that are built step by step."""
    spark.range(MANY).select(*(F.col("id").alias(c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    found = queries.QUERIES["distinct_values_filtered"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(v, 1) for v in sorted(map(str, range(MANY)))[:10]]
