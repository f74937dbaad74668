"""Registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import QueryAggregates as A
from .api import Workbook
from .errors import TooManyGroups
from .functions.kinds import CELL, Value, typed
from .operators.profile import profile, used_range
from .plans.ast import QuerySpec
from .sources.sheet import Sheet, table_sheet

Query = Callable[[SparkSession, str], DataFrame]
#: The last row of a sheet, which a table has no end at.
END = 1_048_576
WIDTHS = {"region": "B", "nation": "C", "customer": "E", "supplier": "D", "part": "F", "orders": "F", "lineitem": "K", "events": "F"}

#: Query text with {table} for the table's whole area, and its SQL.
TEXTS: dict[str, tuple[str, str]] = {
    "project_star": ("FROM {nation} SELECT *", "SELECT CAST(n_nationkey AS DOUBLE) n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) n_regionkey FROM nation"),
    "project_cols": ("FROM {supplier} SELECT s_name, s_acctbal", "SELECT s_name, s_acctbal FROM supplier"),
    "project_computed": ("FROM {lineitem} SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net", "SELECT CAST(l_orderkey AS DOUBLE) l_orderkey, CAST(l_linenumber AS DOUBLE) l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "filter_text_eq": ('FROM {customer} SELECT c_custkey, c_name WHERE c_mktsegment = "BUILDING"', "SELECT CAST(c_custkey AS DOUBLE) c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_text_ne": ('FROM {customer} SELECT c_custkey WHERE c_mktsegment != "BUILDING"', "SELECT CAST(c_custkey AS DOUBLE) c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "filter_num_range": ("FROM {orders} SELECT o_orderkey WHERE o_totalprice >= 1000 AND o_totalprice < 50000.5", "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000.5"),
    "filter_date_ge": ("FROM {orders} SELECT o_orderkey, o_orderdate WHERE o_orderdate >= DATE '1995-06-01' OR o_totalprice < 0", "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'"),
    "filter_kind_mismatch": ('FROM {lineitem} SELECT l_orderkey WHERE l_quantity != "1"', "SELECT CAST(l_orderkey AS DOUBLE) l_orderkey FROM lineitem WHERE false"),
    "filter_and_or_not": ("FROM {orders} SELECT o_orderkey WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_orderpriority != '1-URGENT'", "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_orderpriority <> '1-URGENT'"),
    "filter_in": ("FROM {orders} SELECT o_orderkey WHERE o_orderstatus IN ('O', 'P')", "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')"),
    "filter_not_in": ("FROM {events} SELECT event_id WHERE event_type NOT IN ('click', 'view')", "SELECT CAST(event_id AS DOUBLE) event_id FROM events WHERE event_type NOT IN ('click', 'view')"),
    "filter_in_null": ("FROM {events} SELECT event_id WHERE event_type NOT IN ('click', NULL)", "SELECT CAST(event_id AS DOUBLE) event_id FROM events WHERE event_type NOT IN ('click', NULL)"),
    "filter_is_empty": ("FROM {lineitem} SELECT COUNT() AS n, COUNT() FILTER (WHERE l_tax IS EMPTY) AS e", "SELECT CAST(count(*) AS DOUBLE) n, CAST(count(*) FILTER (WHERE l_tax IS NULL) AS DOUBLE) e FROM lineitem"),
    "filter_col_vs_col": ("FROM {lineitem} SELECT l_orderkey, l_linenumber WHERE l_discount + 0.01 > l_tax * 2", "SELECT CAST(l_orderkey AS DOUBLE) l_orderkey, CAST(l_linenumber AS DOUBLE) l_linenumber FROM lineitem WHERE l_discount + 0.01::DOUBLE > l_tax * 2"),
    "agg_global": ("FROM {lineitem} SELECT COUNT() AS n, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_discount), 6) AS a, MIN(l_tax) AS lo, MAX(l_tax) AS hi", "SELECT CAST(count(*) AS DOUBLE) n, round(sum(l_quantity), 2) s, round(avg(l_discount), 6) a, min(l_tax) lo, max(l_tax) hi FROM lineitem"),
    "agg_global_empty": ("FROM {lineitem} SELECT COUNT() AS n, SUM(l_quantity) AS s, MIN(l_tax) AS lo WHERE l_quantity < 0 OR FALSE", "SELECT CAST(count(*) AS DOUBLE) n, sum(l_quantity) s, min(l_tax) lo FROM lineitem WHERE l_quantity < 0"),
    "agg_min_max_date": ("FROM {orders} SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi", "SELECT min(o_orderdate) lo, max(o_orderdate) hi FROM orders"),
    "group_single": ("FROM {lineitem} SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS s, COUNT() AS n WHERE l_discount > 0.05 GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity), 2) s, CAST(count(*) AS DOUBLE) n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1"),
    "group_multi": ("FROM {lineitem} SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice * (1 - l_discount)), 1) AS revenue, ROUND(AVG(l_quantity), 4) AS q GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 1) revenue, round(avg(l_quantity), 4) q FROM lineitem GROUP BY 1, 2"),
    "group_expr": ("FROM {orders} SELECT YEAR(o_orderdate) AS y, COUNT() AS n GROUP BY YEAR(o_orderdate)", "SELECT CAST(year(o_orderdate) AS DOUBLE) y, CAST(count(*) AS DOUBLE) n FROM orders GROUP BY 1"),
    "group_keys_only": ("FROM {orders} SELECT o_orderstatus, o_orderpriority GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "group_constant": ("FROM {nation} SELECT COUNT() AS n GROUP BY TRUE", "SELECT true AS \"TRUE\", CAST(count(*) AS DOUBLE) n FROM nation"),
    "agg_filter_clause": ("FROM {lineitem} SELECT l_returnflag, ROUND(SUM(l_quantity) FILTER (WHERE l_tax > 0.04), 2) AS hi, COUNT() FILTER (WHERE l_tax <= 0.04) AS lo GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_tax > 0.04), 2) hi, CAST(count(*) FILTER (WHERE l_tax <= 0.04) AS DOUBLE) lo FROM lineitem GROUP BY 1"),
    "agg_expr_arg": ("FROM {lineitem} SELECT ROUND(SUM(l_extendedprice * l_discount), 1) AS d WHERE l_quantity < 24 AND l_discount >= 0.05", "SELECT round(sum(l_extendedprice * l_discount), 1) d FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05"),
    "agg_post_expr": ("FROM {lineitem} SELECT l_linestatus, ROUND(SUM(l_tax) / COUNT() * 100, 4) AS pct GROUP BY l_linestatus", "SELECT l_linestatus, round(sum(l_tax) / count(*) * 100, 4) pct FROM lineitem GROUP BY 1"),
    "agg_implicit_keys": ("FROM {orders} SELECT COUNT() AS n, ROUND(MAX(o_totalprice), 2) AS top GROUP BY o_orderstatus, MONTH(o_orderdate)", "SELECT o_orderstatus, CAST(month(o_orderdate) AS DOUBLE) AS \"MONTH(o_orderdate)\", CAST(count(*) AS DOUBLE) n, round(max(o_totalprice), 2) top FROM orders GROUP BY 1, 2"),
    "having_alias": ("FROM {orders} SELECT o_custkey, COUNT() AS n GROUP BY o_custkey HAVING n >= 12", "SELECT CAST(o_custkey AS DOUBLE) o_custkey, CAST(count(*) AS DOUBLE) n FROM orders GROUP BY 1 HAVING count(*) >= 12"),
    "having_hidden_agg": ("FROM {orders} SELECT o_orderpriority, COUNT() AS n GROUP BY o_orderpriority HAVING MAX(o_totalprice) > 400000 AND MIN(o_totalprice) < 2000", "SELECT o_orderpriority, CAST(count(*) AS DOUBLE) n FROM orders GROUP BY 1 HAVING max(o_totalprice) > 400000 AND min(o_totalprice) < 2000"),
    "topn_rows_desc": ("FROM {orders} SELECT o_orderkey, o_totalprice ORDER BY o_totalprice DESC LIMIT 25", "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "topn_hidden_key": ("FROM {lineitem} SELECT l_orderkey, l_linenumber ORDER BY l_extendedprice * (1 - l_discount) LIMIT 10", "SELECT CAST(l_orderkey AS DOUBLE) l_orderkey, CAST(l_linenumber AS DOUBLE) l_linenumber FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) LIMIT 10"),
    "topn_groups": ("FROM {orders} SELECT o_custkey, ROUND(SUM(o_totalprice), 1) AS total GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC LIMIT 20", "SELECT CAST(o_custkey AS DOUBLE) o_custkey, round(sum(o_totalprice), 1) total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC LIMIT 20"),
    "order_group_expr": ("FROM {orders} SELECT o_orderpriority, COUNT() AS n GROUP BY o_orderpriority ORDER BY -n", "SELECT o_orderpriority, CAST(count(*) AS DOUBLE) n FROM orders GROUP BY 1"),
    "limit_zero": ("FROM {nation} SELECT n_name LIMIT 0", "SELECT n_name FROM nation WHERE false"),
    "limit_rows": ("FROM {nation} SELECT n_name LIMIT 7", "SELECT n_name FROM nation WHERE n_nationkey < 7"),
    "arith_div_zero": ("FROM {lineitem} SELECT l_orderkey, l_linenumber, l_quantity / (l_discount - l_discount) AS z, 1 / l_quantity AS r", "SELECT CAST(l_orderkey AS DOUBLE) l_orderkey, CAST(l_linenumber AS DOUBLE) l_linenumber, CAST(NULL AS DOUBLE) z, 1 / l_quantity r FROM lineitem"),
    "arith_mod": ("FROM {supplier} SELECT s_suppkey, s_suppkey % 7 AS m, ABS(-s_suppkey % 7) AS k, s_suppkey % 0 AS z", "SELECT CAST(s_suppkey AS DOUBLE) s_suppkey, CAST(s_suppkey % 7 AS DOUBLE) m, CAST(abs(-s_suppkey % 7) AS DOUBLE) k, CAST(NULL AS DOUBLE) z FROM supplier"),
    "round_digits": ("FROM {lineitem} SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice / 7, 2) AS a, ROUND(l_extendedprice / -3) AS b", "SELECT CAST(l_orderkey AS DOUBLE) l_orderkey, CAST(l_linenumber AS DOUBLE) l_linenumber, round(l_extendedprice / 7, 2) a, round(l_extendedprice / -3) b FROM lineitem"),
    "abs_neg": ("FROM {supplier} SELECT s_suppkey, ABS(s_acctbal) AS a, -s_acctbal AS b", "SELECT CAST(s_suppkey AS DOUBLE) s_suppkey, abs(s_acctbal) a, -s_acctbal b FROM supplier"),
    "coalesce": ("FROM {lineitem} SELECT l_orderkey, l_linenumber, COALESCE(l_quantity / (l_discount * 0), l_tax, 1) AS c", "SELECT CAST(l_orderkey AS DOUBLE) l_orderkey, CAST(l_linenumber AS DOUBLE) l_linenumber, l_tax c FROM lineitem"),
    "date_parts": ("FROM {orders} SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d", "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey, CAST(year(o_orderdate) AS DOUBLE) y, CAST(month(o_orderdate) AS DOUBLE) m, CAST(day(o_orderdate) AS DOUBLE) d FROM orders"),
    "date_trunc_month": ("FROM {events} SELECT DATE_TRUNC('day', ts) AS d, COUNT() AS n GROUP BY DATE_TRUNC('day', ts)", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) d, CAST(count(*) AS DOUBLE) n FROM events GROUP BY 1"),
    "boolean_value": ("FROM {part} SELECT p_partkey, p_size > 25 AS large, NOT p_size > 25 AS small", "SELECT CAST(p_partkey AS DOUBLE) p_partkey, p_size > 25 large, NOT p_size > 25 small FROM part"),
}


def area(table: str) -> str:
    return f"{table}!A1:{WIDTHS[table]}{END} HEADER ROW 1"


def run_text(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """All groups, as in SQL: they stay distributed, so the limit of gathered results has no place here."""
    spec = QuerySpec.parse(query.format(**{t: area(t) for t in WIDTHS})).with_group_limit(None)
    return Workbook.of_tables(spark, sf_dir, spec.sheet).execute_query(spec, ordered=False).named()


def project_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column twice: legal in results; Spark needs names that differ to compare them."""
    result = Workbook.of_tables(spark, sf_dir, "nation").execute_query(f"FROM {area('nation')} SELECT n_name, n_regionkey, n_name", ordered=False)
    return result.df.select(*(F.col(f"c{i}").alias(f"{n}_{i}") for i, n in enumerate(result.columns, 1)))


def stats_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles decide that nothing can match; the empty result then has no columns, so a fixed one is shown."""
    book = Workbook.of_tables(spark, sf_dir, "lineitem")
    query = book.query_range("lineitem", f"A1:K{END}", 1).where("l_quantity", ">", 1e6).with_stats(profile(book.sheet("lineitem")))
    result = query.select(A.count()).execute()
    return spark.range(1).select(F.lit(len(result.columns)).cast("long").alias("columns"), F.lit(len(result.rows())).cast("long").alias("rows"))


def fluent_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Workbook.of_tables(spark, sf_dir, "orders").query_range("orders", f"A1:F{END}", 1).with_group_limit(None)
    result = query.where("o_totalprice", ">", 1000.0).group_by("o_orderstatus").select(A.count(), A.max("o_totalprice")).order_by(A.max("o_totalprice"), True).take(2).execute()
    return result.named().withColumnsRenamed({"Count()": "n", "Max(o_totalprice)": "top"})


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.of_tables(spark, sf_dir, "events").query_range("events", f"A1:F{END}", 1).with_group_limit(None).distinct_values("event_type")


def distinct_values_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Workbook.of_tables(spark, sf_dir, "part").query_range("part", f"A1:F{END}", 1).with_group_limit(None)
    return query.where("p_retailprice", "<", 1500.0).distinct_values("p_size", 10)


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook.of_tables(spark, sf_dir, "part")
    return profile(book.sheet("part")).select("column_index", "inferred_header", "dominant_type", "non_empty_count", "text_count", "number_count", "distinct_estimate", "min_numeric", "max_numeric", F.coalesce("max_text_length", F.lit(0)).alias("max_text_length"))


def profile_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook.of_tables(spark, sf_dir, "customer")
    return profile(book.sheet("customer")).where("distinct_values is not null").select("inferred_header", F.array_join("distinct_values", "|").alias("listed"))


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return used_range(Workbook.of_tables(spark, sf_dir, "nation").sheet("nation"))


def mixed_sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    """events with a column of cells: text where event_id % 10 = 0, a date where it is 1, empty where 2, else a number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rest = F.col("event_id") % 10
    parts = [typed(F.col("value"), events.schema["value"].dataType), Value("text", F.col("event_type")), Value("date", F.col("ts")), Value("empty", F.lit(None))]
    number, text, date, empty = (v.cell for v in parts)
    mixed = F.when(rest == 0, text).when(rest == 1, date).when(rest == 2, empty).otherwise(number).cast(CELL)
    return table_sheet("mixed", events.select("event_id", mixed.alias("v"), "event_type"), F.col("event_id"))


def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells in their order, numbers, dates, text and empty ones: each kind's first and last place and its number of rows."""
    sheet = mixed_sheet(spark, sf_dir)
    n = sheet.df.count()
    result = Workbook(spark, [sheet]).execute_query(f"SELECT event_id, v FROM mixed!A1:C{END} HEADER ROW 1 ORDER BY v DESC LIMIT {n}")
    placed = result.df.select(F.col("c2")["kind"].cast("int").alias("kind"), (F.monotonically_increasing_id()).alias("place"))
    return placed.groupBy("kind").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))


def group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query has more groups than the default cap allows, and with a cap of its own."""
    book = Workbook.of_tables(spark, sf_dir, "lineitem")
    found = []
    for most in (None, 7):
        query = book.query_range("lineitem", f"A1:K{END}", 1).group_by("l_quantity").select(A.count())
        try:
            query = query if most is None else query.with_group_limit(most)
            found.append((most or 0, len(query.execute(ordered=False).rows())))
        except TooManyGroups:
            found.append((most, -1))
    return spark.createDataFrame(found, "cap long, groups long")


def mixed_first_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIN and MAX keep to the kind of a group's first number or date; COALESCE takes the first cell that isn't empty."""
    book = Workbook(spark, [mixed_sheet(spark, sf_dir)])
    result = book.execute_query(QuerySpec.parse(f"SELECT event_type, MIN(v) AS low, MAX(v) AS high, COUNT() FILTER (WHERE COALESCE(v, event_id) = event_id) AS filled FROM mixed!A1:C{END} HEADER ROW 1 GROUP BY event_type").with_group_limit(None), ordered=False)
    shown = result.named()
    return shown.select("event_type", F.col("low")["kind"].cast("int").alias("kind"), F.coalesce(F.col("low")["num"], F.unix_micros(F.col("low")["ts"].cast("timestamp")).cast("double")).alias("low"), F.coalesce(F.col("high")["num"], F.unix_micros(F.col("high")["ts"].cast("timestamp")).cast("double")).alias("high"), "filled")


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet rows that a result's rows come from."""
    result = Workbook.of_tables(spark, sf_dir, "nation").execute_query(f"FROM {area('nation')} SELECT n_name WHERE n_regionkey = 1", ordered=False)
    return result.df.select(F.col("_row_index").alias("row"), F.col("c1").alias("n_name"))


def mixed_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook(spark, [mixed_sheet(spark, sf_dir)])
    return book.execute_query(QuerySpec.parse(f"SELECT event_type, ROUND(SUM(v), 2) AS s, COUNT() FILTER (WHERE v IS EMPTY) AS e, COUNT() FILTER (WHERE v > 50) AS big FROM mixed!A1:C{END} HEADER ROW 1 GROUP BY event_type").with_group_limit(None), ordered=False).named()


def dirty_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook(spark, [mixed_sheet(spark, sf_dir)])
    found = book.execute_query(f"FROM mixed!A1:C{END} HEADER ROW 1 SELECT SUM(v), AVG(v)").diagnostics()
    return found.select("column", "skipped_count", F.array_join(F.transform("sample_row_indices", lambda x: x.cast("string")), ",").alias("samples"))


def range_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.of_tables(spark, sf_dir, "nation").execute_query("FROM nation!A1:B11 HEADER ROW 1 SELECT *").named()


def external_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.of_tables(spark, sf_dir, "nation").execute_query("FROM nation!B6:C9 HEADER ROW 1 SELECT n_name, n_regionkey").named()


def row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.of_tables(spark, sf_dir, "orders").execute_query(f"FROM {area('orders')} SELECT COUNT() WHERE o_totalprice > 250000").stats()


def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row is text over the numbers and names below it."""
    found = Workbook.of_tables(spark, sf_dir, "region").read_range("region", "A1:B9")
    return found.select(F.col("_row_index").alias("row"), F.col("c1")["text"].alias("head"), F.col("c1")["num"].alias("key"), F.col("c2")["text"].alias("name"))


FUNCTIONS: dict[str, tuple[Query, str | None]] = {
    "project_dup": (project_dup, "SELECT n_name n_name_1, CAST(n_regionkey AS DOUBLE) n_regionkey_2, n_name n_name_3 FROM nation"),
    "stats_prune": (stats_prune, "SELECT CAST(0 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS rows"),
    "fluent_group": (fluent_group, "SELECT o_orderstatus, CAST(count(*) AS DOUBLE) n, max(o_totalprice) top FROM orders WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY top DESC LIMIT 2"),
    "distinct_values": (distinct_values, "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1"),
    "distinct_values_filtered": (distinct_values_filtered, "SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS count FROM part WHERE p_retailprice < 1500 GROUP BY 1 ORDER BY count DESC, value LIMIT 10"),
    "profile_columns": (profile_columns, " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) column_index, '{c}' inferred_header, '{k}' dominant_type, count({c}) non_empty_count, {f'count({c})' if k == 'Text' else 'CAST(0 AS BIGINT)'} text_count, {f'count({c})' if k == 'Number' else 'CAST(0 AS BIGINT)'} number_count, count(DISTINCT {c}) distinct_estimate, {f'CAST(min({c}) AS DOUBLE)' if k == 'Number' else 'CAST(NULL AS DOUBLE)'} min_numeric, {f'CAST(max({c}) AS DOUBLE)' if k == 'Number' else 'CAST(NULL AS DOUBLE)'} max_numeric, {f'CAST(max(length({c})) AS INTEGER)' if k == 'Text' else 'CAST(0 AS INTEGER)'} max_text_length FROM part" for i, (c, k) in enumerate((("p_partkey", "Number"), ("p_name", "Text"), ("p_brand", "Text"), ("p_type", "Text"), ("p_size", "Number"), ("p_retailprice", "Number")), 1))),
    "profile_distinct_values": (profile_distinct_values, "SELECT 'c_mktsegment' inferred_header, string_agg(v, '|' ORDER BY v) listed FROM (SELECT DISTINCT c_mktsegment v FROM customer) UNION ALL SELECT 'c_nationkey', string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT c_nationkey v FROM customer)"),
    "used_range": (used, "SELECT CAST(1 AS BIGINT) first_row, CAST(count(*) + 1 AS BIGINT) last_row, CAST(1 AS INTEGER) first_column, CAST(3 AS INTEGER) last_column, CAST(count(n_nationkey) + count(n_name) + count(n_regionkey) + 3 AS BIGINT) cell_count, CAST(count(*) + 1 AS BIGINT) row_count, CAST(3 AS INTEGER) column_count FROM nation"),
    "mixed_order": (mixed_order, "WITH k AS (SELECT CASE event_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 2 END AS kind FROM events), c AS (SELECT kind, count(*) n FROM k GROUP BY kind), s AS (SELECT kind, n, CAST(sum(n) OVER (ORDER BY CASE kind WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS BIGINT) e FROM c) SELECT CAST(kind AS INTEGER) AS kind, e - n AS first, e - 1 AS last, n FROM s"),
    "group_cap": (group_cap, "SELECT CAST(0 AS BIGINT) AS cap, CASE WHEN count(DISTINCT l_quantity) > 10000 THEN -1 ELSE count(DISTINCT l_quantity) END AS groups FROM lineitem UNION ALL SELECT 7, CASE WHEN count(DISTINCT l_quantity) > 7 THEN -1 ELSE count(DISTINCT l_quantity) END FROM lineitem"),
    "mixed_first_kind": (mixed_first_kind, "WITH e AS (SELECT event_type, event_id, CASE WHEN event_id % 10 = 1 THEN 3 WHEN event_id % 10 > 2 THEN 2 END k, value, epoch_us(CAST(ts AS TIMESTAMP)) t FROM events), f AS (SELECT event_type, arg_min(k, event_id) FILTER (WHERE k IS NOT NULL) kind FROM e GROUP BY 1) SELECT e.event_type, CAST(kind AS INTEGER) AS kind, CASE kind WHEN 2 THEN min(value) FILTER (WHERE k = 2) ELSE CAST(min(t) FILTER (WHERE k = 3) AS DOUBLE) END low, CASE kind WHEN 2 THEN max(value) FILTER (WHERE k = 2) ELSE CAST(max(t) FILTER (WHERE k = 3) AS DOUBLE) END high, CAST(count(*) FILTER (WHERE event_id % 10 = 2 OR event_id % 10 > 2 AND value = event_id) AS DOUBLE) filled FROM e JOIN f USING (event_type) GROUP BY e.event_type, kind"),
    "row_numbers": (row_numbers, "SELECT r + 1 AS \"row\", n_name FROM (SELECT row_number() OVER () r, n_name, n_regionkey FROM nation) WHERE n_regionkey = 1"),
    "mixed_aggregates": (mixed_aggregates, "SELECT event_type, round(sum(value) FILTER (WHERE event_id % 10 > 2), 2) s, CAST(count(*) FILTER (WHERE event_id % 10 = 2) AS DOUBLE) e, CAST(count(*) FILTER (WHERE event_id % 10 > 2 AND value > 50) AS DOUBLE) big FROM events GROUP BY 1"),
    "dirty_diagnostics": (dirty_diagnostics, "SELECT 'v' AS \"column\", count(*) skipped_count, (SELECT string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FROM (SELECT event_id + 2 r FROM events WHERE event_id % 10 < 2 ORDER BY 1 LIMIT 5)) samples FROM events WHERE event_id % 10 < 2"),
    "range_window": (range_window, "SELECT CAST(n_nationkey AS DOUBLE) n_nationkey, n_name FROM nation WHERE n_nationkey < 10"),
    "external_header": (external_header, "SELECT n_name, CAST(n_regionkey AS DOUBLE) n_regionkey FROM nation WHERE n_nationkey BETWEEN 4 AND 7"),
    "row_stats": (row_stats, "SELECT count(*) rows_scanned, count(*) FILTER (WHERE o_totalprice > 250000) rows_matched FROM orders"),
    "read_range": (read_range, "SELECT CAST(i AS BIGINT) AS \"row\", CASE WHEN i = 1 THEN 'r_regionkey' END AS head, CAST(r_regionkey AS DOUBLE) AS key, CASE WHEN i = 1 THEN 'r_name' ELSE r_name END AS name FROM range(1, 10) t(i) LEFT JOIN region ON r_regionkey = i - 2"),
}

QUERIES: dict[str, Query] = {n: (lambda spark, sf_dir, q=q: run_text(spark, sf_dir, q)) for n, (q, _) in TEXTS.items()} | {n: f for n, (f, _) in FUNCTIONS.items()}
ORACLES: dict[str, str] = {n: sql for n, (_, sql) in TEXTS.items()} | {n: sql for n, (_, sql) in FUNCTIONS.items() if sql}
