"""The engine's registered queries, each with the same result in DuckDB's SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import aggregates, joins, udf, windows
from .session import TABLES, Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *names: str, dialect: str = "neutral") -> Engine:
    return Engine.over(spark, sf_dir, names, dialect)


def q(name: str, sql: str, duck: str | None = None, dialect: str = "neutral") -> None:
    """A query by the SQL front end; the tables that its text names become views."""
    tables = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, *tables, dialect=dialect).sql(sql)
    ORACLES[name] = duck or sql


def op(duck: str | None, *tables: str):
    """A query by operators: f(engine) -> DataFrame."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(engine(spark, sf_dir, *tables))
        if duck:
            ORACLES[f.__name__] = duck
        return f

    return wrap


# Scan, filter, project, order, limit.

PRICING = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
q("pricing_summary", PRICING.replace("TIMESTAMP '", "timestamp_ntz '"), PRICING)
q("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07")
q("predicate_null_forms", "SELECT o_orderkey, o_totalprice IS NULL AS a, (o_orderpriority <=> NULL) AS b, (o_totalprice > 1000) IS TRUE AS c, (o_custkey IS DISTINCT FROM 7) AS d, NOT (o_custkey IN (1, 2, NULL)) AS e FROM orders",
  "SELECT o_orderkey, o_totalprice IS NULL AS a, (o_orderpriority IS NOT DISTINCT FROM NULL) AS b, (o_totalprice > 1000) IS TRUE AS c, (o_custkey IS DISTINCT FROM 7) AS d, NOT (o_custkey IN (1, 2)) AS e FROM orders")
q("not_in_dialect", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 100000 THEN o_custkey END FROM orders)",
  "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000 AND o_custkey = c_custkey)")
q("row_value_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_totalprice > 300000) AND (l_quantity, l_linenumber) > (10, 0)")
q("boolean_algebra", "SELECT o_orderkey, (o_totalprice > 50000) XOR (o_orderstatus = 'F') AS x, (o_orderkey > 10 && o_custkey < 900) AS y FROM orders",
  "SELECT o_orderkey, (o_totalprice > 50000) <> (o_orderstatus = 'F') AS x, (o_orderkey > 10 AND o_custkey < 900) AS y FROM orders")
q("like_regexp", "SELECT p_partkey, p_name LIKE '%a%' AS l, p_type RLIKE '^[A-M]' AS r, regexp_replace(p_brand, '([A-Za-z]+)#?([0-9]+)', '\\\\2-\\\\1') AS s FROM part",
  r"SELECT p_partkey, p_name LIKE '%a%' AS l, regexp_matches(p_type, '^[A-M]') AS r, regexp_replace(p_brand, '([A-Za-z]+)#?([0-9]+)', '\2-\1', 'g') AS s FROM part")
q("case_simple_searched", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS a, CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS b, IF(o_custkey > 50, 'x', 'y') AS c FROM orders",
  "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS a, CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS b, CASE WHEN o_custkey > 50 THEN 'x' ELSE 'y' END AS c FROM orders")
q("distinct_alias_reuse", "SELECT DISTINCTROW o_orderstatus, o_custkey % 10 AS b, b + 1 AS c FROM orders", "SELECT DISTINCT o_orderstatus, o_custkey % 10 AS b, o_custkey % 10 + 1 AS c FROM orders")
q("casts_never_throw", "SELECT p_partkey, CAST(p_name AS INT) AS a, CONVERT('12', SIGNED) AS b, p_size::string AS c, 10 / 0 AS d, CAST('300' AS TINYINT) AS e FROM part",
  "SELECT p_partkey, TRY_CAST(p_name AS INT) AS a, 12::BIGINT AS b, p_size::VARCHAR AS c, NULL::DOUBLE AS d, NULL::TINYINT AS e FROM part")
q("topn_total_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
q("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10, 20", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 10")
q("fetch_first", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC FETCH FIRST 7 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7")
q("order_nulls_last", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS LAST, o_orderkey DESC LIMIT 40")
q("order_by_all", "SELECT n_regionkey, n_name FROM nation ORDER BY ALL LIMIT 12", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey NULLS FIRST, n_name NULLS FIRST LIMIT 12")
q("single_row", "SELECT 1 + 1 AS two, 'a' AS t")
q("values_rows", "SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")

# Joins.

q("inner_join_revenue", "SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
q("left_join_missing", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
q("right_join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) x RIGHT JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM nation WHERE n_nationkey > 5) y USING (k)")
q("full_join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) x FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM nation WHERE n_nationkey > 5) y USING (k)")
q("cross_join_regions", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
q("comma_join_keys", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
q("straight_join", "SELECT s_suppkey, n_name FROM supplier STRAIGHT_JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
q("natural_join_nation", "SELECT * FROM (SELECT n_nationkey, n_name FROM nation) x NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3) y")
q("nullsafe_join", "SELECT a.o_orderkey AS x, b.c_custkey AS y FROM (SELECT o_orderkey, nullif(o_custkey, 1) AS k FROM orders) a JOIN (SELECT c_custkey, nullif(c_custkey, 1) AS k FROM customer) b ON a.k <=> b.k",
  "SELECT a.o_orderkey AS x, b.c_custkey AS y FROM (SELECT o_orderkey, nullif(o_custkey, 1) AS k FROM orders) a JOIN (SELECT c_custkey, nullif(c_custkey, 1) AS k FROM customer) b ON a.k IS NOT DISTINCT FROM b.k")
q("theta_join_residual", "SELECT a.n_name AS a, b.n_name AS b FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND length(a.n_name) > length(b.n_name)")
q("full_theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a FULL JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey + 4 < b.n_nationkey")
q("mixed_type_keys", "SELECT o_orderkey, c_custkey FROM orders JOIN (SELECT CAST(c_custkey AS STRING) AS k, c_custkey FROM customer) ON CAST(k AS BIGINT) = o_custkey", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey")


@op("SELECT event_id, lo FROM events JOIN (SELECT CAST(range * 40 AS DOUBLE) AS lo, CAST(range * 40 + 25 AS DOUBLE) AS hi FROM range(25)) ON value BETWEEN lo AND hi", "events")
def range_join_between(e):
    ranges = e.spark.range(25).select((F.col("id") * 40.0).alias("lo"), (F.col("id") * 40.0 + 25).alias("hi"))
    return joins.between_bins(e.spark.table("events").select("event_id", "value"), ranges, "value", "lo", "hi", 25.0).select("event_id", "lo")


q("range_sweep_lt", "SELECT a.n_nationkey AS a, count(b.n_nationkey) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey GROUP BY a.n_nationkey")


@op("SELECT a.event_id, b.event_id AS last_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts", "events")
def asof_event_join(e):
    t = e.spark.table("events").select("event_id", "ts", "user_id", "event_type", "value")
    right = t.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max(F.struct("event_id", "value")).alias("x")).select("user_id", "ts", F.col("x.event_id").alias("last_id"), F.col("x.value").alias("last_value"))
    return joins.as_of(t.where("event_type = 'purchase'"), right, ["user_id"], "ts", "ts", ["last_id", "last_value"]).select("event_id", "last_id", "last_value")


@op("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def salted_join(e):
    left = e.spark.table("orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return joins.salted(left, e.spark.table("customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), "k").select("o_orderkey", "c_mktsegment")


# Subqueries.

q("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
q("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
q("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
q("scalar_subquery", "SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) > 0 AS above FROM orders")
q("correlated_scalar_max", "SELECT o_orderkey, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS top FROM orders")
q("correlated_range_exists", "SELECT a.n_nationkey FROM nation a WHERE EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey + 3)")
q("correlated_or_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")

# Aggregation.

q("global_aggregate", "SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_tax), 4) AS t FROM lineitem")
q("group_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) + 0 AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
q("with_rollup", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
q("group_cube", "SELECT n_regionkey, length(n_name) AS l, count(*) AS n FROM nation GROUP BY CUBE (n_regionkey, length(n_name))", "SELECT n_regionkey, CAST(length(n_name) AS INTEGER) AS l, count(*) AS n FROM nation GROUP BY CUBE (n_regionkey, CAST(length(n_name) AS INTEGER))")
q("grouping_sets_grouping", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
q("having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15")
q("group_ordinal_expression", "SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1")
q("agg_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_custkey < 500), 2) AS s FROM orders GROUP BY o_orderstatus")
q("agg_statistics", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(variance(l_quantity), 6) AS c, round(var_samp(l_quantity), 6) AS d FROM lineitem GROUP BY l_returnflag",
  "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(var_pop(l_quantity), 6) AS c, round(var_samp(l_quantity), 6) AS d FROM lineitem GROUP BY l_returnflag")
q("agg_covar_corr", "SELECT l_linestatus, round(covar_pop(l_quantity, l_discount), 4) AS a, round(covar_samp(l_quantity, l_discount), 4) AS b, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_linestatus")
q("agg_percentiles", "SELECT l_returnflag, percentile_cont(l_quantity, 0.3) AS a, median(l_extendedprice) AS b, percentile_disc(l_linenumber, 0.5) AS c FROM lineitem GROUP BY l_returnflag",
  "SELECT l_returnflag, quantile_cont(l_quantity, 0.3) AS a, median(l_extendedprice) AS b, quantile_disc(l_linenumber, 0.5) AS c FROM lineitem GROUP BY l_returnflag")
q("agg_bitwise_bool", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS b, bit_xor(n_nationkey) AS c, bool_and(n_nationkey > 3) AS d, boolor_agg(n_nationkey > 20) AS e, countif(n_nationkey % 2 = 0) AS f FROM nation GROUP BY n_regionkey",
  "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS b, bit_xor(n_nationkey) AS c, bool_and(n_nationkey > 3) AS d, bool_or(n_nationkey > 20) AS e, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS f FROM nation GROUP BY n_regionkey")
q("agg_distinct_exact", "SELECT l_returnflag, ndv(l_partkey) AS a, approx_count_distinct(l_suppkey) AS b, count(DISTINCT l_linenumber, l_linestatus) AS c, multi_distinct_sum(l_linenumber) AS d FROM lineitem GROUP BY l_returnflag",
  "SELECT l_returnflag, count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b, count(DISTINCT (l_linenumber, l_linestatus)) AS c, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS d FROM lineitem GROUP BY l_returnflag")
q("agg_minmax_by", "SELECT o_orderstatus, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS a, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS b FROM orders GROUP BY o_orderstatus",
  "SELECT o_orderstatus, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS a, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS b FROM orders GROUP BY o_orderstatus")
q("agg_group_concat_ordered", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
q("agg_array_map", "SELECT n_regionkey, array_join(sort_array(array_agg(n_nationkey)), ',') AS a, size(map_agg(n_name, n_nationkey)) AS m FROM nation GROUP BY n_regionkey",
  "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS a, CAST(count(DISTINCT n_name) AS INTEGER) AS m FROM nation GROUP BY n_regionkey")
q("agg_bitmap", "SELECT n_regionkey, bitmap_to_string(bitmap_agg(n_nationkey)) AS b, bitmap_count(bitmap_agg(n_nationkey)) AS c FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_nationkey)), ',') AS b, CAST(count(DISTINCT n_nationkey) AS INTEGER) AS c FROM nation GROUP BY n_regionkey")
q("agg_sum_distinct_avg", "SELECT l_linestatus, round(avg(DISTINCT l_quantity), 6) AS a, round(sum(DISTINCT l_discount), 6) AS s FROM lineitem GROUP BY l_linestatus")
q("agg_any_first_last", "SELECT o_custkey, any_value(o_custkey) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi, first(o_custkey % 7) AS f, last(nullif(o_custkey, 5)) AS l FROM orders GROUP BY o_custkey",
  "SELECT o_custkey, any_value(o_custkey) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi, o_custkey % 7 AS f, nullif(o_custkey, 5) AS l FROM orders GROUP BY o_custkey")
q("agg_group_concat_distinct", "SELECT c_nationkey, GROUP_CONCAT(DISTINCT c_mktsegment ORDER BY c_mktsegment DESC SEPARATOR '|') AS a, GROUP_CONCAT(DISTINCT c_custkey % 13 ORDER BY c_custkey % 13) AS b FROM customer GROUP BY c_nationkey",
  "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment DESC) AS a, array_to_string(list_sort(list(DISTINCT c_custkey % 13)), ',') AS b FROM customer GROUP BY c_nationkey")
q("agg_array_ordered", "SELECT n_regionkey, array_join(array_agg(n_name ORDER BY n_nationkey DESC), ',') AS a, array_join(array_agg(n_nationkey ORDER BY n_regionkey, n_name), ',') AS b FROM nation GROUP BY n_regionkey",
  "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey DESC), ',') AS a, array_to_string(list(n_nationkey ORDER BY n_name), ',') AS b FROM nation GROUP BY n_regionkey")
q("agg_max_skips_nan", "SELECT l_linenumber, max(if(l_quantity > 40, cast('NaN' as double), l_quantity)) AS m FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber, max(l_quantity) FILTER (WHERE l_quantity <= 40) AS m FROM lineitem GROUP BY l_linenumber")
q("win_composed_aggregates", "SELECT n_nationkey, round(corr(n_nationkey, n_regionkey) OVER w, 9) AS a, array_join(sort_array(array_agg(n_nationkey) OVER w), ',') AS b, percentile_disc(n_nationkey, 0.5) OVER w AS c, bitmap_to_string(bitmap_agg(n_nationkey) OVER w) AS d, ndv(n_name) OVER w AS e, size(map_agg(n_name, n_nationkey) OVER w) AS f, array_join(array_agg(n_nationkey ORDER BY n_name) OVER w, ',') AS g, max(n_nationkey) OVER w AS h FROM nation WINDOW w AS (PARTITION BY n_regionkey)",
  "SELECT n_nationkey, NULL::DOUBLE AS a, b, c, b AS d, e, CAST(e AS INTEGER) AS f, g, h FROM nation JOIN (SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS b, quantile_disc(n_nationkey, 0.5) AS c, count(DISTINCT n_name) AS e, array_to_string(list(n_nationkey ORDER BY n_name), ',') AS g, max(n_nationkey) AS h FROM nation GROUP BY n_regionkey) USING (n_regionkey)")
q("grouped_topn", "SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey ORDER BY qty DESC, l_suppkey LIMIT 10")


@op("SELECT l_returnflag, l_linenumber AS item, n AS count FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 3", "lineitem")
def agg_top_k_exact(e):
    out = aggregates.top_k(e.spark.table("lineitem"), ["l_returnflag"], "l_linenumber", 3)
    return out.select("l_returnflag", F.inline("top"))


@op("SELECT CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem", "lineitem")
def agg_wrapped_sum(e):
    return e.spark.table("lineitem").agg(aggregates.wrapped_sum("l_orderkey").alias("s"))


# Windows.

q("win_ranking", "SELECT o_orderkey, row_number() OVER w AS a, rank() OVER w AS b, dense_rank() OVER w AS c, ntile(4) OVER w AS d, round(cume_dist() OVER w, 9) AS e, round(percent_rank() OVER w, 9) AS f FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey)",
  "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS a, CAST(rank() OVER w AS INTEGER) AS b, CAST(dense_rank() OVER w AS INTEGER) AS c, CAST(ntile(4) OVER w AS INTEGER) AS d, round(cume_dist() OVER w, 9) AS e, round(percent_rank() OVER w, 9) AS f FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey)")
q("win_lag_lead", "SELECT event_id, lag(value, 1, 0.0D) OVER w AS a, lead(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value, 1, 0.0) OVER w AS a, lead(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
q("win_value_ignore_nulls", "SELECT event_id, last_value(v) IGNORE NULLS OVER w AS a, first_value(v) OVER w AS b, nth_value(v, 2) OVER w AS c FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
  "SELECT event_id, last_value(v IGNORE NULLS) OVER w AS a, first_value(v) OVER w AS b, nth_value(v, 2) OVER w AS c FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
q("win_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
q("win_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a FROM events")
q("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM orders")
q("win_stats", "SELECT l_orderkey, l_linenumber, round(stddev_pop(l_quantity) OVER w, 6) AS a, round(var_samp(l_quantity) OVER w, 6) AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
q("win_named_qualify", "SELECT c_custkey, c_nationkey, row_number() OVER w AS r FROM customer QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
  "SELECT c_custkey, c_nationkey, CAST(row_number() OVER w AS INTEGER) AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY row_number() OVER w <= 3")
q("win_percentile_listagg", "SELECT n_nationkey, percentile(n_nationkey, 0.5) OVER (PARTITION BY n_regionkey) AS p FROM nation", "SELECT n_nationkey, quantile_cont(n_nationkey, 0.5) OVER (PARTITION BY n_regionkey) AS p FROM nation")


@op("SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders", "orders")
def win_groups_frame(e):
    return windows.groups_frame(e.spark.table("orders"), F.sum("o_custkey"), "s", ["o_orderstatus"], ["o_orderpriority"], -1, 0).select("o_orderkey", "s")


@op("SELECT n_nationkey, CAST(count(DISTINCT l) OVER (PARTITION BY n_regionkey) AS BIGINT) AS n, CAST(sum(DISTINCT l) OVER (PARTITION BY n_regionkey) AS DOUBLE) AS s FROM (SELECT n_nationkey, n_regionkey, length(n_name) AS l FROM nation)", "nation")
def win_distinct(e):
    w = Window.partitionBy("n_regionkey")
    t = e.spark.table("nation").withColumn("l", F.length("n_name"))
    return t.select("n_nationkey", windows.count_distinct_over("l", w).alias("n"), windows.sum_distinct_over("l", w).alias("s"))


q("win_groups_session_sql", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, session_number(o_custkey, 3) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS n FROM orders",
  "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, CAST(1 + sum(b) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS BIGINT) AS n FROM (SELECT *, CASE WHEN o_custkey - lag(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) > 3 THEN 1 ELSE 0 END AS b FROM orders)")
q("agg_top_k_sql", "SELECT o_orderstatus, t.item AS item, t.`count` AS n FROM (SELECT o_orderstatus, explode(approx_top_k(o_orderpriority, 2)) AS t FROM orders GROUP BY o_orderstatus)".replace("`", ""),
  "SELECT o_orderstatus, o_orderpriority AS item, n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r <= 2")
q("agg_weighted_percentile", "SELECT n_regionkey, percentile_approx_weighted(n_nationkey, 1, 0.5) AS p, percentile_approx(n_nationkey, 0.5) AS q FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(median(n_nationkey) AS DOUBLE) AS p, CAST(median(n_nationkey) AS DOUBLE) AS q FROM nation GROUP BY n_regionkey")
q("win_distinct_sql", "SELECT n_nationkey, count(DISTINCT n_regionkey % 2) OVER (PARTITION BY length(n_name)) AS c, sum(DISTINCT n_regionkey) OVER (PARTITION BY length(n_name)) AS s FROM nation",
  "SELECT n_nationkey, CAST(count(DISTINCT n_regionkey % 2) OVER (PARTITION BY length(n_name)) AS BIGINT) AS c, CAST(sum(DISTINCT n_regionkey) OVER (PARTITION BY length(n_name)) AS DOUBLE) AS s FROM nation")


@op("SELECT event_id, CAST(1 + sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400 THEN 1 ELSE 0 END AS b FROM (SELECT event_id, user_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))", "events")
def win_session_number(e):
    t = e.spark.table("events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return windows.session_number(t, "s", 86400, "session", ["user_id"], ["ts", "event_id"]).select("event_id", "session")


# Set operations, CTEs, recursion, expansion.

q("union_all_widen", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_custkey FROM customer", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT c_custkey FROM customer")
q("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
q("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
q("cte_shared", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM big a JOIN (SELECT max(n) AS m FROM big) b ON a.n = b.m")
q("cte_materialized", "WITH t AS MATERIALIZED (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT * FROM t WHERE n > 1", "WITH t AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT * FROM t WHERE n > 1")
q("keyed_region_pipeline", "WITH KEYED BY (user_id) SELECT user_id, count(*) AS n, round(sum(d), 4) AS d FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY user_id",
  "SELECT user_id, count(*) AS n, round(sum(d), 4) AS d FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY user_id")
q("recursive_series", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 200) SELECT n FROM t")
q("recursive_graph_distinct", "WITH RECURSIVE r(k) AS (SELECT 3 UNION SELECT (k * 7 + n_regionkey) % 25 FROM r JOIN nation ON n_nationkey = k) SELECT k FROM r")
q("series_expand", "SELECT col AS v FROM generate_series(1, 20, 3)", "SELECT generate_series AS v FROM generate_series(1, 20, 3)")
q("unnest_lateral", "SELECT vec_id, col AS x FROM embeddings, LATERAL unnest(embedding)", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
q("unnest_zip_outer", "SELECT n_nationkey, `0` AS a, `1` AS b FROM nation LEFT JOIN LATERAL unnest(split(n_name, 'A'), array(1, 2, 3)) ON TRUE",
  "SELECT n_nationkey, unnest(string_split(n_name, 'A') || list_transform(range(greatest(0, 3 - len(string_split(n_name, 'A')))), lambda x: NULL::VARCHAR)) AS a, unnest([1, 2, 3] || list_transform(range(greatest(0, len(string_split(n_name, 'A')) - 3)), lambda x: NULL::INTEGER)) AS b FROM nation")

# Functions, in batches.

q("str_case_trim", "SELECT p_partkey, upper(p_name) AS a, lcase(p_type) AS b, ltrim('  x ') AS c, trim(BOTH 'x' FROM 'xxaxx') AS d, reverse(p_brand) AS e, length(p_name) AS f, octet_length(p_name) AS g, left(p_name, 3) AS h, right(p_name, 3) AS i, substr(p_name, 2, 4) AS j, mid(p_name, 0, 2) AS k, ltrim_substring(p_name, 'a') AS l, repeat('ab', p_size % 4) AS m FROM part",
  "SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, 'x ' AS c, 'a' AS d, reverse(p_brand) AS e, CAST(length(p_name) AS INTEGER) AS f, CAST(strlen(p_name) AS INTEGER) AS g, left(p_name, 3) AS h, right(p_name, 3) AS i, substr(p_name, 2, 4) AS j, '' AS k, regexp_replace(p_name, '^(a)+', '') AS l, repeat('ab', p_size % 4) AS m FROM part")
q("str_search_pad", "SELECT p_partkey, concat(p_name, '-', p_size) AS a, concat_ws('/', p_brand, p_type) AS b, replace(p_name, 'a', 'AA') AS c, lpad(p_size, 5, '0') AS d, rpad(p_brand, 12, '.') AS e, instr(p_name, 'e') AS f, locate('e', p_name, 3) AS g, position('e' IN p_name) AS h, starts_with(p_name, 'a') AS i, ends_with(p_name, 'n') AS j, split_part(p_type, ' ', 2) AS k, substring_index(p_type, ' ', 1) AS l, translate(p_name, 'abc', 'xyz') AS m, ascii(p_name) AS n, chr(65 + p_size % 26) AS o FROM part",
  "SELECT p_partkey, p_name || '-' || p_size AS a, p_brand || '/' || p_type AS b, replace(p_name, 'a', 'AA') AS c, lpad(p_size::VARCHAR, 5, '0') AS d, rpad(p_brand, 12, '.') AS e, CAST(instr(p_name, 'e') AS INTEGER) AS f, CAST(CASE WHEN instr(substr(p_name, 3), 'e') = 0 THEN 0 ELSE instr(substr(p_name, 3), 'e') + 2 END AS INTEGER) AS g, CAST(instr(p_name, 'e') AS INTEGER) AS h, starts_with(p_name, 'a') AS i, ends_with(p_name, 'n') AS j, split_part(p_type, ' ', 2) AS k, split_part(p_type, ' ', 1) AS l, translate(p_name, 'abc', 'xyz') AS m, ascii(p_name) AS n, chr(65 + p_size % 26) AS o FROM part")
q("str_misc", "SELECT p_partkey, strcmp(p_brand, 'M') AS a, field(p_size, 1, 2, 3) AS b, elt(p_size % 3 + 1, 'x', 'y', 'z') AS c, make_set(p_size, 'a', 'b', 'c') AS d, insert(p_name, 2, 1, '_') AS e, quote('it''s') AS f, null_or_empty(nullif(p_name, '')) AS g, append_trailing_char_if_absent(p_name, 's') AS h, find_in_set('b', 'a,b,c') AS i, bit_length(p_brand) AS j, space(p_size % 3) AS k, ord('A') AS l, regexp_count(p_name, 'a') AS m, regexp_extract(p_name, '([a-z])([a-z]+)', 2) AS n, regexp_substr(p_name, '[aeiou]') AS o, format_bytes(p_size * 1000) AS p FROM part",
  "SELECT p_partkey, CASE WHEN p_brand < 'M' THEN -1 WHEN p_brand > 'M' THEN 1 ELSE 0 END AS a, CAST(coalesce(list_position([1, 2, 3], p_size), 0) AS BIGINT) AS b, (['x', 'y', 'z'])[p_size % 3 + 1] AS c, array_to_string(list_filter([CASE WHEN p_size & 1 = 1 THEN 'a' END, CASE WHEN p_size & 2 = 2 THEN 'b' END, CASE WHEN p_size & 4 = 4 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS d, substr(p_name, 1, 1) || '_' || substr(p_name, 3) AS e, '''it\\''s''' AS f, false AS g, CASE WHEN ends_with(p_name, 's') THEN p_name ELSE p_name || 's' END AS h, 2 AS i, CAST(8 * strlen(p_brand) AS INTEGER) AS j, repeat(' ', p_size % 3) AS k, 65 AS l, CAST(len(regexp_extract_all(p_name, 'a')) AS INTEGER) AS m, regexp_extract(p_name, '([a-z])([a-z]+)', 2) AS n, nullif(regexp_extract(p_name, '[aeiou]'), '') AS o, CASE WHEN p_size * 1000 < 1024 THEN (p_size * 1000) || ' B' ELSE printf('%.2f', p_size * 1000 / 1024) || ' KB' END AS p FROM part")
q("hash_encode", "SELECT p_partkey, md5(p_name) AS a, md5sum(p_name, p_brand) AS b, sha1(p_name) AS c, sha256(p_name) AS d, hex(p_name) AS e, unhex(hex(p_name)) AS f, to_base64(p_name) AS g, from_base64(to_base64(p_name)) AS h, url_encode('a b&c') AS i, url_decode('a%20b') AS j FROM part",
  "SELECT p_partkey, md5(p_name) AS a, md5(p_name || p_brand) AS b, sha1(p_name) AS c, sha256(p_name) AS d, hex(p_name) AS e, p_name AS f, to_base64(p_name::BLOB) AS g, p_name AS h, 'a+b%26c' AS i, 'a b' AS j FROM part")
q("hash_udf", "SELECT r_regionkey, murmur_hash3_32(r_name) AS a, xx_hash3_64(r_name) AS b, xx_hash3_128(r_name, 'x') AS c, __iceberg_transform_bucket(r_name, 16) AS d FROM region")
ORACLES.pop("hash_udf")
q("url_inet", "SELECT page_id, url_extract_host(url) AS a, url_extract_parameter(url, 'page') AS b, inet_ntoa(page_id + 3232235776) AS c, inet_aton('10.0.0.255') AS d, is_ipv4('1.2.3.4') AS e, is_ipv4('1.2.3.400') AS f, is_ipv6('::1') AS g, inet6_aton('::1') AS h FROM pages",
  "SELECT page_id, regexp_extract(url, '//([^/:]*)', 1) AS a, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS b, ((page_id + 3232235776) >> 24) || '.' || (((page_id + 3232235776) >> 16) & 255) || '.' || (((page_id + 3232235776) >> 8) & 255) || '.' || ((page_id + 3232235776) & 255) AS c, 167772415::BIGINT AS d, 1 AS e, 0 AS f, 1 AS g, '00000000000000000000000000000001' AS h FROM pages")
q("math_basic", "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, ceil(l_extendedprice) AS b, floor(l_extendedprice) AS c, round(l_extendedprice, 1) AS d, sign(l_tax - 0.04) AS e, mod(l_orderkey, 7) AS f, pmod(-l_orderkey, 7) AS g, l_orderkey DIV 5 AS h, l_orderkey / 0 AS i, square(l_quantity) AS j, greatest(l_linenumber, 3) AS k, least(l_linenumber, NULL) AS l, truncate(l_extendedprice, 1) AS m FROM lineitem",
  "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS b, CAST(floor(l_extendedprice) AS BIGINT) AS c, round(l_extendedprice, 1) AS d, CAST(sign(l_tax - CAST(0.04 AS DOUBLE)) AS INTEGER) AS e, l_orderkey % 7 AS f, ((-l_orderkey % 7) + 7) % 7 AS g, l_orderkey // 5 AS h, NULL::DOUBLE AS i, l_quantity * l_quantity AS j, greatest(l_linenumber, 3) AS k, NULL::INTEGER AS l, sign(l_extendedprice) * floor(abs(l_extendedprice) * 10.0::DOUBLE) / 10.0::DOUBLE AS m FROM lineitem")
q("math_real", "SELECT p_partkey, round(pow(p_size, 2), 9) AS a, round(sqrt(p_size), 9) AS b, round(exp(p_size / 100), 9) AS c, round(ln(p_size), 9) AS d, round(log10(p_size), 9) AS e, round(log2(p_size), 9) AS f, round(sin(p_size), 9) AS g, round(atan2(p_size, 2), 9) AS h, round(cbrt(p_size), 9) AS i, round(degrees(p_size), 9) AS j, acos(p_size + 1) AS k, sqrt(-1) AS l, round(cot(p_size), 6) AS m, round(pi(), 9) AS n FROM part WHERE p_size > 0",
  "SELECT p_partkey, round(pow(p_size, 2), 9) AS a, round(sqrt(p_size), 9) AS b, round(exp(p_size / 100), 9) AS c, round(ln(p_size), 9) AS d, round(log10(p_size), 9) AS e, round(log2(p_size), 9) AS f, round(sin(p_size), 9) AS g, round(atan2(p_size, 2), 9) AS h, round(cbrt(p_size), 9) AS i, round(degrees(p_size), 9) AS j, NULL::DOUBLE AS k, NULL::DOUBLE AS l, round(cot(p_size), 6) AS m, round(pi(), 9) AS n FROM part WHERE p_size > 0")
q("math_bits", "SELECT p_partkey, bit_count(p_size) AS a, bitand(p_size, 12) AS b, bitor(p_size, 1) AS c, bitxor(p_size, 5) AS d, bit_shift_left(p_size, 2) AS e, bit_shift_right(p_size, 1) AS f, bitnot(p_size) AS g, bin(p_size) AS h, conv(p_size, 10, 16) AS i, interval(p_size, 10, 20, 30) AS j FROM part",
  "SELECT p_partkey, CAST(bit_count(p_size) AS INTEGER) AS a, p_size & 12 AS b, p_size | 1 AS c, xor(p_size, 5) AS d, p_size << 2 AS e, p_size >> 1 AS f, ~p_size AS g, printf('%b', p_size) AS h, printf('%X', p_size) AS i, CASE WHEN p_size >= 30 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS j FROM part")
q("cond_functions", "SELECT n_nationkey, if(n_regionkey = 1, 'a', 'b') AS a, ifnull(nullif(n_name, 'FRANCE'), '-') AS b, coalesce(NULL, n_regionkey) AS c, nullif(n_regionkey, 2) AS d, isnull(n_name) AS e, to_int('7') AS f, to_bigint('x') AS g, to_double('1.5') AS h, to_string(n_regionkey) AS i FROM nation",
  "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'a' ELSE 'b' END AS a, coalesce(nullif(n_name, 'FRANCE'), '-') AS b, n_regionkey AS c, nullif(n_regionkey, 2) AS d, false AS e, 7 AS f, NULL::BIGINT AS g, 1.5::DOUBLE AS h, n_regionkey::VARCHAR AS i FROM nation")
q("date_parts", "SELECT o_orderkey, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, quarter(o_orderdate) AS d, dayofyear(o_orderdate) AS e, dayofweek(o_orderdate) AS f, weekday(o_orderdate) AS g, week_iso(o_orderdate) AS h, hour(o_orderdate) AS i, extract(YEAR_MONTH FROM o_orderdate) AS j, last_day(o_orderdate) AS k, dayname(o_orderdate) AS l, monthname(o_orderdate) AS m, to_days(o_orderdate) AS n FROM orders",
  "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(month(o_orderdate) AS INTEGER) AS b, CAST(day(o_orderdate) AS INTEGER) AS c, CAST(quarter(o_orderdate) AS INTEGER) AS d, CAST(dayofyear(o_orderdate) AS INTEGER) AS e, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS f, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS g, CAST(week(o_orderdate) AS INTEGER) AS h, CAST(hour(o_orderdate) AS INTEGER) AS i, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS j, last_day(o_orderdate) AS k, dayname(o_orderdate) AS l, monthname(o_orderdate) AS m, CAST(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528 AS BIGINT) AS n FROM orders")
q("date_arith", "SELECT o_orderkey, date_add(o_orderdate, INTERVAL 3 DAY) AS a, date_sub(o_orderdate, INTERVAL 1 MONTH) AS b, months_add(o_orderdate, 2) AS c, hours_sub(o_orderdate, 5) AS d, datediff(o_orderdate, DATE '1995-01-01') AS e, timestampdiff(HOUR, TIMESTAMP_NTZ '1995-01-01 00:00:00', o_orderdate) AS f, date_trunc('month', o_orderdate) AS g, date_format(o_orderdate, '%Y/%m/%d') AS h, str_to_date('2024-03-05', '%Y-%m-%d') AS i, makedate(2024, 60) AS j, period_add(202401, 14) AS k, period_diff(202503, 202401) AS l, unix_timestamp(o_orderdate) AS m, from_unixtime(86400) AS n, previous_day(o_orderdate, 'MO') AS o FROM orders",
  "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 1 MONTH AS b, o_orderdate + INTERVAL 2 MONTH AS c, o_orderdate - INTERVAL 5 HOUR AS d, CAST(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS INTEGER) AS e, CAST(trunc(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 3600) AS BIGINT) AS f, date_trunc('month', o_orderdate)::TIMESTAMP AS g, strftime(o_orderdate, '%Y/%m/%d') AS h, DATE '2024-03-05' AS i, DATE '2024-02-29' AS j, 202503::BIGINT AS k, 14::BIGINT AS l, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS m, TIMESTAMP '1970-01-02' AS n, CAST(o_orderdate::DATE - CAST(CASE WHEN isodow(o_orderdate) = 1 THEN 7 ELSE isodow(o_orderdate) - 1 END AS INTEGER) AS DATE) AS o FROM orders")
q("date_slices", "SELECT event_id, time_slice(ts, 15, 'minute') AS a, date_slice(ts, 7, 'day') AS b, weeks_diff(ts, TIMESTAMP_NTZ '2020-01-01 00:00:00') AS c, seconds_add(ts, 90) AS d, sec_to_time(3725) AS e, maketime(1, 2, 3) AS f, microsecond(ts) AS g FROM events",
  "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2001-01-01') AS a, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2001-01-01')::DATE AS b, CAST(trunc(epoch(ts - TIMESTAMP '2020-01-01') / 604800) AS BIGINT) AS c, ts + INTERVAL 90 SECOND AS d, '01:02:05' AS e, '01:02:03' AS f, CAST(microsecond(ts) % 1000000 AS INTEGER) AS g FROM events")
q("json_paths", "SELECT event_id, json_value(props, '$.k') AS a, props -> '$.k' AS b, json_valid(props) AS c, json_length('[1,2,3]') AS d, get_json_int('{\"a\": 7}', '$.a') AS e, json_exists(props, '$.zz') AS f, json_array(1, 2) AS g, json_type('[1]') AS h, json_contains('[1,2]', '2') AS i, json_remove('{\"a\": 1, \"b\": 2}', '$.a') AS j FROM events",
  "SELECT event_id, props->>'$.k' AS a, props->>'$.k' AS b, json_valid(props) AS c, 3 AS d, 7::BIGINT AS e, json_exists(props, '$.zz') AS f, '[1,2]' AS g, 'ARRAY' AS h, true AS i, '{\"b\": 2}' AS j FROM events")

# Arrays, vectors, lambdas, maps, structs, bitmaps.

q("array_functions", "SELECT n_nationkey, array_length(split(n_name, 'A')) AS a, array_join(array_sort(array(3, n_regionkey, 1)), ',') AS b, array_sum(array(1, 2, n_regionkey)) AS c, array_avg(array(1, 2, NULL)) AS d, array_position(array(5, n_regionkey), n_regionkey) AS e, array_join(array_difference(array(1, 4, 9)), ',') AS f, array_contains(array(1, NULL), NULL) AS g, array_contains_all(array(1, 2, 3), array(1, 3)) AS h, array_contains_seq(array(1, 2, 3), array(2, 3)) AS i, array_join(array_slice(array(1, 2, 3, 4), 2, 2), ',') AS j, array_min(array(4, 2)) AS k, array_join(array_generate(3), ',') AS l, [10, 20, 30][2] AS m, array_join(array_distinct(array(1, 1, 2)), ',') AS n FROM nation",
  "SELECT n_nationkey, CAST(len(string_split(n_name, 'A')) AS INTEGER) AS a, array_to_string(list_sort([3, n_regionkey, 1]), ',') AS b, CAST(3 + n_regionkey AS DOUBLE) AS c, 1.5::DOUBLE AS d, CAST(list_position([5, n_regionkey], n_regionkey) AS BIGINT) AS e, '0,3,5' AS f, true AS g, true AS h, true AS i, '2,3' AS j, 2 AS k, '1,2,3' AS l, 20 AS m, '1,2' AS n FROM nation")
q("array_lambdas", "SELECT vec_id, array_join(transform(embedding, x -> cast(x * 100 as int)), ',') AS a, size(array_filter(x -> x > 0, embedding)) AS b, any_match(embedding, x -> x > 2) AS c, all_match(embedding, x -> x < 100) AS d, array_join(array_sortby(x -> -x, array(2, 3, 1)), ',') AS e FROM embeddings",
  "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(trunc(x * 100) AS INTEGER)), ',') AS a, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS b, len(list_filter(embedding, lambda x: x > 2)) > 0 AS c, len(list_filter(embedding, lambda x: x < 100)) = len(embedding) AS d, '3,2,1' AS e FROM embeddings")
q("vector_similarity", "SELECT a.vec_id AS x, b.vec_id AS y, round(cosine_similarity(a.embedding, b.embedding), 5) AS c, round(approx_l2_distance(a.embedding, b.embedding), 3) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
  "SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS c, round(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 3) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
q("map_functions", "SELECT n_nationkey, map_size(map('a', 1, 'b', n_regionkey)) AS a, array_join(map_keys(map('x', 1, 'y', 2)), ',') AS b, element_at(map('k', n_regionkey), 'k') AS c, size(map_filter(map('p', 1, 'q', -1), (k, v) -> v > 0)) AS d, element_at(transform_values(map('p', n_regionkey), (k, v) -> v + 1), 'p') AS e, element_at(map_concat(map('a', 1), map('a', 2)), 'a') AS f, element_at(str_to_map('a:1,b:2', ',', ':'), 'b') AS g FROM nation",
  "SELECT n_nationkey, 2 AS a, 'x,y' AS b, n_regionkey AS c, 1 AS d, n_regionkey + 1 AS e, 2 AS f, '2' AS g FROM nation")
q("struct_functions", "SELECT n_nationkey, s.k AS k, s.v.w AS w, row(1, n_name).col2 AS r FROM (SELECT n_nationkey, n_name, named_struct('k', n_regionkey, 'v', named_struct('w', n_name)) AS s FROM nation)", "SELECT n_nationkey, n_regionkey AS k, n_name AS w, n_name AS r FROM nation")
q("bitmap_functions", "SELECT n_regionkey, bitmap_to_string(bitmap_or(b, to_bitmap(100))) AS a, bitmap_count(bitmap_and(b, bitmap_from_string('1,2,3'))) AS c, bitmap_contains(b, 4) AS d, bitmap_max(b) AS e, bitmap_to_string(bitmap_xor(b, to_bitmap(1))) AS f FROM (SELECT n_regionkey, bitmap_agg(n_nationkey) AS b FROM nation GROUP BY n_regionkey)",
  "SELECT n_regionkey, array_to_string(list_sort(b || [100]), ',') AS a, CAST(len(list_filter(b, lambda x: x IN (1, 2, 3))) AS INTEGER) AS c, list_contains(b, 4) AS d, CAST(list_max(b) AS BIGINT) AS e, array_to_string(list_sort(CASE WHEN list_contains(b, 1) THEN list_filter(b, lambda x: x <> 1) ELSE b || [1] END), ',') AS f FROM (SELECT n_regionkey, list(n_nationkey) AS b FROM nation GROUP BY n_regionkey)")


# Statements, variables, sources, functions of users, streams.


@op("SELECT n_nationkey, n_nationkey * 3 AS t FROM nation WHERE n_nationkey > 10", "nation")
def session_variables(e):
    return e.sql("SET @low = 5 * 2, @f = 3; SELECT n_nationkey, n_nationkey * @f AS t FROM nation WHERE n_nationkey > @low")


@op("SELECT user_id, max_by(value, event_id) AS value, CAST(max(event_id) AS BIGINT) AS event_id FROM events GROUP BY user_id", "events")
def upsert_last_writer(e):
    e.sql("CREATE TABLE u (user_id BIGINT PRIMARY KEY, value DOUBLE, event_id BIGINT)")
    from .streaming.cdc import merge

    t = e.spark.table("events").select("user_id", "value", "event_id")
    merge(e.store, "u", t.where("event_id % 2 = 0"), ["user_id"], "event_id")
    # The other batch has older and newer changes; the older ones change nothing.
    merge(e.store, "u", t.where("event_id % 2 = 1"), ["user_id"], "event_id")
    return e.sql("SELECT user_id, value, event_id FROM u")


@op("SELECT * FROM (VALUES (1, 15), (2, 20), (3, 30), (4, 1)) t(id, a)")
def on_duplicate_update(e):
    return e.sql("""CREATE TABLE dim (id INT PRIMARY KEY, a INT); INSERT INTO dim VALUES (1, 10), (2, 20);
        INSERT INTO dim VALUES (1, 5), (3, 30) ON DUPLICATE KEY UPDATE a = a + VALUES(a); INSERT IGNORE INTO dim VALUES (2, 99), (4, 0);
        REPLACE INTO dim VALUES (4, 1); SELECT id, a FROM dim""")


@op("SELECT s_suppkey, CASE WHEN n_regionkey = 2 THEN 0 ELSE s_acctbal END AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey", "supplier", "nation")
def update_join(e):
    return e.sql("CREATE TABLE s AS SELECT s_suppkey, s_nationkey, s_acctbal AS bal FROM supplier; UPDATE s JOIN nation ON s_nationkey = n_nationkey SET bal = 0 WHERE n_regionkey = 2; SELECT s_suppkey, bal FROM s")


@op("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "customer", "orders")
def delete_join(e):
    return e.sql("CREATE TABLE c AS SELECT c_custkey FROM customer; DELETE c FROM c JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000; SELECT c_custkey FROM c")


@op("SELECT * FROM (VALUES (1, 'new', 7), (2, 'b', 0), (3, 'c', 0)) t(id, label, qty)")
def auto_increment_alter(e):
    return e.sql("CREATE TABLE t (id BIGINT PRIMARY KEY AUTO_INCREMENT, label STRING); INSERT INTO t (label) VALUES ('a'), ('b'), ('c'); ALTER TABLE t ADD COLUMN qty INT DEFAULT 0; UPDATE t SET label = 'new', qty = 7 WHERE id = 1; SELECT CAST(id AS INT) AS id, label, qty FROM t")


@op("SELECT o_orderstatus, count(*) + 1 AS n FROM orders GROUP BY o_orderstatus", "orders")
def mv_refresh(e):
    e.sql("CREATE TABLE o AS SELECT o_orderstatus FROM orders; CREATE MATERIALIZED VIEW m AS SELECT o_orderstatus, count(*) AS n FROM o GROUP BY o_orderstatus")
    e.sql("INSERT INTO o SELECT DISTINCT o_orderstatus FROM orders; REFRESH MATERIALIZED VIEW m")
    return e.sql("SELECT o_orderstatus, n FROM m")


@op("SELECT r_regionkey, r_name FROM region", "region")
def file_csv_roundtrip(e):
    from .sources.files import copy_out

    path = f"{e.store.folder()}/csv-{uuid.uuid4().hex}"
    copy_out(e.spark.table("region").select("r_regionkey", "r_name"), path)
    return e.sql(f"SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name FROM read_csv('{path}', header=true, delim=',')")


@op("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3", "region")
def copy_statement(e):
    path = f"{e.store.folder()}/copy-{uuid.uuid4().hex}"
    e.sql(f"COPY (SELECT r_regionkey, r_name FROM region) TO '{path}' WITH (HEADER true); CREATE TABLE back (r_regionkey INT, r_name STRING); COPY back FROM '{path}' WITH (HEADER true)")
    return e.sql("SELECT r_regionkey, r_name FROM back WHERE r_regionkey < ?", args=[3])


@op("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region", "region")
def file_json_roundtrip(e):
    path = f"{e.store.folder()}/json-{uuid.uuid4().hex}.json"
    e.spark.table("region").select("r_regionkey", "r_name").write.json(path)
    return e.sql(f"SELECT r_regionkey, r_name FROM '{path}'")


@op("SELECT n_nationkey, CAST(strlen(n_name) * 2 AS BIGINT) AS d FROM nation", "nation")
def udf_scalar(e):
    udf.scalar(e, "double_length", _double_length, "long")
    return e.sql("SELECT n_nationkey, double_length(n_name) AS d FROM nation")


def _double_length(s: pd.Series) -> pd.Series:
    return s.str.len() * 2


@op("SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS BIGINT) AS spread FROM nation GROUP BY n_regionkey", "nation")
def udf_aggregate(e):
    return udf.two_phase(e.spark.table("nation"), ["n_regionkey"], lambda: (10**9, -(10**9)), lambda s, rows: (int(min(s[0], rows.n_nationkey.min())), int(max(s[1], rows.n_nationkey.max()))),
        lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: int(s[1] - s[0]), "lo long, hi long", "spread long")


@op("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running FROM orders", "orders")
def udtf_running_total(e):
    def f(rows):
        return pd.DataFrame({"o_custkey": rows.o_custkey.to_numpy(), "o_orderkey": rows.o_orderkey.to_numpy(), "running": rows.o_totalprice.cumsum().round(2).to_numpy()}, copy=False)

    return udf.table(e.spark.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), f, "o_custkey long, o_orderkey long, running double", ["o_custkey"], ["o_orderkey"])


@op("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "customer", "orders")
def udtf_cogroup(e):
    def f(a, b):
        return pd.DataFrame({"c_custkey": a.c_custkey.to_numpy()[:1], "n": np.full(min(len(a), 1), len(b))}, copy=False)

    left = e.spark.table("customer").select("c_custkey", F.col("c_custkey").alias("k"))
    right = e.spark.table("orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return udf.cogroup(left, right, ["k"], f, "c_custkey long, n long")


@op("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3", "nation")
def sql_table_function(e):
    return e.sql("CREATE FUNCTION of_region(r INT) RETURNS TABLE AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r); SELECT n_nationkey, n_name FROM of_region(3)")


@op("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 4 GROUP BY n_regionkey ORDER BY n DESC, n_regionkey LIMIT 3", "nation")
def builder_pipeline(e):
    out = e.scan("nation").where("n_nationkey > 4").exclude("n_name").group_by("n_regionkey", n="count(*)").order_by("n desc", "n_regionkey").limit(3)
    return out.df


@op("SELECT table_name, column_name, ordinal_position FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2)) t(table_name, column_name, ordinal_position)", "region")
def virtual_catalog(e):
    from .sources import catalog

    catalog.register(e)
    return e.sql("SELECT table_name, column_name, ordinal_position FROM information_schema__columns WHERE table_name = 'region'")


@op("SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id", "events")
def cdc_foreach_batch(e):
    from .streaming.cdc import upsert_stream

    source = f"{e.store.folder()}/stream-{uuid.uuid4().hex}"
    rows = e.spark.table("events").select("user_id", "value", "event_id")
    # Three files, each a batch of its own, in which older and newer changes of a key lie mixed.
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(source)
    e.store.create("sink", rows.limit(0), ["user_id"])
    stream = e.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    upsert_stream(stream, e.store, "sink", ["user_id"], "event_id", checkpoint=f"{e.store.folder()}/check-{uuid.uuid4().hex}").awaitTermination()
    return e.store.read("sink")


@op("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", "events")
def time_buckets(e):
    from .streaming.cdc import bucketed

    t = e.spark.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return bucketed(t, "ts", "1 day", "1 hour", ["event_type"], n="count(*)").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
