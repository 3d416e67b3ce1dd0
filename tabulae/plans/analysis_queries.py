"""Queries of the analysis operations over the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.operators import analysis as A
from tabulae.session import read, small


def op_lookup(spark: SparkSession, d: str) -> DataFrame:
    return A.apply_filters(read(spark, d, "orders"), [("o_orderstatus", "equals", ["F"]), ("o_totalprice", "greater_than", [200000.0])]).select("o_orderkey", "o_custkey", "o_totalprice")


def flt_filter_ops(spark: SparkSession, d: str) -> DataFrame:
    filters = [("p_size", "between", [5, 30]), ("p_brand", "in", ["Brand#11", "Brand#12", "Brand#23", "Brand#34"]), ("p_type", "not_equals", ["NONE"]), ("p_retailprice", "greater_or_equal", [100.0]), ("p_retailprice", "less_or_equal", [5000.0]), ("p_name", "contains", ["a"])]
    return A.apply_filters(read(spark, d, "part"), filters).select("p_partkey", "p_brand", "p_size", "p_retailprice")


def op_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


def op_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", "rollup")


def op_cube(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", "cube")


def op_comparison(spark: SparkSession, d: str) -> DataFrame:
    return A.compare(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ("A", "N"), "l_extendedprice")


def op_trend(spark: SparkSession, d: str) -> DataFrame:
    return A.trend(read(spark, d, "orders"), "o_orderdate", "quarter", "o_totalprice")


def op_correlation(spark: SparkSession, d: str) -> DataFrame:
    return A.correlations(read(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


def op_anomaly_detection(spark: SparkSession, d: str) -> DataFrame:
    return A.anomalies(read(spark, d, "events"), ["event_type"], "value", ["event_id"])


def op_ranking(spark: SparkSession, d: str) -> DataFrame:
    return A.rank_within(read(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 3)


def op_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(read(spark, d, "lineitem"), "l_returnflag", "l_quantity", 0.0, 50.0, 10)


def op_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def op_star_join(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation and year over five tables; the dimension tables are broadcast if their counted size allows it."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations, regions = small(read(spark, d, "nation")), small(read(spark, d, "region"))
    revenue = A.money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name", "year").agg(F.round(F.sum(revenue).cast("double"), 4).alias("revenue"), F.count("*").alias("n"))


def op_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = read(spark, d, "customer"), read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    has = customers.join(orders, "c_custkey", "left_semi").select("c_custkey", F.lit("with").alias("side"))
    return has.unionByName(customers.join(orders, "c_custkey", "left_anti").select("c_custkey", F.lit("without").alias("side")))


def op_summarization(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    parts = [orders.agg(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count(c).alias("present"), F.count_distinct(c).alias("distinct_values"), F.min(F.col(c).cast("string")).alias("least"), F.max(F.col(c).cast("string")).alias("most")) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_order_page(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_totalprice")


def win_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events: a gap of 30 minutes starts a new one."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "value")
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))
    e = e.withColumn("starts", F.when(gap.isNull() | (gap > 1800), 1).otherwise(0))
    e = e.withColumn("session_no", F.sum("starts").over(w))
    return e.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("begins"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("ends"))


QUERIES = {f.__name__: f for f in (op_lookup, flt_filter_ops, op_aggregation, op_rollup, op_cube, op_comparison, op_trend, op_correlation, op_anomaly_detection, op_ranking, op_distribution, op_value_counts, op_star_join, op_semi_anti, op_summarization, top_order_page, win_session)}

_AGG = "count(*) AS n, CAST(sum(CAST({m} AS DECIMAL(18,2))) AS DOUBLE) AS total, round(CAST(sum(CAST({m} AS DECIMAL(18,2))) AS DOUBLE) / count({m}), 4) AS mean, min({m}) AS least, max({m}) AS most"

SQL = {
    "op_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
    "flt_filter_ops": "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') AND p_type <> 'NONE' AND p_retailprice >= 100 AND p_retailprice <= 5000 AND contains(p_name, 'a')",
    "op_aggregation": f"SELECT l_returnflag, l_linestatus, {_AGG.format(m='l_extendedprice')} FROM lineitem GROUP BY 1, 2",
    "op_rollup": f"SELECT o_orderstatus, o_orderpriority, {_AGG.format(m='o_totalprice')} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "op_cube": f"SELECT o_orderstatus, o_orderpriority, {_AGG.format(m='o_totalprice')} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "op_comparison": """WITH s AS (SELECT l_suppkey, coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE), 0) AS first, coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'N') AS DOUBLE), 0) AS second FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1)
SELECT l_suppkey, first, second, round(first - second, 2) AS difference, round(first / nullif(second, 0), 6) AS ratio FROM s""",
    "op_trend": """WITH t AS (SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1),
r AS (SELECT *, lag(total) OVER (ORDER BY period) AS b, row_number() OVER (ORDER BY period) AS p FROM t)
SELECT period, total, round(total - b, 2) AS change, round(total / b - 1, 6) AS growth, (SELECT round(regr_slope(total, p), 2) FROM r) AS slope FROM r""",
    "op_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(covar_pop(l_quantity, l_extendedprice), 2) AS covariance, count(*) AS n FROM lineitem GROUP BY 1",
    "op_anomaly_detection": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
    "op_ranking": """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS rank_no, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS dense_no FROM orders) WHERE place <= 3""",
    "op_distribution": "SELECT l_returnflag, CAST(CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "op_value_counts": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "op_star_join": """SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE), 4) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "op_semi_anti": "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'with' ELSE 'without' END AS side FROM customer",
    "op_summarization": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS least, max(CAST({c} AS VARCHAR)) AS most FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "top_order_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20",
    "win_session": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 1800 THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ends FROM s GROUP BY 1, 2""",
}
