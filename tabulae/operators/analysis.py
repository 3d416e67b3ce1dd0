"""The analysis operations: filters, aggregation, comparison, trend, correlation, anomaly, ranking, distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.operators.profile import group_quantiles

FILTERS = {
    "equals": lambda c, v: c == v[0],
    "not_equals": lambda c, v: c != v[0],
    "greater_than": lambda c, v: c > v[0],
    "greater_or_equal": lambda c, v: c >= v[0],
    "less_than": lambda c, v: c < v[0],
    "less_or_equal": lambda c, v: c <= v[0],
    "in": lambda c, v: c.isin(list(v)),
    "contains": lambda c, v: c.contains(v[0]),
    "between": lambda c, v: c.between(v[0], v[1]),
}


def apply_filters(df: DataFrame, filters: list[tuple[str, str, list]]) -> DataFrame:
    """Rows that meet all ``(column, operator, values)``; unknown operators are an error, null cells never match."""
    unknown = [op for _, op, _ in filters if op not in FILTERS]
    if unknown:
        raise ValueError(f"unknown filter operators: {unknown}")
    return df.where(reduce(lambda a, b: a & b, (FILTERS[op](F.col(c), v) for c, op, v in filters), F.lit(True)))


def money(c: Column | str) -> Column:
    """Exact decimal of a two-digit amount, so that sums do not depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def aggregate(df: DataFrame, by: list[str], measure: str, mode: str = "groupby") -> DataFrame:
    """Count, sum, mean, least and most of a measure by groups; ``mode`` also takes ``rollup`` and ``cube``."""
    grouped = getattr(df, mode)(*by) if mode != "groupby" else df.groupBy(*by)
    exact = money(measure)
    return grouped.agg(F.count("*").alias("n"), F.sum(exact).cast("double").alias("total"), F.round(F.sum(exact).cast("double") / F.count(measure), 4).alias("mean"), F.min(measure).alias("least"), F.max(measure).alias("most"))


def compare(df: DataFrame, entity: str, side: str, sides: tuple[str, str], measure: str) -> DataFrame:
    """Totals of two sides per entity with difference and ratio, in one pass by conditional sums."""
    a, b = (F.sum(F.when(F.col(side) == s, money(measure))).cast("double") for s in sides)
    both = df.where(F.col(side).isin(list(sides))).groupBy(entity).agg(F.coalesce(a, F.lit(0.0)).alias("first"), F.coalesce(b, F.lit(0.0)).alias("second"))
    return both.select(entity, "first", "second", F.round(F.col("first") - F.col("second"), 2).alias("difference"), F.round(F.col("first") / F.nullif(F.col("second"), F.lit(0.0)), 6).alias("ratio"))


def trend(df: DataFrame, time: str, unit: str, measure: str) -> DataFrame:
    """Total per period with the change on the period before, and the slope of the line through all totals."""
    totals = df.groupBy(F.date_format(F.date_trunc(unit, time), "yyyy-MM-dd").alias("period")).agg(F.sum(money(measure)).cast("double").alias("total"))
    order = W.partitionBy(F.lit(1)).orderBy("period")  # one row per period: bounded by the calendar
    before = F.lag("total").over(order)
    place = F.row_number().over(order)
    whole = W.partitionBy(F.lit(1))
    rows = totals.withColumn("change", F.round(F.col("total") - before, 2)).withColumn("growth", F.round(F.col("total") / before - 1, 6)).withColumn("place", place)
    return rows.withColumn("slope", F.round(F.regr_slope("total", "place").over(whole), 2)).drop("place")


def anomalies(df: DataFrame, by: list[str], measure: str, key: list[str]) -> DataFrame:
    """Rows whose measure lies beyond 1.5 interquartile ranges of its group."""
    q = group_quantiles(df, by, measure, {"lower": 0.25, "upper": 0.75})
    spread = 1.5 * (F.col("upper") - F.col("lower"))
    bounds = q.select(*by, (F.col("lower") - spread).alias("low"), (F.col("upper") + spread).alias("high"))
    return df.join(bounds, by).where((F.col(measure) < F.col("low")) | (F.col(measure) > F.col("high"))).select(*key, *by, measure)


def rank_within(df: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` best rows of each group with row number, rank and dense rank; ties go to the lower key."""
    w = W.partitionBy(group).orderBy(F.desc(score), key)
    s = W.partitionBy(group).orderBy(F.desc(score))
    best = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return best.select(group, key, score, "place", F.rank().over(s).alias("rank_no"), F.dense_rank().over(s).alias("dense_no"))


def histogram(df: DataFrame, by: str, measure: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins between two bounds; values beyond them are in bins 0 and ``bins`` + 1."""
    return df.groupBy(by, F.width_bucket(F.col(measure), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.corr(x, y), 6).alias("correlation"), F.round(F.covar_pop(x, y), 2).alias("covariance"), F.count("*").alias("n"))
