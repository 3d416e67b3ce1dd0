"""Scoring of quiz answers and roll-up by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempted answers from which a topic is judged, and percentages below which it is weak or needs practice.
LEAST_ATTEMPTS, WEAK, STRONG = 2, 50.0, 75.0


def choice_score(selected: Column, correct: Column, partial: Column) -> Column:
    """1 for exactly the right options; with partial credit the share of right ones less wrong ones, not below 0; else 0."""
    hits, misses = F.size(F.array_intersect(selected, correct)), F.size(F.array_except(selected, correct))
    exact = (misses == 0) & (hits == F.size(correct))
    return F.when(exact, 1.0).when(partial, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hits - misses) / F.size(correct)))).otherwise(0.0)


def blank_score(given: Column, accepted: Column) -> Column:
    """Share of blanks whose answer, without regard to case and white space, is among the accepted ones of its position."""
    clean = lambda c: F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))
    right = F.zip_with(given, accepted, lambda g, a: F.when(F.exists(a, lambda x: clean(x) == clean(g)), 1.0).otherwise(0.0))
    return F.aggregate(right, F.lit(0.0), lambda s, x: s + x) / F.size(accepted)


def match_score(given: Column, correct: Column) -> Column:
    return F.size(F.array_intersect(given, correct)) / F.size(correct)


def status(score: Column, attempted: Column) -> Column:
    return F.when(~attempted, "skipped").when(F.abs(score - 1) <= 1e-9, "correct").when(score <= 0, "incorrect").otherwise("partially_correct")


def results(scored: DataFrame, by: list[str]) -> DataFrame:
    """Marks, percentage and counts by status of ``score`` and ``status`` per group."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("questions"), F.round(F.sum("score"), 6).alias("marks"), F.round(F.sum("score") / F.count("*") * 100, 2).alias("percentage"),
        F.count_if(F.col("status") != "skipped").alias("attempted"), *(F.count_if(F.col("status") == s).alias(s) for s in ("correct", "partially_correct", "incorrect")),
    )


def topics(scored: DataFrame, main: str, sub: str) -> DataFrame:
    """Results per main topic and per sub topic (null sub: the main topic as a whole) with a level."""
    grouped = scored.groupingSets([[F.col(main)], [F.col(main), F.col(sub)]], F.col(main), F.col(sub)).agg(F.count("*").alias("questions"), F.round(F.sum("score") / F.count("*") * 100, 2).alias("percentage"), F.count_if(F.col("status") != "skipped").alias("attempted"), F.grouping(sub).alias("is_whole"))
    level = F.when(F.col("attempted") < LEAST_ATTEMPTS, "insufficient_data").when(F.col("percentage") < WEAK, "weak").when(F.col("percentage") < STRONG, "needs_practice").otherwise("strong")
    return grouped.withColumn("level", level)
