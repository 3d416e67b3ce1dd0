"""Whether the columns of datasets cover what a question requires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulae.functions.text import lexical_score

#: Scores from which a column matches a requirement, or may match it.
MATCH, MAYBE = 0.82, 0.43


def requirement_columns(columns: DataFrame, requirements: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Columns with each requirement (``id``, ``kind``, ``name``, ``required``) they match or may match: ``score`` and ``match``.

    The few requirements are a literal beside each row, so there is no join. A metric needs a number column.
    """
    literal = F.array(*(F.struct(F.lit(i).alias("requirement_id"), F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(r).alias("required")) for i, k, n, r in requirements))
    asked = columns.withColumn("r", F.explode(literal)).select("*", "r.*").drop("r")
    scored = asked.withColumn("score", F.round(lexical_score("name", "label"), 6)).where(F.col("score") >= MAYBE)
    fits = F.when(F.col("kind") == "metric", F.col("declared") == "number").otherwise(True)
    return scored.where(fits).withColumn("match", F.when(F.col("score") >= MATCH, "match").otherwise("ambiguous"))


def best_evidence(matches: DataFrame, by: list[str], key: list[str], limit: int = 12) -> DataFrame:
    """The best match of each key, then the ``limit`` best of each group, by score and key."""
    from pyspark.sql import Window as W

    one = matches.withColumn("_n", F.row_number().over(W.partitionBy(*by, *key).orderBy(F.desc("score"), "label"))).where("_n = 1")
    return one.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *key))).where(F.col("place") <= limit).drop("_n")


def coverage(matches: DataFrame, requirements: DataFrame) -> DataFrame:
    """Per requirement: datasets that match and may match, and ``supported``, ``ambiguous`` or ``missing``."""
    found = matches.groupBy("requirement_id").agg(F.count_distinct(F.when(F.col("match") == "match", F.col("table_id"))).alias("matched"), F.count_distinct(F.when(F.col("match") == "ambiguous", F.col("table_id"))).alias("maybe"))
    both = requirements.join(found, "requirement_id", "left").fillna(0, ["matched", "maybe"])
    return both.withColumn("status", F.when(F.col("matched") > 0, "supported").when(F.col("maybe") > 0, "ambiguous").otherwise("missing"))


def readiness(covered: DataFrame) -> DataFrame:
    """One decision: ``ready`` if all required items are supported, ``partial`` if some are, ``clarify`` if the rest is ambiguous only, else ``insufficient``."""
    need, good, open_ = F.count_if("required"), F.count_if(F.col("required") & (F.col("status") == "supported")), F.count_if(F.col("required") & (F.col("status") == "ambiguous"))
    counts = covered.agg(need.alias("required"), good.alias("supported"), open_.alias("ambiguous"))
    return counts.withColumn("decision", F.when(F.col("supported") == F.col("required"), "ready").when(F.col("supported") > 0, "partial").when(F.col("ambiguous") > 0, "clarify").otherwise("insufficient"))


def compatible_type(wanted: Column, declared: Column) -> Column:
    return F.when(wanted == "number", declared == "number").when(wanted == "date", declared.isin("date", "string")).when(wanted == "boolean", declared == "boolean").otherwise(True)


def joinable(columns: DataFrame) -> DataFrame:
    """Per document: its tables, the labels that all of them share, and whether they can be joined on one (two tables or more)."""
    labels = columns.where("declared <> 'number'").groupBy("document_id", "table_id").agg(F.collect_set(F.lower("label")).alias("labels"))
    # pairwise intersection by counting: a label of every table occurs as often as there are tables
    tables = columns.groupBy("document_id").agg(F.count_distinct("table_id").alias("n_tables"))
    shared = labels.select("document_id", F.explode("labels").alias("label")).groupBy("document_id", "label").agg(F.count("*").alias("n"))
    common = shared.join(tables, "document_id").where("n = n_tables").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("shared"))
    both = tables.join(common, "document_id", "left").withColumn("shared", F.coalesce("shared", F.lit("")))
    return both.withColumn("joinable", (F.col("n_tables") >= 2) & (F.col("shared") != ""))
