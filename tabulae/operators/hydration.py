"""References resolved against their tables and documents; merges of new records into old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.text import distinct_ignoring_case
from tabulae.operators.orphans import clean_key


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged_references(refs: DataFrame) -> DataFrame:
    """References to one table in one run as one: best scores, queries in the order of their first mention."""
    per = refs.groupBy("run_id", "table_id").agg(F.min("ref_id").alias("ref_id"), F.max(F.when(~F.isnan("relevance_score"), F.col("relevance_score"))).alias("relevance"), F.max(F.when(~F.isnan("rrf_score"), F.col("rrf_score"))).alias("rrf"), F.count_distinct("ref_id").alias("n_refs"), F.array_sort(F.collect_set(F.struct("ref_id", "matched_queries"))).alias("q"))
    return per.select("run_id", "table_id", "ref_id", "relevance", "rrf", "n_refs", F.array_join(F.array_distinct(F.flatten(F.transform("q", lambda x: F.coalesce(x["matched_queries"], F.array().cast("array<string>"))))), "|").alias("queries"))


def hydrated(refs: DataFrame, tables: DataFrame, documents: DataFrame) -> DataFrame:
    """References with ``status``: ``not_available`` (no such live table), ``invalid`` (no rows or columns), ``no_document``, ``stale`` (with the differing ``fields``) or ``ready``."""
    live = latest(tables.where("deleted_at IS NULL"), ["table_id"], [F.desc_nulls_last("updated_at"), F.desc("title")])
    t = live.select(clean_key(F.col("table_id")).alias("key"), F.col("document_id").alias("t_document"), F.col("title").alias("t_title"), F.col("page_start").alias("t_start"), F.col("page_end").alias("t_end"), F.transform("columns", lambda c: c["key"]).alias("t_columns"), F.size("rows").alias("t_rows"))
    d = documents.where("deleted_at IS NULL").select(clean_key(F.col("document_id")).alias("doc")).where("doc IS NOT NULL").distinct().withColumn("has_document", F.lit(True))
    one = refs.dropDuplicates(["ref_id"]).withColumn("key", clean_key(F.col("table_id"))).join(t, "key", "left")
    one = one.withColumn("doc", clean_key(F.col("t_document"))).join(d, "doc", "left")
    differs = lambda mine, theirs, name: F.when(F.col(mine).isNotNull() & (F.col(mine) != F.col(theirs)), name)
    fields = F.array_compact(F.array(F.when(clean_key(F.col("document_id")) != F.col("doc"), "document_id"), F.when((F.col("title") != "") & (F.col("title") != F.col("t_title")), "title"), differs("page_start", "t_start", "page_start"), differs("page_end", "t_end", "page_end"), F.when((F.size("expected_columns") > 0) & (F.col("expected_columns") != F.col("t_columns")), "columns")))
    status = F.when(F.col("t_document").isNull(), "not_available").when((F.col("t_rows") < 1) | (F.size("t_columns") < 1), "invalid").when(F.col("has_document").isNull(), "no_document").when(F.size(fields) > 0, "stale").otherwise("ready")
    return one.select("ref_id", "run_id", "table_id", status.alias("status"), F.when(F.col("t_document").isNotNull(), F.array_join(fields, ",")).alias("fields"))


def run_status(resolved: DataFrame) -> DataFrame:
    """Per run: references, those resolved, and ``complete``, ``partial`` or ``empty``."""
    good = F.count_if(F.col("status").isin("ready", "stale"))
    per = resolved.groupBy("run_id").agg(F.count("*").alias("n_refs"), good.alias("n_hydrated"))
    return per.withColumn("status", F.when(F.col("n_hydrated") == 0, "empty").when(F.col("n_hydrated") == F.col("n_refs"), "complete").otherwise("partial"))


def discovery(tables: DataFrame) -> DataFrame:
    """What a search index holds of a table: keys, metrics, units in order and the number of rows; never the rows."""
    live = latest(tables, ["table_id"], [F.desc_nulls_last("updated_at"), F.desc("title")])
    keys = lambda cond: F.array_join(F.transform(F.filter("columns", cond), lambda c: c["key"]), ",")
    units = F.array_join(distinct_ignoring_case(F.transform("columns", lambda c: c["unit"])), ",")
    return live.select("table_id", "title", keys(lambda c: c["key"].isNotNull()).alias("keys"), keys(lambda c: c["type"] == "number").alias("metrics"), units.alias("units"), F.size("rows").alias("n_rows"))


def replaced(old: DataFrame, new: DataFrame, key: str, group: str, created: str) -> DataFrame:
    """Old records after a group's delivery of new ones: new records win and keep the old creation time, records of delivered groups that are missing go, other groups stay. ``change`` tells which."""
    a = old.select(F.col(key), F.col(group).alias("old_group"), F.col(created).alias("old_created"))
    b = new.select(F.col(key), F.col(group).alias("new_group"), F.col(created).alias("new_created"))
    groups = new.select(F.col(group).alias("old_group")).distinct().withColumn("delivered", F.lit(True))
    both = a.join(b, key, "full").join(groups, "old_group", "left")
    change = F.when(F.col("new_group").isNotNull(), F.when(F.col("old_group").isNull(), "inserted").otherwise("updated")).when(F.col("delivered"), "removed").otherwise("kept")
    return both.select(key, F.coalesce("new_group", "old_group").alias(group), F.coalesce("old_created", "new_created").alias(created), change.alias("change"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those that new rows replace, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def backfill(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Counters of an index fill: rows scanned, indexed and skipped for want of text."""
    blank = F.col(text).isNull() | (F.trim(text) == "")
    one = rows.groupBy(key).agg(F.max(F.when(blank, 0).otherwise(1)).alias("good"))
    return one.agg(F.count("*").alias("scanned"), F.sum("good").alias("indexed"), (F.count("*") - F.sum("good")).alias("skipped"))
