"""Queries of table shaping, quiz scoring and streaming operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.operators import profile as P
from tabulae.operators import quiz as Q
from tabulae.operators import tables as T
from tabulae.operators.hydration import latest
from tabulae.session import read
from tabulae.streaming import windows as S


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "structured_tables"), ["table_id"], [F.desc_nulls_last("updated_at"), F.desc("title")])


def agg_table_measure(spark: SparkSession, d: str) -> DataFrame:
    return T.measured(P.cells(read(spark, d, "structured_tables")))


def agg_validate(spark: SparkSession, d: str) -> DataFrame:
    return T.judged(T.measured(P.cells(read(spark, d, "structured_tables"))))


def fn_rectangular(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform("rows", lambda r: F.filter(F.map_values(r), lambda v: v.isNotNull()))
    return _tables(spark, d).where("size(rows) > 0").select("table_id", F.to_json(T.rectangular(rows)).alias("matrix"))


def fn_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "hydrated_datasets").dropDuplicates(["dataset_id"]).select("dataset_id", F.posexplode("columns").alias("pos", "c")).select("dataset_id", "pos", F.col("c.type").alias("base"))
    return T.unique_keys(keys, "dataset_id", "base", "pos").select("dataset_id", "pos", "unique_key")


def join_bbox(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d).select("document_id", F.col("table_id").alias("id"), F.explode("source_fragments").alias("f")).select("document_id", "id", "f.page", F.col("f.bounding_box").alias("box"))
    sets = read(spark, d, "hydrated_datasets").dropDuplicates(["dataset_id"]).select("document_id", F.col("dataset_id").alias("id"), F.explode("source_regions").alias("f")).select("document_id", "id", "f.page", F.col("f.bounding_box").alias("box"))
    return T.region_overlaps(tables, sets)


def join_dup_table(spark: SparkSession, d: str) -> DataFrame:
    return T.duplicate_tables(_tables(spark, d).where("page_start IS NOT NULL AND page_end IS NOT NULL").select("document_id", "table_id", "title", F.transform("columns", lambda c: c["key"]).alias("keys"), "page_start", "page_end"))


def shp_merge_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d).select("document_id", F.col("table_id").alias("fragment_id"), F.col("page_start").alias("page"), F.array_join(F.transform("columns", lambda c: c["label"]), " ").alias("header"), F.size("columns").alias("n_columns"))
    return T.continued_fragments(rows)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Quiz items answered by the event of their number: the kind of event stands for the chosen option, an error for none."""
    items = read(spark, d, "documents").where("source = 'quiz_item'").select("doc_id", "lang", F.regexp_extract("text", r"Answer: ([A-D])", 1).alias("correct")).where("correct <> ''")
    option = F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "B").when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "signup", "D")
    taken = read(spark, d, "events").select(F.col("event_id").alias("doc_id"), "user_id", option.alias("option"))
    rows = items.join(taken, "doc_id")
    score = F.when(F.col("option").isNull(), 0.0).otherwise(Q.choice_score(F.array("option"), F.array("correct"), F.lit(False)))
    return rows.withColumn("score", score).withColumn("status", Q.status(F.col("score"), F.col("option").isNotNull()))


def agg_quiz_result(spark: SparkSession, d: str) -> DataFrame:
    return Q.results(_scored(spark, d), ["user_id"])


def agg_topic_rollup(spark: SparkSession, d: str) -> DataFrame:
    return Q.topics(_scored(spark, d).withColumn("lang", F.coalesce("lang", F.lit(""))), "lang", "correct").withColumn("correct", F.coalesce("correct", F.lit(""))).withColumn("is_whole", F.col("is_whole").cast("int"))


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = S.windowed_counts(S.stream_table(spark, d, "events"), "ts", "event_id", "event_type", "1 day", "1 hour")
    return S.drain(counts).select(F.date_format("begins", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, kept by merging batches."""
    stream = S.stream_table(spark, d, "events").select("user_id", "ts", "event_id")
    empty = spark.createDataFrame([], stream.schema)
    merged = S.merge_batches(stream, lambda old, new: old.unionByName(new).groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.ts", "m.event_id"), empty)
    return merged.select("user_id", "event_id")


def stream_memory(spark: SparkSession, d: str) -> DataFrame:
    fired = S.drain(S.memory_triggers(S.stream_table(spark, d, "events").select("user_id"), 6))
    return fired.groupBy("user_id").agg(F.max("done").alias("done"))


QUERIES = {f.__name__: f for f in (agg_table_measure, agg_validate, fn_rectangular, fn_unique_keys, join_bbox, join_dup_table, shp_merge_pages, agg_quiz_result, agg_topic_rollup, stream_window_counts, stream_upsert, stream_memory)}

_SCORED = r"""i AS (SELECT doc_id, coalesce(lang, '') AS lang, regexp_extract(text, 'Answer: ([A-D])', 1) AS correct FROM documents WHERE source = 'quiz_item'),
s AS (SELECT i.*, user_id, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' END AS o FROM i JOIN events ON doc_id = event_id WHERE correct <> ''),
z AS (SELECT *, CASE WHEN o = correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN o IS NULL THEN 'skipped' WHEN o = correct THEN 'correct' ELSE 'incorrect' END AS status FROM s)"""
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY updated_at DESC NULLS LAST, title DESC) AS n_ FROM structured_tables) WHERE n_ = 1)"
_BOX = "CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN least((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2])) > 0 THEN greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) / least((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2])) ELSE 0 END"

SQL = {
    "fn_unique_keys": """WITH o AS (SELECT DISTINCT ON (dataset_id) dataset_id, columns FROM hydrated_datasets), k AS (SELECT dataset_id, CAST(generate_subscripts(columns, 1) - 1 AS INTEGER) AS pos, unnest(columns).type AS base FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, base ORDER BY pos) AS n FROM k) SELECT dataset_id, pos, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS unique_key FROM n""",
    "join_bbox": f"""WITH {_LATEST}, t AS (SELECT document_id, table_id AS left_id, f.page AS page, f.bounding_box AS a FROM (SELECT document_id, table_id, unnest(source_fragments) AS f FROM latest)),
h AS (SELECT document_id, dataset_id AS right_id, f.page AS page, f.bounding_box AS b FROM (SELECT document_id, dataset_id, unnest(source_regions) AS f FROM (SELECT DISTINCT ON (dataset_id) * FROM hydrated_datasets)))
SELECT left_id, right_id, round(max({_BOX}), 6) AS overlap FROM t JOIN h USING (document_id, page) GROUP BY 1, 2""",
    "agg_quiz_result": f"WITH {_SCORED} SELECT user_id, count(*) AS questions, round(sum(score), 6) AS marks, round(sum(score) / count(*) * 100, 2) AS percentage, count(*) FILTER (WHERE status <> 'skipped') AS attempted, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'partially_correct') AS partially_correct, count(*) FILTER (WHERE status = 'incorrect') AS incorrect FROM z GROUP BY 1",
    "agg_topic_rollup": f"""WITH {_SCORED}, g AS (SELECT lang, correct, count(*) AS questions, round(sum(score) / count(*) * 100, 2) AS percentage, count(*) FILTER (WHERE status <> 'skipped') AS attempted, CAST(grouping(correct) AS INTEGER) AS is_whole FROM z GROUP BY GROUPING SETS ((lang), (lang, correct)))
SELECT lang, coalesce(correct, '') AS correct, questions, percentage, attempted, is_whole, CASE WHEN attempted < 2 THEN 'insufficient_data' WHEN percentage < 50 THEN 'weak' WHEN percentage < 75 THEN 'needs_practice' ELSE 'strong' END AS level FROM g""",
    "stream_upsert": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
    "stream_memory": "SELECT user_id, CAST(count(*) // 6 * 6 AS BIGINT) AS done FROM events GROUP BY 1 HAVING count(*) >= 6",
}
