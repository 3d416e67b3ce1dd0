"""Queries of projections, predicates and joins over single records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions import text as X
from tabulae.functions.values import numeric_value
from tabulae.operators import assessment as A
from tabulae.operators import concepts as C
from tabulae.operators import profile as P
from tabulae.operators.hydration import hydrated, latest
from tabulae.operators.orphans import clean_key
from tabulae.operators.representatives import evenly_spaced
from tabulae.operators.tables import sequence_ratio
from tabulae.plans.evidence_queries import _signals
from tabulae.session import numbered, read, small


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "structured_tables"), ["table_id"], [F.desc_nulls_last("updated_at"), F.desc("title")])


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "retrieved_tables").dropDuplicates(["ref_id"])


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("table_id", F.posexplode("columns").alias("pos", "c")).select("table_id", "pos", F.col("c.key").alias("key"), F.col("c.label").alias("label"), F.col("c.type").alias("declared"), F.col("c.unit").alias("unit"))


def src_worker(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of equal payload once, with how often they came."""
    return read(spark, d, "structured_tables").groupBy("table_id", "title", "page_start", "page_end", F.size("rows").alias("n_rows")).agg(F.count("*").alias("deliveries"))


def src_scroll_limited(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sparse_records").select("point_id", "collection").distinct().orderBy("point_id", "collection").limit(50)


def src_find_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of at least two rows and columns, by page and height of their first region."""
    box = F.col("source_fragments")[0]
    rows = _tables(spark, d).where("size(rows) >= 2 AND size(columns) >= 2").select("document_id", "table_id", box["page"].alias("page"), box["bounding_box"][1].alias("top"))
    return rows.select("table_id", F.row_number().over(W.partitionBy("document_id").orderBy("page", "top", "table_id")).alias("place"))


def flt_doc(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "pdf_documents").where("deleted_at IS NULL").select("user_id", clean_key(F.col("document_id")).alias("doc")).distinct()
    rows = read(spark, d, "sparse_records").select("point_id", F.col("payload.user_id").alias("user_id"), clean_key(F.col("payload.doc_id")).alias("doc")).distinct()
    return rows.join(own, ["user_id", "doc"], "left_semi").select("point_id")


def flt_node_scope(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "structured_tables").select("node_id").where("node_id IS NOT NULL").distinct()
    return read(spark, d, "sparse_records").select("point_id", F.col("payload.node_id").alias("node_id")).distinct().join(nodes, "node_id", "left_semi").select("point_id", "node_id")


def prj_text_hit(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "text_evidence").dropDuplicates(["ref_id"])
    return rows.select("ref_id", F.coalesce("document_id", F.lit("")).alias("document_id"), F.coalesce("page_number", F.lit(0)).alias("page"), F.char_length(F.coalesce("text", F.lit(""))).alias("size"), F.when(F.isnan("relevance_score"), 0.0).otherwise(F.coalesce("relevance_score", F.lit(0.0))).alias("score"))


def prj_table_hit(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).select("ref_id", F.coalesce("title", F.lit("")).alias("title"), F.size(F.coalesce("expected_columns", F.array().cast("array<string>"))).alias("n_columns"), F.coalesce("page_start", F.lit(0)).alias("page_start"))


def prj_retrieval_result(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are positive, scores between 0 and 1, queries without repeats."""
    return _refs(spark, d).select("ref_id", F.when(F.col("page_start") > 0, F.col("page_start")).otherwise(0).alias("page"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan("rrf_score"), 0.0).otherwise(F.coalesce("rrf_score", F.lit(0.0))))).alias("score"), F.array_join(X.distinct_ignoring_case("matched_queries"), "|").alias("queries"))


def prj_playable(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("source = 'quiz_item' AND text IS NOT NULL").select("doc_id", F.md5(F.regexp_replace("text", r"\n?Answer: [A-D]", "")).alias("digest"))


def prj_chunk_vector(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the one size that the collection has; others are reported by their count."""
    return read(spark, d, "embeddings").groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))


def flt_table_substantive(spark: SparkSession, d: str) -> DataFrame:
    score = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return _refs(spark, d).where((score("relevance_score") >= 0.4) | (score("rrf_score") >= 0.9)).select("ref_id", "table_id")


def flt_compatible_type(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("number"), F.lit("date"), F.lit("boolean"))
    rows = _labels(spark, d).withColumn("wanted", F.explode(kinds))
    return rows.where(A.compatible_type(F.col("wanted"), F.col("declared"))).groupBy("table_id", "wanted").agg(F.count("*").alias("n"))


def flt_filter_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose references ask one table for different first pages: more than one equality on a name."""
    rows = _refs(spark, d).where("page_start IS NOT NULL").groupBy("run_id", "table_id").agg(F.count_distinct("page_start").alias("n"))
    return rows.where("n > 1").select("run_id", "table_id", "n")


def join_profile_ctx(spark: SparkSession, d: str) -> DataFrame:
    """Datasets with the roles of their table's columns."""
    roles = P.column_profiles(P.observed(P.cells(read(spark, d, "structured_tables")))).groupBy(F.col("table_id").alias("key")).agg(F.count_if(F.col("role") == "metric").alias("metrics"), F.count_if(F.col("role") == "time_period").alias("times"), F.count("*").alias("n_columns"))
    sets = read(spark, d, "hydrated_datasets").select("dataset_id", clean_key(F.col("table_id")).alias("key")).distinct()
    return sets.join(roles, "key", "left").select("dataset_id", F.coalesce("metrics", F.lit(-1)).alias("metrics"), F.coalesce("times", F.lit(-1)).alias("times"), F.coalesce("n_columns", F.lit(-1)).alias("n_columns"))


def join_submission(spark: SparkSession, d: str) -> DataFrame:
    """Quiz items with their number of answers; answers to unknown items are left out and unanswered items kept."""
    items = read(spark, d, "documents").where("source = 'quiz_item'").select("doc_id")
    taken = read(spark, d, "events").select(F.col("event_id").alias("doc_id"), "user_id")
    return items.join(taken, "doc_id", "left").groupBy("doc_id").agg(F.count("user_id").alias("answers"))


def join_word_in_table(spark: SparkSession, d: str) -> DataFrame:
    """Datasets' regions whose middle lies in a region of their document's tables on the same page."""
    inside = _tables(spark, d).select("document_id", F.explode("source_fragments").alias("f")).select("document_id", F.col("f.page").alias("page"), F.col("f.bounding_box").alias("b"))
    words = read(spark, d, "hydrated_datasets").dropDuplicates(["dataset_id"]).select("document_id", "dataset_id", F.posexplode("source_regions").alias("pos", "f")).select("document_id", "dataset_id", "pos", F.col("f.page").alias("page"), F.col("f.bounding_box").alias("w"))
    x, y = (F.col("w")[0] + F.col("w")[2]) / 2, (F.col("w")[1] + F.col("w")[3]) / 2
    met = words.join(inside, ["document_id", "page"]).where((x >= F.col("b")[0]) & (x <= F.col("b")[2]) & (y >= F.col("b")[1]) & (y <= F.col("b")[3]))
    return met.select("dataset_id", "pos").distinct()


def agg_artifact_counts(spark: SparkSession, d: str) -> DataFrame:
    return hydrated(read(spark, d, "retrieved_tables"), read(spark, d, "structured_tables"), read(spark, d, "pdf_documents")).groupBy("status").agg(F.count("*").alias("n"))


def agg_merge_entries(spark: SparkSession, d: str) -> DataFrame:
    """Pages and chunks that each document is cited with over all runs."""
    rows = read(spark, d, "text_evidence").where("document_id <> ''")
    return rows.groupBy("document_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("page_number").alias("pages"), F.count_distinct("run_id").alias("runs"))


def agg_summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(read(spark, d, "chats"), ["chat_id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("ingested_at")])
    return rows.groupBy("user_id").agg(F.count("*").alias("chats"), F.sum(F.coalesce(F.size("conversation"), F.lit(0))).alias("messages"), F.sum(F.coalesce("memory.summarized_count", F.lit(0))).alias("summarized"))


def set_missing_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each chat that no evidence was found for."""
    asked = read(spark, d, "chats").select("chat_id", F.explode("doc_ids").alias("raw")).select("chat_id", clean_key(F.col("raw")).alias("doc")).where("doc IS NOT NULL").distinct()
    have = read(spark, d, "text_evidence").select(F.col("document_id").alias("doc")).where("doc <> ''").distinct()
    return asked.join(have, "doc", "left_anti").groupBy("chat_id").agg(F.count("*").alias("n_missing"))


def fn_raw_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("table_id", F.size(F.regexp_extract_all(F.replace("title", F.lit("_"), F.lit(" ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("n"))


def fn_canonical_value(spark: SparkSession, d: str) -> DataFrame:
    return P.cells(read(spark, d, "structured_tables")).where("raw IS NOT NULL").select("table_id", "row_no", "col_no", F.lower(X.collapse("raw")).alias("canonical"))


def fn_header_flags(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.regexp_extract_all("label", F.lit(r"\S+"), F.lit(0)))
    return _labels(spark, d).select("table_id", "pos", ((F.char_length("label") > 96) | (words >= 12)).cast("int").alias("is_sentence"), F.col("label").rlike(r"(?i)^(?:column|field|unnamed)[ _]*\d*$").cast("int").alias("is_generic"))


def fn_det_summary(spark: SparkSession, d: str) -> DataFrame:
    """Five lines that describe a table without reading its rows."""
    names = F.array_join(F.transform("columns", lambda c: c["label"]), ", ")
    lines = F.concat_ws("\n", F.concat(F.lit("Table: "), "title"), F.concat(F.lit("Pages: "), "page_start", F.lit("-"), "page_end"), F.concat(F.lit("Columns: "), names), F.concat(F.lit("Rows: "), F.size("rows")), F.concat(F.lit("Method: "), "extraction_method"))
    return _tables(spark, d).select("table_id", F.md5(lines).alias("digest"))


def fn_parse_scalar(spark: SparkSession, d: str) -> DataFrame:
    rows = P.cells(read(spark, d, "structured_tables")).where("declared = 'number'")
    return rows.withColumn("v", numeric_value("raw")).groupBy("key").agg(F.count("v").alias("n_numbers"), F.count_if(F.col("v") < 0).alias("n_negative"), F.count_if(F.col("raw").isNull()).alias("n_null"))


def fn_bbox_flip(spark: SparkSession, d: str) -> DataFrame:
    """Boxes counted from the bottom of an 842-point page."""
    rows = _tables(spark, d).select("table_id", F.posexplode("source_fragments").alias("pos", "f")).withColumn("b", F.col("f.bounding_box"))
    return rows.select("table_id", "pos", F.round(842 - F.col("b")[3], 3).alias("top"), F.round(842 - F.col("b")[1], 3).alias("bottom"))


def fn_source_version(spark: SparkSession, d: str) -> DataFrame:
    """A version that changes with a table's title, pages and column keys."""
    parts = F.concat_ws("|", "table_id", "title", F.col("page_start").cast("string"), F.col("page_end").cast("string"), F.array_join(F.transform("columns", lambda c: c["key"]), ","), F.size("rows").cast("string"))
    return _tables(spark, d).select("table_id", F.sha2(parts, 256).alias("version"))


def mt_units(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of currencies, scales and percentages in answers."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(₹|\$|€|£|%|\b(?:inr|usd|eur|gbp|crores?|lakhs?|millions?|billions?|thousands?|percent(?:age)?)\b)"), F.lit(1))
    return read(spark, d, "documents").where("source = 'chat_answer' AND text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("units"))


def mt_numbered_parts(spark: SparkSession, d: str) -> DataFrame:
    """The number in front of a text's first line, its depth and its topic."""
    first = F.regexp_extract("text", r"^([^\n]*)", 1)
    number = F.regexp_extract(first, r"^(\d+(?:\.\d+)*) ", 1)
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", number.alias("number"), F.size(F.regexp_extract_all(number, F.lit(r"\d+"), F.lit(0))).alias("depth"))


def mt_seq_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = _refs(spark, d).select("ref_id", clean_key(F.col("table_id")).alias("table_id"), F.col("title").alias("asked"))
    return rows.join(_tables(spark, d).select("table_id", "title"), "table_id").select("ref_id", F.round(sequence_ratio("asked", "title"), 6).alias("ratio"))


def mt_value_sim(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the cell values of tables with one title in one document."""
    values = P.cells(read(spark, d, "structured_tables")).where("raw IS NOT NULL").groupBy("table_id").agg(F.collect_set("raw").alias("v"))
    t = _tables(spark, d).select("document_id", "title", "table_id").join(values, "table_id")
    other = t.select("document_id", "title", F.col("table_id").alias("other_id"), F.col("v").alias("u"))
    return t.join(other, ["document_id", "title"]).where("table_id < other_id").select("table_id", "other_id", F.round(X.jaccard(F.col("v"), F.col("u")), 6).alias("likeness"))


def _table_texts(spark: SparkSession, d: str) -> DataFrame:
    """References with what is matched of a table: all of its texts, and those of its columns alone."""
    rows = _refs(spark, d).where("run_id IS NOT NULL")
    schema = F.array_join(F.transform(F.coalesce("expected_columns", F.array().cast("array<string>")), lambda c: F.replace(c, F.lit("_"), F.lit(" "))), " ")
    units = F.array_join(F.array_distinct(F.coalesce("expected_units", F.array().cast("array<string>"))), " ")
    return rows.withColumn("schema_text", schema).withColumn("content", F.concat_ws(" ", "title", "schema_text", F.nullif(units, F.lit(""))))


def prj_candidate_text(spark: SparkSession, d: str) -> DataFrame:
    return _table_texts(spark, d).select("ref_id", "content", F.col("schema_text").alias("schema"))


def fn_score_table(spark: SparkSession, d: str) -> DataFrame:
    """References scored by fused rank, concepts in all texts and in the columns alone, years, units and consensus."""
    rrf = F.when(F.isnan("rrf_score"), 0.0).otherwise(F.col("rrf_score"))
    rows = _table_texts(spark, d).withColumn("rrf", rrf).withColumn("n_modes", F.size(F.array_distinct("retrieval_modes"))).withColumn("n_queries", F.size(F.array_distinct("matched_queries")))
    scored = C.scored(rows, _signals(spark, d, "retrieved_tables"), "run_id", "content", C.TABLE_WEIGHTS, "schema_text")
    return scored.select("ref_id", "rrf_part", "concept", "schema", "year", "unit", "consensus", "relevance")


def snk_vector_collection(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "sparse_records").groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("points"))
    limits = small(read(spark, d, "size_limits").select("collection", "max_chars"))
    return rows.join(limits, "collection", "left").select("collection", "n", "points", F.coalesce("max_chars", F.lit(0)).alias("max_chars"))


def snk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of tables that no record is indexed under yet."""
    have = read(spark, d, "sparse_records").select(F.col("payload.node_id").alias("node_id")).where("node_id IS NOT NULL").distinct()
    return read(spark, d, "structured_tables").select("node_id").where("node_id IS NOT NULL").distinct().join(have, "node_id", "left_anti")


def agg_tree_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a tree: leaves and balance below each node, partial sums before the shuffle."""
    n, c = small(read(spark, d, "nation")), read(spark, d, "customer")
    leaves = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.explode(F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).alias("node_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("v"))
    return leaves.groupBy("node_id").agg(F.count("*").alias("leaves"), F.sum("v").cast("double").alias("balance"))


def agg_map_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Records of each document in groups of 20 in document order, each group reduced to its counts."""
    rows = read(spark, d, "sparse_records").dropDuplicates(["point_id"]).select("point_id", F.coalesce("payload.doc_id", F.lit("")).alias("doc"), F.col("payload.page_number").alias("page"), F.char_length(F.coalesce("text", F.lit(""))).alias("size"))
    placed = numbered(rows, ["doc"], [F.asc_nulls_last("page"), F.asc("point_id")], "place")
    return placed.groupBy("doc", F.floor((F.col("place") - 1) / 20).cast("int").alias("group_no")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("point_id").alias("first_id"))


def prj_sources(spark: SparkSession, d: str) -> DataFrame:
    """At most 8 evenly spaced records of each document as its sources."""
    rows = read(spark, d, "sparse_records").dropDuplicates(["point_id"]).where("payload.doc_id <> ''").select(F.col("payload.doc_id").alias("doc"), "point_id")
    return evenly_spaced(rows, "doc", "point_id", 8)


_ALL = (agg_tree_reduce, agg_map_reduce, prj_sources, src_worker, src_scroll_limited, src_find_tables, flt_doc, flt_node_scope, prj_text_hit, prj_table_hit, prj_retrieval_result, prj_playable, prj_chunk_vector, flt_table_substantive, flt_compatible_type, flt_filter_conflict, join_profile_ctx, join_submission, join_word_in_table, agg_artifact_counts, agg_merge_entries, agg_summary_metrics, set_missing_docs, fn_raw_tokens, fn_canonical_value, fn_header_flags, fn_det_summary, fn_parse_scalar, fn_bbox_flip, fn_source_version, mt_units, mt_numbered_parts, mt_seq_ratio, mt_value_sim, fn_score_table, prj_candidate_text, snk_vector_collection, snk_nodes)
QUERIES = {f.__name__: f for f in _ALL}

_KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))), '')"
_T = "tabs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY updated_at DESC NULLS LAST, title DESC) AS n_ FROM structured_tables) WHERE n_ = 1)"
_L = f"{_T}, cols AS (SELECT table_id, c.key AS key, c.label AS label, c.type AS declared, pos FROM (SELECT table_id, unnest(columns) AS c, CAST(generate_subscripts(columns, 1) - 1 AS INTEGER) AS pos FROM tabs))"
_CELLS = f"{_T}, r AS (SELECT table_id, columns, unnest(rows) AS row_, CAST(generate_subscripts(rows, 1) - 1 AS INTEGER) AS row_no FROM tabs), x AS (SELECT table_id, row_no, row_, unnest(columns) AS c, CAST(generate_subscripts(columns, 1) - 1 AS INTEGER) AS col_no FROM r), cells AS (SELECT table_id, row_no, col_no, c.key AS key, c.label AS label, row_[c.key] AS raw FROM x)"
_R = "refs AS (SELECT DISTINCT ON (ref_id) * FROM retrieved_tables)"
_SCORE = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0.0::DOUBLE ELSE {0} END"

SQL = {
    "agg_tree_reduce": "WITH l AS (SELECT 'n' || n_nationkey AS node_id, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'r' || n_regionkey, CAST(c_acctbal AS DECIMAL(18,2)) FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT node_id, count(*) AS leaves, CAST(sum(v) AS DOUBLE) AS balance FROM l GROUP BY 1",
    "agg_map_reduce": "WITH o AS (SELECT DISTINCT ON (point_id) point_id, coalesce(payload.doc_id, '') AS doc, payload.page_number AS page, length(coalesce(text, '')) AS size FROM sparse_records), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page NULLS LAST, point_id) AS place FROM o) SELECT doc, CAST(floor((place - 1) / 20) AS INTEGER) AS group_no, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, min(point_id) AS first_id FROM p GROUP BY 1, 2",
    "prj_sources": "WITH o AS (SELECT DISTINCT ON (point_id) point_id, payload.doc_id AS doc FROM sparse_records WHERE payload.doc_id <> ''), i AS (SELECT doc, point_id, row_number() OVER (PARTITION BY doc ORDER BY point_id) - 1 AS i, count(*) OVER (PARTITION BY doc) AS n FROM o) SELECT doc, point_id FROM i WHERE n <= 8 OR i IN (SELECT round_even((n - 1) * o / 7, 0) FROM range(8) t(o))",
    "src_worker": "SELECT table_id, title, page_start, page_end, CAST(len(rows) AS INTEGER) AS n_rows, count(*) AS deliveries FROM structured_tables GROUP BY 1, 2, 3, 4, 5",
    "src_scroll_limited": "SELECT DISTINCT point_id, collection FROM sparse_records ORDER BY point_id, collection LIMIT 50",
    "src_find_tables": f"WITH {_T} SELECT table_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY source_fragments[1].page NULLS FIRST, source_fragments[1].bounding_box[2] NULLS FIRST, table_id) AS INTEGER) AS place FROM tabs WHERE len(rows) >= 2 AND len(columns) >= 2",
    "flt_doc": f"SELECT DISTINCT point_id FROM sparse_records s WHERE EXISTS (SELECT 1 FROM pdf_documents p WHERE p.deleted_at IS NULL AND p.user_id = s.payload.user_id AND {_KEY.format('p.document_id')} = {_KEY.format('s.payload.doc_id')})",
    "flt_node_scope": "SELECT DISTINCT point_id, payload.node_id AS node_id FROM sparse_records WHERE payload.node_id IN (SELECT node_id FROM structured_tables WHERE node_id IS NOT NULL)",
    "prj_text_hit": f"SELECT DISTINCT ON (ref_id) ref_id, coalesce(document_id, '') AS document_id, coalesce(page_number, 0) AS page, CAST(length(coalesce(text, '')) AS INTEGER) AS size, {_SCORE.format('relevance_score')} AS score FROM text_evidence",
    "prj_table_hit": f"WITH {_R} SELECT ref_id, coalesce(title, '') AS title, CAST(coalesce(len(expected_columns), 0) AS INTEGER) AS n_columns, coalesce(page_start, 0) AS page_start FROM refs",
    "prj_playable": r"SELECT doc_id, md5(regexp_replace(text, '\n?Answer: [A-D]', '', 'g')) AS digest FROM documents WHERE source = 'quiz_item' AND text IS NOT NULL",
    "prj_chunk_vector": "SELECT CAST(len(embedding) AS INTEGER) AS size, count(*) AS n FROM embeddings GROUP BY 1",
    "flt_table_substantive": f"WITH {_R} SELECT ref_id, table_id FROM refs WHERE {_SCORE.format('relevance_score')} >= 0.4 OR {_SCORE.format('rrf_score')} >= 0.9",
    "flt_compatible_type": f"WITH {_L}, w AS (SELECT *, unnest(['number', 'date', 'boolean']) AS wanted FROM cols) SELECT table_id, wanted, count(*) AS n FROM w WHERE CASE wanted WHEN 'number' THEN declared = 'number' WHEN 'date' THEN declared IN ('date', 'string') ELSE declared = 'boolean' END GROUP BY 1, 2",
    "flt_filter_conflict": f"WITH {_R} SELECT run_id, table_id, count(DISTINCT page_start) AS n FROM refs WHERE page_start IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page_start) > 1",
    "join_submission": "SELECT d.doc_id, count(e.user_id) AS answers FROM documents d LEFT JOIN events e ON d.doc_id = e.event_id WHERE source = 'quiz_item' GROUP BY 1",
    "join_word_in_table": f"""WITH {_T}, i AS (SELECT document_id, f.page AS page, f.bounding_box AS b FROM (SELECT document_id, unnest(source_fragments) AS f FROM tabs)),
w AS (SELECT document_id, dataset_id, pos, f.page AS page, f.bounding_box AS w FROM (SELECT document_id, dataset_id, unnest(source_regions) AS f, CAST(generate_subscripts(source_regions, 1) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT ON (dataset_id) * FROM hydrated_datasets)))
SELECT DISTINCT dataset_id, pos FROM w JOIN i USING (document_id, page) WHERE (w[1] + w[3]) / 2 BETWEEN b[1] AND b[3] AND (w[2] + w[4]) / 2 BETWEEN b[2] AND b[4]""",
    "agg_merge_entries": "SELECT document_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT page_number) AS pages, count(DISTINCT run_id) AS runs FROM text_evidence WHERE document_id <> '' GROUP BY 1",
    "agg_summary_metrics": "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n FROM chats) WHERE n = 1) SELECT user_id, count(*) AS chats, CAST(sum(coalesce(len(conversation), 0)) AS BIGINT) AS messages, CAST(sum(coalesce(memory.summarized_count, 0)) AS BIGINT) AS summarized FROM c GROUP BY 1",
    "set_missing_docs": f"WITH a AS (SELECT DISTINCT chat_id, {_KEY.format('raw')} AS doc FROM (SELECT chat_id, unnest(doc_ids) AS raw FROM chats)) SELECT chat_id, count(*) AS n_missing FROM a WHERE doc IS NOT NULL AND doc NOT IN (SELECT document_id FROM text_evidence WHERE document_id <> '') GROUP BY 1",
    "fn_raw_tokens": rf"WITH {_T} SELECT table_id, CAST(len(regexp_extract_all(replace(title, '_', ' '), '[\p{{L}}\p{{N}}]+')) AS INTEGER) AS n FROM tabs",
    "fn_canonical_value": rf"WITH {_CELLS} SELECT table_id, row_no, col_no, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS canonical FROM cells WHERE raw IS NOT NULL",
    "fn_header_flags": rf"WITH {_L} SELECT table_id, pos, CAST(length(label) > 96 OR len(regexp_extract_all(label, '\S+')) >= 12 AS INTEGER) AS is_sentence, CAST(regexp_matches(label, '(?i)^(?:column|field|unnamed)[ _]*\d*$') AS INTEGER) AS is_generic FROM cols",
    "fn_det_summary": f"WITH {_T} SELECT table_id, md5(concat_ws(chr(10), 'Table: ' || title, 'Pages: ' || page_start || '-' || page_end, 'Columns: ' || array_to_string(list_transform(columns, lambda c: c.label), ', '), 'Rows: ' || len(rows), 'Method: ' || extraction_method)) AS digest FROM tabs",
    "fn_bbox_flip": f"WITH {_T} SELECT table_id, pos, round(842 - f.bounding_box[4], 3) AS top, round(842 - f.bounding_box[2], 3) AS bottom FROM (SELECT table_id, unnest(source_fragments) AS f, CAST(generate_subscripts(source_fragments, 1) - 1 AS INTEGER) AS pos FROM tabs)",
    "fn_source_version": f"WITH {_T} SELECT table_id, sha256(concat_ws('|', table_id, title, CAST(page_start AS VARCHAR), CAST(page_end AS VARCHAR), array_to_string(list_transform(columns, lambda c: c.key), ','), CAST(len(rows) AS VARCHAR))) AS version FROM tabs",
    "mt_units": r"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '(₹|\$|€|£|%|\b(?:inr|usd|eur|gbp|crores?|lakhs?|millions?|billions?|thousands?|percent(?:age)?)\b)', 1))), ','), '') AS units FROM documents WHERE source = 'chat_answer' AND text IS NOT NULL",
    "mt_numbered_parts": r"WITH f AS (SELECT doc_id, regexp_extract(regexp_extract(text, '^([^\n]*)', 1), '^(\d+(?:\.\d+)*) ', 1) AS number FROM documents WHERE text IS NOT NULL) SELECT doc_id, number, CAST(len(regexp_extract_all(number, '\d+')) AS INTEGER) AS depth FROM f",
    "mt_value_sim": f"""WITH {_CELLS}, v AS (SELECT table_id, list_distinct(list(raw)) AS v FROM cells WHERE raw IS NOT NULL GROUP BY 1), t AS (SELECT document_id, title, tabs.table_id, v FROM tabs JOIN v ON tabs.table_id = v.table_id)
SELECT a.table_id, b.table_id AS other_id, round(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))), 6) AS likeness FROM t a JOIN t b ON a.document_id = b.document_id AND a.title = b.title AND a.table_id < b.table_id""",
    "snk_vector_collection": "SELECT s.collection, count(*) AS n, count(DISTINCT point_id) AS points, coalesce(max(max_chars), 0) AS max_chars FROM sparse_records s LEFT JOIN size_limits l ON s.collection = l.collection GROUP BY 1",
    "snk_nodes": "SELECT DISTINCT node_id FROM structured_tables WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT payload.node_id FROM sparse_records WHERE payload.node_id IS NOT NULL)",
}
