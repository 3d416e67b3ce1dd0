"""Queries of the smaller operators: text and period functions, scoped reads, assessment, set operations; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions import text as X
from tabulae.functions.values import parse_period
from tabulae.operators import assessment as A
from tabulae.operators import context as C
from tabulae.operators import representatives as R
from tabulae.operators import retrieval as S
from tabulae.operators.hydration import latest
from tabulae.operators.orphans import clean_key
from tabulae.operators.profile import METRIC_LABEL, cells
from tabulae.session import read, small

REQUIREMENTS = [("r1", "metric", "Revenue", True), ("r2", "metric", "Operating profit", True), ("r3", "dimension", "Period", True), ("r4", "metric", "Net total income", False), ("r5", "metric", "Dividends", False)]


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "structured_tables"), ["table_id"], [F.desc_nulls_last("updated_at"), F.desc("title")])


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("document_id", "table_id", F.posexplode("columns").alias("pos", "c")).select("document_id", "table_id", "pos", F.col("c.key").alias("key"), F.col("c.label").alias("label"), F.col("c.type").alias("declared"), F.col("c.unit").alias("unit"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).select("label").distinct()


def fn_collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.btrim(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))).alias("digest"))


def fn_clean_nbsp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("text").contains("\u00a0")).select("doc_id", F.char_length(X.collapse_nbsp("text")).alias("n"))


def fn_clean_term(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "retrieved_tables").select(F.explode("matched_queries").alias("query")).where("query IS NOT NULL").select("query", X.clean_term("query").alias("term")).distinct()


def fn_token_root(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select(F.explode(F.regexp_extract_all("label", F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).distinct().select("token", X.root(F.col("token")).alias("root"))


def fn_norm_title(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("title").distinct().select("title", X.heading("title").alias("normal"))


def fn_truncate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.char_length(X.truncate("text", 180)).alias("n"))


def fn_detect_unit_extract(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("label", F.coalesce(X.extracted_unit("label"), F.lit("")).alias("unit"))


def fn_column_label(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).select("table_id", "pos", X.column_label("label", F.col("pos") + 1).alias("clean"))


def fn_page_label(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "retrieved_tables").dropDuplicates(["ref_id"]).select("ref_id", X.page_label(F.col("page_start"), F.col("page_end")).alias("pages"))


def fn_slug_id(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("label", X.slug(F.lit("metric"), "label").alias("id"))


def fn_parse_period(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(read(spark, d, "structured_tables")).where("key = 'period'").select("raw", "label").distinct()
    return rows.withColumn("p", parse_period("raw", "label")).select("raw", F.coalesce("p.format", F.lit("")).alias("format"), F.coalesce("p.label", F.lit("")).alias("period"))


def fn_period_signals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "text_evidence").where("text IS NOT NULL").select("ref_id", F.array_join(F.array_sort(X.periods_in("text")), ",").alias("periods")).distinct()


def fn_looks_numeric(spark: SparkSession, d: str) -> DataFrame:
    return cells(read(spark, d, "structured_tables")).groupBy("key").agg(F.count_if(X.looks_numeric("raw")).alias("n_numeric"), F.count("raw").alias("n"))


def fn_is_period_label(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("label", F.col("label").rlike(r"(?i)^(?:fy\s*)?(?:19|20)\d{2}(?:\s*[-–/]\s*\d{2,4})?$|^q[1-4]\b|\bperiod\b").cast("int").alias("is_period"))


def fn_years_in_table(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(read(spark, d, "structured_tables")).select("table_id", F.explode(F.regexp_extract_all("raw", F.lit(r"\b(?:FY)?((?:19|20)\d{2})\b"), F.lit(1))).alias("year")).distinct()
    return rows.groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"))


def fn_data_cells(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("table_id", (F.size("rows") * F.size("columns")).alias("n_cells"))


def fn_pages_overlap(spark: SparkSession, d: str) -> DataFrame:
    """References of a run to one document on common pages."""
    refs = read(spark, d, "retrieved_tables").dropDuplicates(["ref_id"]).where("page_start <= page_end").select("run_id", "document_id", "ref_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    other = refs.select("run_id", "document_id", "page", F.col("ref_id").alias("other_id"))
    return refs.join(other, ["run_id", "document_id", "page"]).where("ref_id < other_id").select("ref_id", "other_id").distinct()


def fn_minmax_semantic(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("run_id")
    rows = read(spark, d, "retrieved_tables").dropDuplicates(["ref_id"]).where("relevance_score IS NOT NULL AND NOT isnan(relevance_score)").select("run_id", "ref_id", F.col("relevance_score").alias("s"))
    low, high = F.min("s").over(w), F.max("s").over(w)
    return rows.select("ref_id", F.round(F.when((low >= 0) & (high <= 1), F.col("s")).when(high == low, 1.0).otherwise((F.col("s") - low) / (high - low)), 6).alias("score"))


def fn_rrf_norm(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "retrieved_tables").dropDuplicates(["ref_id"]).select("ref_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("rrf_score", F.lit(0.0))) / (2 * 3 / 61)), 4).alias("score"))


def fn_row_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(read(spark, d, "structured_tables")).groupBy("table_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("raw", F.lit("\u0000")).alias("raw")))).alias("c"))
    return rows.select("table_id", "row_no", F.sha2(F.array_join(F.transform("c", lambda x: x["raw"]), "|"), 256).alias("digest"))


def agg_metric_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).groupBy("table_id").agg(F.round(F.avg(F.when(F.col("label").rlike(METRIC_LABEL), 1.0).otherwise(0.0)), 6).alias("share"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return A.requirement_columns(_columns(spark, d), REQUIREMENTS)


def _requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, "requirement_id string, kind string, name string, required boolean")


def join_requirement_column(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("requirement_id", "table_id", "key", "score", "match")


def agg_evidence_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return A.best_evidence(_matches(spark, d), ["requirement_id"], ["table_id"]).select("requirement_id", "table_id", "score", "place")


def agg_requirement_coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(_matches(spark, d), _requirements(spark)).select("requirement_id", "matched", "maybe", "status")


def agg_readiness(spark: SparkSession, d: str) -> DataFrame:
    return A.readiness(A.coverage(_matches(spark, d), _requirements(spark)))


def agg_doc_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = _matches(spark, d).where("match = 'match'").groupBy("document_id").agg(F.count_distinct("requirement_id").alias("n_requirements"), F.count_distinct("table_id").alias("n_tables"))
    docs = _tables(spark, d).select("document_id").distinct().join(found, "document_id", "left").fillna(0, ["n_requirements", "n_tables"])
    return docs.withColumn("status", F.when(F.col("n_requirements") >= 3, "supported").when(F.col("n_requirements") > 0, "partial").otherwise("missing"))


def join_feasible(spark: SparkSession, d: str) -> DataFrame:
    return A.joinable(_columns(spark, d)).withColumn("joinable", F.col("joinable").cast("int"))


def join_requirement_text(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold a requirement's phrase, the 12 best of each."""
    rows = read(spark, d, "text_evidence").where("text IS NOT NULL").dropDuplicates(["ref_id"])
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))
    phrases = F.array(*(F.lit(p) for p in ("operating margins", "customer retention", "water withdrawal")))
    hits = rows.withColumn("words", words).withColumn("phrase", F.explode(phrases)).where(F.col("words").contains(F.concat(F.lit(" "), "phrase", F.lit(" "))))
    score = F.when(F.isnan("relevance_score"), 0.0).otherwise(F.coalesce("relevance_score", F.lit(0.0)))
    place = F.row_number().over(W.partitionBy("phrase").orderBy(F.desc(score), "ref_id"))
    return hits.withColumn("place", place).where("place <= 12").select("phrase", "ref_id", "place")


def join_entity_scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose name holds an entity."""
    entities = F.array(*(F.lit(e) for e in ("rundalen energy", "hexmoor", "pantaro", "nobody inc")))
    docs = read(spark, d, "pdf_documents").where("filename <> ''").select("document_id", F.lower(F.regexp_replace(X.display_name("filename"), "[_-]+", " ")).alias("name")).distinct()
    return docs.withColumn("entity", F.explode(entities)).where(F.col("name").contains(F.col("entity"))).select("entity", "document_id").distinct()


def src_scroll(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sparse_records").where("collection = 'pdf_chunks__sparse'").select("point_id", F.col("payload.doc_id").alias("doc_id"), F.coalesce("payload.page_number", F.lit(0)).alias("page")).distinct()


def src_by_ids(spark: SparkSession, d: str) -> DataFrame:
    wanted = small(read(spark, d, "retrieved_tables").select(clean_key(F.col("table_id")).alias("table_id")).where("table_id IS NOT NULL").distinct())
    return _tables(spark, d).join(wanted, "table_id", "left_semi").select("table_id", "title")


def src_tables_page(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("document_id")
    rows = _tables(spark, d).select("document_id", "table_id", "page_start", F.row_number().over(w.orderBy("page_start", "table_id")).alias("place"), F.count("*").over(w).alias("total"))
    return rows.where("place BETWEEN 2 AND 3")


def src_table_metadata(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "structured_tables").select("table_id", "title", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ",").alias("words")).distinct()


def flt_tenant_text(spark: SparkSession, d: str) -> DataFrame:
    """Records of a user's chats' documents only."""
    chats = read(spark, d, "chats").select("user_id", F.explode("doc_ids").alias("raw")).select("user_id", clean_key(F.col("raw")).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    rows = read(spark, d, "sparse_records").select("point_id", F.col("payload.user_id").alias("user_id"), clean_key(F.col("payload.doc_id")).alias("doc_id")).distinct()
    return rows.join(chats, ["user_id", "doc_id"], "left_semi").select("point_id", "user_id", "doc_id")


def flt_ownership(spark: SparkSession, d: str) -> DataFrame:
    own = _tables(spark, d).select("table_id", "user_id", "document_id")
    docs = read(spark, d, "pdf_documents").where("deleted_at IS NULL").select("user_id", "document_id").distinct().withColumn("ok", F.lit(1))
    return own.join(docs, ["user_id", "document_id"], "left").select("table_id", F.when(F.col("ok").isNull(), "unresolved").otherwise("owned").alias("status"))


def flt_valid_citations(spark: SparkSession, d: str) -> DataFrame:
    """At most two citations of a message, the first two."""
    cited = C.cited(C.messages(read(spark, d, "chats"))).withColumn("n", F.col("citation").cast("int"))
    return cited.withColumn("place", F.row_number().over(W.partitionBy("chat_id", "turn").orderBy("n"))).where("place <= 2").select("chat_id", "turn", "citation", "place")


def snk_delete_scope(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "pdf_documents").groupBy(clean_key(F.col("document_id")).alias("doc")).agg(F.min(F.col("deleted_at").isNotNull()).alias("all_gone")).where("all_gone AND doc IS NOT NULL")
    rows = read(spark, d, "sparse_records").select("point_id", clean_key(F.col("payload.doc_id")).alias("doc")).distinct()
    return rows.join(gone, "doc", "left_anti").select("point_id", F.coalesce("doc", F.lit("")).alias("doc"))


def snk_attach(spark: SparkSession, d: str) -> DataFrame:
    """Each chat's documents as a set in order, at most four."""
    rows = latest(read(spark, d, "chats"), ["chat_id"], [F.desc_nulls_last("updated_at")])
    ids = F.array_distinct(F.array_compact(F.transform("doc_ids", lambda x: clean_key(x))))
    return rows.where("doc_ids IS NOT NULL").select("chat_id", F.array_join(F.slice(ids, 1, 4), ",").alias("documents"), F.size(ids).alias("n"))


def snk_orphan(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no chat refers to."""
    used = read(spark, d, "chats").select(F.explode("doc_ids").alias("raw")).select(clean_key(F.col("raw")).alias("doc")).where("doc IS NOT NULL").distinct()
    return read(spark, d, "pdf_documents").select(clean_key(F.col("document_id")).alias("doc")).distinct().join(used, "doc", "left_anti")


def set_obsolete(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "sparse_records").where("collection = 'pdf_chunks__sparse'").select("point_id")
    return old.distinct().join(read(spark, d, "text_evidence").select(F.col("chunk_id").alias("point_id")).distinct(), "point_id", "left_anti")


def set_candidates_union(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "retrieved_tables").select(clean_key(F.col("table_id")).alias("table_id"))
    b = read(spark, d, "hydrated_datasets").select(clean_key(F.col("table_id")).alias("table_id"))
    return a.union(b).where("table_id IS NOT NULL").distinct()


def win_fallback_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last assistant turn of each chat, or its last message."""
    turns = C.messages(read(spark, d, "chats"))
    return turns.groupBy("chat_id").agg(F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("turn"))), F.max("turn")).alias("turn"))


def win_attempt_number(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt_no"))


def sort_document_order(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "sparse_records").dropDuplicates(["point_id"]).select("point_id", F.coalesce("payload.doc_id", F.lit("")).alias("doc"), F.col("payload.page_number").alias("page"))
    return rows.select("doc", "point_id", F.row_number().over(W.partitionBy("doc").orderBy(F.asc_nulls_last("page"), "point_id")).alias("place"))


def mt_exact_title(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "retrieved_tables").where("title <> ''").select(X.heading("title").alias("normal")).distinct()
    have = _tables(spark, d).groupBy(X.heading("title").alias("normal")).agg(F.count("*").alias("n"))
    return wanted.join(have, "normal", "left").select("normal", F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("status"))


def mt_contains_phrase(spark: SparkSession, d: str) -> DataFrame:
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", words.contains(" capital expenditure ").cast("int").alias("found"))


def top_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The vector of each label that is most like the label's centre; sums per dimension are partial before the shuffle."""
    v = read(spark, d, "embeddings").select("label", "vec_id", "embedding")
    parts = v.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("centre"))
    dot = F.aggregate(F.zip_with("embedding", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return v.join(small(centres), "label").groupBy("label").agg(F.max_by("vec_id", F.struct(F.round(dot, 9), -F.col("vec_id"))).alias("vec_id"))


def top_mmr(spark: SparkSession, d: str) -> DataFrame:
    return R.node_diverse(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 10)


def top_scope_budget(spark: SparkSession, d: str) -> DataFrame:
    return R.scope_representatives(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 12)


def top_select_tables(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.isnan("relevance_score"), 0.0).otherwise(F.coalesce("relevance_score", F.lit(0.0)))
    rows = read(spark, d, "retrieved_tables").dropDuplicates(["ref_id"]).where("run_id IS NOT NULL").select("run_id", clean_key(F.col("table_id")).alias("table_id"), "document_id", "title", F.col("expected_columns").alias("keys"), "page_start", "page_end", score.alias("score"))
    return S.select_tables(rows, "run_id", 4)


def mt_title_keyword(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "cash flow statement"), (2, "environmental data"), (3, "2.1 Segment results"), (4, "schedule of borrowings in millions")], "query_id bigint, query string")
    return S.title_scores(_tables(spark, d), asked)


def shp_visual_word_rows(spark: SparkSession, d: str) -> DataFrame:
    """Regions of tables as boxes on their pages, grouped into visual rows."""
    from tabulae.operators.tables import visual_rows

    return visual_rows(_boxes(spark, d))


def shp_cluster_columns(spark: SparkSession, d: str) -> DataFrame:
    from tabulae.operators.tables import column_anchors, visual_rows

    boxes = _boxes(spark, d)
    return column_anchors(boxes.join(visual_rows(boxes), ["page_id", "word_id"]), least_rows=1)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = _tables(spark, d).select("document_id", "table_id", F.posexplode("source_fragments").alias("pos", "f")).where("f.bounding_box IS NOT NULL")
    return boxes.select(F.concat_ws("#", "document_id", F.col("f.page").cast("string")).alias("page_id"), F.concat_ws("#", "table_id", F.col("pos").cast("string")).alias("word_id"), F.col("f.bounding_box")[0].alias("x"), F.col("f.bounding_box")[1].alias("y"))


def join_chunk_node(spark: SparkSession, d: str) -> DataFrame:
    """Records of known nodes; records of unknown ones are counted by ``known`` 0."""
    nodes = read(spark, d, "structured_tables").select("node_id").where("node_id IS NOT NULL").distinct().withColumn("known", F.lit(1))
    rows = read(spark, d, "sparse_records").dropDuplicates(["point_id"]).select("point_id", F.col("payload.node_id").alias("node_id"))
    return rows.join(nodes, "node_id", "left").groupBy(F.coalesce("known", F.lit(0)).alias("known")).agg(F.count("*").alias("n"))


def agg_node_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "sparse_records").where("payload.doc_id <> ''").groupBy(F.col("payload.doc_id").alias("doc_id"))
    return rows.agg(F.array_join(F.array_sort(F.collect_set("payload.node_id")), ",").alias("nodes"), F.count_distinct("point_id").alias("n"))


_ALL = (top_mmr, top_scope_budget, top_select_tables, mt_title_keyword, shp_visual_word_rows, shp_cluster_columns, join_chunk_node, agg_node_metadata, fn_collapse_ws, fn_clean_nbsp, fn_clean_term, fn_token_root, fn_norm_title, fn_truncate, fn_detect_unit_extract, fn_column_label, fn_page_label, fn_slug_id, fn_parse_period, fn_period_signals, fn_looks_numeric, fn_is_period_label, fn_years_in_table, fn_data_cells, fn_pages_overlap, fn_minmax_semantic, fn_rrf_norm, fn_row_digest, agg_metric_ratio, join_requirement_column, agg_evidence_dedupe, agg_requirement_coverage, agg_readiness, agg_doc_coverage, join_feasible, join_requirement_text, join_entity_scope, src_scroll, src_by_ids, src_tables_page, src_table_metadata, flt_tenant_text, flt_ownership, flt_valid_citations, snk_delete_scope, snk_attach, snk_orphan, set_obsolete, set_candidates_union, win_fallback_turns, win_attempt_number, sort_document_order, mt_exact_title, mt_contains_phrase, top_nearest_centroid)
QUERIES = {f.__name__: f for f in _ALL}

_KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))), '')"
_T = "tabs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY updated_at DESC NULLS LAST, title DESC) AS n_ FROM structured_tables) WHERE n_ = 1)"
_C = f"{_T}, cols AS (SELECT document_id, table_id, c.key AS key, c.label AS label, c.type AS declared, pos FROM (SELECT document_id, table_id, unnest(columns) AS c, CAST(generate_subscripts(columns, 1) - 1 AS INTEGER) AS pos FROM tabs))"
_CELLS = f"{_T}, r AS (SELECT table_id, columns, unnest(rows) AS row_, CAST(generate_subscripts(rows, 1) - 1 AS INTEGER) AS row_no FROM tabs), x AS (SELECT table_id, row_no, row_, unnest(columns) AS c, CAST(generate_subscripts(columns, 1) - 1 AS INTEGER) AS col_no FROM r), cells AS (SELECT table_id, row_no, col_no, c.key AS key, c.label AS label, row_[c.key] AS raw FROM x)"
_REFS = "refs AS (SELECT DISTINCT ON (ref_id) * FROM retrieved_tables)"
_TURNS = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n_ FROM chats) WHERE n_ = 1),
turns AS (SELECT chat_id, turn, m.role AS role, m.content AS content FROM (SELECT chat_id, unnest(conversation) AS m, CAST(generate_subscripts(conversation, 1) - 1 AS INTEGER) AS turn FROM newest))"""
_HEAD = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '^\s*\d+(?:\.\d+)*[.)]?\s+', ''), '\b(?:chapter|section|part|unit|lesson|module|appendix|figure|table|the|a|an|of|and|in|on|for|to|introduction|overview)\b', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' +', ' ', 'g'))"

SQL = {
    "join_chunk_node": "WITH o AS (SELECT DISTINCT ON (point_id) point_id, payload.node_id AS node_id FROM sparse_records) SELECT CAST(CASE WHEN node_id IN (SELECT node_id FROM structured_tables WHERE node_id IS NOT NULL) THEN 1 ELSE 0 END AS INTEGER) AS known, count(*) AS n FROM o GROUP BY 1",
    "agg_node_metadata": "SELECT payload.doc_id AS doc_id, coalesce(string_agg(DISTINCT payload.node_id, ',' ORDER BY payload.node_id), '') AS nodes, count(DISTINCT point_id) AS n FROM sparse_records WHERE payload.doc_id <> '' GROUP BY 1",
    "fn_collapse_ws": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    "fn_token_root": f"WITH {_C}, k AS (SELECT DISTINCT unnest(regexp_extract_all(label, '[A-Za-z]+')) AS token FROM cols) SELECT token, CASE WHEN length(token) > 4 AND lower(token) LIKE '%ies' THEN regexp_replace(lower(token), 'ies$', 'y') WHEN length(token) > 4 AND lower(token) LIKE '%s' AND lower(token) NOT LIKE '%ss' THEN regexp_replace(lower(token), 's$', '') ELSE lower(token) END AS root FROM k",
    "fn_norm_title": f"WITH {_T}, k AS (SELECT DISTINCT title FROM tabs) SELECT title, {_HEAD} AS normal FROM k",
    "fn_detect_unit_extract": rf"""WITH {_C}, k AS (SELECT DISTINCT label FROM cols), e AS (SELECT label, regexp_extract(label, '(?i)\b((?:INR|USD|EUR|GBP)(?:\s+(?:crores?|lakhs?|millions?|billions?|thousands?))?)\b', 1) AS code FROM k)
SELECT label, CASE WHEN contains(label, '₹') THEN 'INR' WHEN contains(label, '$') THEN 'USD' WHEN code <> '' THEN upper(code) WHEN contains(label, '%') THEN '%' ELSE '' END AS unit FROM e""",
    "fn_page_label": f"WITH {_REFS} SELECT ref_id, CASE WHEN page_start IS NULL THEN 'pages unknown' WHEN coalesce(page_end, page_start) = page_start THEN 'page ' || page_start ELSE 'pages ' || page_start || '-' || page_end END AS pages FROM refs",
    "fn_slug_id": f"WITH {_C}, k AS (SELECT DISTINCT label FROM cols) SELECT label, 'req_metric_' || substr(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) || '_' || substr(sha256(label), 1, 8) AS id FROM k",
    "fn_parse_period": rf"""WITH {_CELLS}, k AS (SELECT DISTINCT raw FROM cells WHERE key = 'period')
SELECT raw, CASE WHEN regexp_full_match(raw, '(?i)(?:fy|fiscal\s*year)\s*[''’]?(?:19|20)?\d{{2}}') THEN 'fiscal_year' WHEN regexp_full_match(raw, '(?:19|20)\d{{2}}\s*[-–/]\s*(?:\d{{2}}|(?:19|20)\d{{2}})') THEN 'year_range' WHEN regexp_full_match(raw, '(?:19|20)\d{{2}}') THEN 'calendar_year' ELSE '' END AS format,
CASE WHEN regexp_full_match(raw, '(?i)(?:fy|fiscal\s*year)\s*[''’]?(?:19|20)\d{{2}}') THEN 'FY' || regexp_extract(raw, '\d{{4}}') WHEN regexp_full_match(raw, '(?:19|20)\d{{2}}') THEN raw ELSE '' END AS period FROM k""",
    "fn_is_period_label": rf"WITH {_C}, k AS (SELECT DISTINCT label FROM cols) SELECT label, CAST(regexp_matches(label, '(?i)^(?:fy\s*)?(?:19|20)\d{{2}}(?:\s*[-–/]\s*\d{{2,4}})?$|^q[1-4]\b|\bperiod\b') AS INTEGER) AS is_period FROM k",
    "fn_years_in_table": rf"WITH {_CELLS}, y AS (SELECT DISTINCT table_id, unnest(regexp_extract_all(raw, '\b(?:FY)?((?:19|20)\d{{2}})\b', 1)) AS year FROM cells) SELECT table_id, string_agg(year, ',' ORDER BY year) AS years FROM y GROUP BY 1",
    "fn_data_cells": f"WITH {_T} SELECT table_id, CAST(len(rows) * len(columns) AS INTEGER) AS n_cells FROM tabs",
    "fn_pages_overlap": f"WITH {_REFS} SELECT DISTINCT a.ref_id, b.ref_id AS other_id FROM refs a JOIN refs b ON a.run_id = b.run_id AND a.document_id = b.document_id AND a.ref_id < b.ref_id WHERE a.page_start <= a.page_end AND b.page_start <= b.page_end AND greatest(a.page_start, b.page_start) <= least(a.page_end, b.page_end)",
    "fn_minmax_semantic": f"""WITH {_REFS}, s AS (SELECT ref_id, relevance_score AS s, min(relevance_score) OVER (PARTITION BY run_id) AS lo, max(relevance_score) OVER (PARTITION BY run_id) AS hi FROM refs WHERE relevance_score IS NOT NULL AND NOT isnan(relevance_score))
SELECT ref_id, round(CASE WHEN lo >= 0 AND hi <= 1 THEN s WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END, 6) AS score FROM s""",
    "fn_rrf_norm": f"WITH {_REFS} SELECT ref_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(rrf_score, 0)) / (6 / 61::DOUBLE)), 4) AS score FROM refs",
    "fn_row_digest": f"WITH {_CELLS} SELECT table_id, row_no, sha256(string_agg(coalesce(raw, chr(0)), '|' ORDER BY col_no)) AS digest FROM cells GROUP BY 1, 2",
    "agg_metric_ratio": rf"WITH {_C} SELECT table_id, round(avg(CASE WHEN regexp_matches(label, '{METRIC_LABEL}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM cols GROUP BY 1",
    "join_feasible": f"""WITH {_C}, t AS (SELECT document_id, count(DISTINCT table_id) AS n_tables FROM cols GROUP BY 1), s AS (SELECT document_id, lower(label) AS label, count(DISTINCT table_id) AS n FROM cols WHERE declared <> 'number' GROUP BY 1, 2),
c AS (SELECT s.document_id, string_agg(label, '|' ORDER BY label) AS shared FROM s JOIN t USING (document_id) WHERE n = n_tables GROUP BY 1)
SELECT t.document_id, n_tables, coalesce(shared, '') AS shared, CAST(n_tables >= 2 AND coalesce(shared, '') <> '' AS INTEGER) AS joinable FROM t LEFT JOIN c ON t.document_id = c.document_id""",
    "join_requirement_text": """WITH e AS (SELECT DISTINCT ON (ref_id) ref_id, text, CASE WHEN relevance_score IS NULL OR isnan(relevance_score) THEN 0.0 ELSE relevance_score END AS s FROM text_evidence WHERE text IS NOT NULL),
w AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS ws FROM e), p AS (SELECT unnest(['operating margins', 'customer retention', 'water withdrawal']) AS phrase),
h AS (SELECT phrase, ref_id, CAST(row_number() OVER (PARTITION BY phrase ORDER BY s DESC, ref_id) AS INTEGER) AS place FROM w, p WHERE contains(ws, ' ' || phrase || ' ')) SELECT * FROM h WHERE place <= 12""",
    "join_entity_scope": r"""WITH n AS (SELECT DISTINCT document_id, lower(regexp_replace(regexp_replace(regexp_replace(filename, '^.*/', ''), '(?i)\.(pdf|docx|xlsx|xls|csv)$', ''), '[_-]+', ' ', 'g')) AS name FROM pdf_documents WHERE filename <> ''), e AS (SELECT unnest(['rundalen energy', 'hexmoor', 'pantaro', 'nobody inc']) AS entity)
SELECT DISTINCT entity, document_id FROM n, e WHERE contains(name, entity)""",
    "src_scroll": "SELECT DISTINCT point_id, payload.doc_id AS doc_id, coalesce(payload.page_number, 0) AS page FROM sparse_records WHERE collection = 'pdf_chunks__sparse'",
    "src_by_ids": f"WITH {_T} SELECT table_id, title FROM tabs WHERE table_id IN (SELECT {_KEY.format('table_id')} FROM retrieved_tables WHERE {_KEY.format('table_id')} IS NOT NULL)",
    "src_tables_page": f"WITH {_T}, p AS (SELECT document_id, table_id, page_start, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_start, table_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY document_id) AS total FROM tabs) SELECT * FROM p WHERE place BETWEEN 2 AND 3",
    "src_table_metadata": "SELECT DISTINCT table_id, title, coalesce(array_to_string(keywords, ','), '') AS words FROM structured_tables",
    "flt_tenant_text": f"WITH c AS (SELECT DISTINCT user_id, {_KEY.format('raw')} AS doc_id FROM (SELECT user_id, unnest(doc_ids) AS raw FROM chats)) SELECT DISTINCT point_id, payload.user_id AS user_id, {_KEY.format('payload.doc_id')} AS doc_id FROM sparse_records WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = payload.user_id AND c.doc_id = {_KEY.format('payload.doc_id')})",
    "flt_ownership": f"WITH {_T} SELECT table_id, CASE WHEN EXISTS (SELECT 1 FROM pdf_documents p WHERE p.deleted_at IS NULL AND p.user_id = tabs.user_id AND p.document_id = tabs.document_id) THEN 'owned' ELSE 'unresolved' END AS status FROM tabs",
    "flt_valid_citations": rf"WITH {_TURNS}, c AS (SELECT chat_id, turn, unnest(list_distinct(regexp_extract_all(content, '\[C(\d+)\]', 1))) AS citation FROM turns WHERE role = 'assistant'), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY chat_id, turn ORDER BY CAST(citation AS INTEGER)) AS INTEGER) AS place FROM c) SELECT * FROM p WHERE place <= 2",
    "snk_delete_scope": f"WITH g AS (SELECT {_KEY.format('document_id')} AS doc FROM pdf_documents GROUP BY 1 HAVING count(*) = count(deleted_at)), r AS (SELECT DISTINCT point_id, {_KEY.format('payload.doc_id')} AS doc FROM sparse_records) SELECT point_id, coalesce(doc, '') AS doc FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc = r.doc)",
    "snk_orphan": f"WITH u AS (SELECT DISTINCT {_KEY.format('raw')} AS doc FROM (SELECT unnest(doc_ids) AS raw FROM chats)) SELECT DISTINCT {_KEY.format('document_id')} AS doc FROM pdf_documents WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc = {_KEY.format('document_id')})",
    "set_obsolete": "SELECT DISTINCT point_id FROM sparse_records WHERE collection = 'pdf_chunks__sparse' AND point_id NOT IN (SELECT chunk_id FROM text_evidence WHERE chunk_id IS NOT NULL)",
    "set_candidates_union": f"SELECT DISTINCT k AS table_id FROM (SELECT {_KEY.format('table_id')} AS k FROM retrieved_tables UNION SELECT {_KEY.format('table_id')} FROM hydrated_datasets) WHERE k IS NOT NULL",
    "win_fallback_turns": f"WITH {_TURNS} SELECT chat_id, coalesce(max(turn) FILTER (WHERE role = 'assistant'), max(turn)) AS turn FROM turns GROUP BY 1",
    "win_attempt_number": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt_no FROM events WHERE event_type = 'purchase'",
    "sort_document_order": "WITH o AS (SELECT DISTINCT ON (point_id) point_id, coalesce(payload.doc_id, '') AS doc, payload.page_number AS page FROM sparse_records) SELECT doc, point_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY page NULLS LAST, point_id) AS INTEGER) AS place FROM o",
    "mt_exact_title": f"WITH {_T}, h AS (SELECT {_HEAD} AS normal, count(*) AS n FROM tabs GROUP BY 1), w AS (SELECT DISTINCT {_HEAD} AS normal FROM retrieved_tables WHERE title <> '') SELECT w.normal, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status FROM w LEFT JOIN h ON w.normal = h.normal",
    "mt_contains_phrase": "SELECT doc_id, CAST(contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' capital expenditure ') AS INTEGER) AS found FROM documents WHERE text IS NOT NULL",
}
