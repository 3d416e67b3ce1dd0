"""Queries of the profiling operators, over structured tables and the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.functions.text import detect_unit, display_name, key_for_label, lexical_score, phrase, signal, uuid5
from tabulae.operators import profile as P
from tabulae.session import read


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return P.cells(read(spark, d, "structured_tables"))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return P.observed(_cells(spark, d))


def shp_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


def fn_observe_value(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).select("table_id", "row_no", "col_no", F.col("o.kind").alias("kind"), F.col("o.canonical").alias("canonical"), F.col("o.number").alias("number"), F.col("o.period.label").alias("period"))


def fn_numeric_value(spark: SparkSession, d: str) -> DataFrame:
    from tabulae.functions.values import numeric_value

    return _cells(spark, d).where("declared = 'number'").select("table_id", "row_no", "col_no", numeric_value("raw").alias("number"))


def fn_missing(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.count_if(P.is_missing("raw")).alias("n_missing"))


def agg_numeric_stats(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("value"))
    return P.numeric_profile(lines, ["l_returnflag", "l_linestatus"])


def agg_column_numbers(spark: SparkSession, d: str) -> DataFrame:
    numbers = _seen(spark, d).where("o.number IS NOT NULL").select("table_id", "col_no", F.col("o.number").alias("value"))
    return P.numeric_profile(numbers, ["table_id", "col_no"])


def agg_infer_type(spark: SparkSession, d: str) -> DataFrame:
    return P.column_types(_seen(spark, d)).select("table_id", "col_no", "inferred", "confidence")


def agg_time_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.time_profile(_seen(spark, d))


def agg_string_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.string_profile(_seen(spark, d))


def agg_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.column_profiles(_seen(spark, d))


def agg_row_features(spark: SparkSession, d: str) -> DataFrame:
    return P.row_features(_cells(spark, d))


def agg_orientation(spark: SparkSession, d: str) -> DataFrame:
    return P.table_profiles(read(spark, d, "structured_tables"))


def agg_dup_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.row_features(_cells(spark, d)).select("table_id", "n_rows", "duplicates")


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "structured_tables").select("title", F.explode("columns").alias("c")).select("title", "c.*")


def fn_detect_unit_profile(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).select("label", detect_unit(F.concat_ws(" ", "label", "title")).alias("unit")).groupBy("label", "unit").agg(F.count("*").alias("n"))


def fn_key_for_label(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).select("label", key_for_label("label").alias("made_key")).distinct()


def fn_norm_signal(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).select("label", signal("label").alias("normal")).distinct()


def fn_norm_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d).select("label", phrase("label").alias("normal")).distinct()


def fn_doc_display_name(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pdf_documents").select("document_id", "user_id", "filename", display_name("filename").alias("name")).distinct()


def fn_stable_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "structured_tables").select("table_id").distinct().select("table_id", uuid5("6ba7b8119dad11d180b400c04fd430c8", "table_id").alias("uuid"))


def mt_lexical_score(spark: SparkSession, d: str) -> DataFrame:
    """Labels of retrieved tables' expected columns against the labels that tables have, compared within shared first words."""
    wanted = read(spark, d, "retrieved_tables").select(F.explode("expected_columns").alias("wanted")).where("wanted IS NOT NULL").distinct()
    wanted = wanted.withColumn("wanted", F.replace("wanted", F.lit("_"), F.lit(" ")))
    given = _columns(spark, d).select(F.col("key"), "label").distinct()
    keyed = given.withColumn("first", F.element_at(F.split(phrase("label"), " "), 1))
    return wanted.withColumn("first", F.element_at(F.split(phrase("wanted"), " "), 1)).join(keyed, "first").select("wanted", "label", F.round(lexical_score("wanted", "label"), 6).alias("score")).distinct()


QUERIES = {f.__name__: f for f in (shp_cells, fn_observe_value, fn_numeric_value, fn_missing, agg_numeric_stats, agg_column_numbers, agg_infer_type, agg_time_stats, agg_string_stats, agg_column_profile, agg_row_features, agg_orientation, agg_dup_rows, fn_detect_unit_profile, fn_key_for_label, fn_norm_signal, fn_norm_phrase, fn_doc_display_name, fn_stable_uuid5, mt_lexical_score)}

CELLS = """
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY updated_at DESC NULLS LAST, title DESC) AS n_ FROM structured_tables) WHERE n_ = 1),
r AS (SELECT table_id, columns, unnest(rows) AS row_, CAST(generate_subscripts(rows, 1) - 1 AS INTEGER) AS row_no FROM t),
x AS (SELECT table_id, row_no, row_, unnest(columns) AS c, CAST(generate_subscripts(columns, 1) - 1 AS INTEGER) AS col_no FROM r),
cells AS (SELECT table_id, row_no, col_no, c.key AS key, c.label AS label, c.type AS declared, c.unit AS unit, row_[c.key] AS raw FROM x)
"""
_MISS = "(raw IS NULL OR lower(trim(raw)) IN ('', '-', '--', '—', '–', 'n/a', 'na', 'n.m.', 'nm', 'nil', 'none', 'null', 'not available'))"
_NUMBER = r"""
bare AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS tt FROM cells),
signed AS (SELECT *, (starts_with(tt, '(') AND ends_with(tt, ')')) AS neg FROM bare),
stripped AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN neg THEN trim(tt, '() ') ELSE tt END, '(?i)(₹|\$|€|£|\b(?:usd|inr|eur|gbp|crores?|lakhs?|millions?|billions?|thousands?|mn|bn|k)\b)', '', 'g'), '[,% ]', '', 'g') AS digits FROM signed),
numbered AS (SELECT *, CASE WHEN regexp_full_match(digits, '[+-]?(?:\d+(?:\.\d*)?|\.\d+)') THEN CAST(digits AS DOUBLE) * CASE WHEN neg THEN -1 ELSE 1 END END AS num FROM stripped)
"""
_KIND = rf"""
kinds AS (SELECT *, CASE WHEN {_MISS} THEN NULL
  WHEN lower(tt) IN ('true', 'yes', 'y', 'false', 'no', 'n') THEN 'boolean'
  WHEN regexp_matches(tt, '(?i)^(?:fy|fiscal\s*year)\s*[''’]?(?:19|20)?\d{{2}}$') THEN 'fiscal_period'
  WHEN regexp_matches(tt, '(?i)^q[1-4]\s*[-/]?\s*(?:19|20)\d{{2}}$') OR regexp_matches(tt, '(?i)^(?:19|20)\d{{2}}\s*[-/]?\s*q[1-4]$') THEN 'quarter'
  WHEN regexp_matches(tt, '^(?:19|20)\d{{2}}\s*[-–/]\s*(?:\d{{2}}|(?:19|20)\d{{2}})$') THEN 'fiscal_period'
  WHEN regexp_matches(tt, '^(?:19|20)\d{{2}}$') AND regexp_matches(label, '(?i)\b(?:date|year|fiscal|period|quarter|month|fy)\b') THEN 'calendar_year'
  WHEN num IS NOT NULL THEN CASE WHEN num = floor(num) THEN 'integer' ELSE 'number' END
  ELSE 'string' END AS kind FROM numbered)
"""
_STATS = """min(v) AS minimum, max(v) AS maximum, avg(v) AS mean, stddev_pop(v) AS deviation, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE v < 0) AS negatives"""
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("minimum", "maximum", "mean", "deviation", "p05", "p25", "median", "p75", "p95"))


def _numeric(source: str, by: str) -> str:
    on = " AND ".join(f"s.{b} = v.{b}" for b in by.split(", "))
    first = ", ".join(f"s.{b}" for b in by.split(", "))
    return f"""{source}, s AS (SELECT {by}, {_STATS} FROM vals GROUP BY {by}),
o AS (SELECT {first}, count(*) FILTER (WHERE v.v < p25 - 1.5 * (p75 - p25) OR v.v > p75 + 1.5 * (p75 - p25)) AS outliers FROM vals v JOIN s ON {on} GROUP BY {first})
SELECT {by}, {_ROUND}, zeros, negatives, outliers FROM s JOIN o USING ({by})"""


SQL = {
    "shp_cells": f"WITH {CELLS} SELECT * FROM cells",
    "fn_numeric_value": f"WITH {CELLS}, {_NUMBER} SELECT table_id, row_no, col_no, num AS number FROM numbered WHERE declared = 'number'",
    "fn_missing": f"WITH {CELLS} SELECT key, count(*) AS n, count(*) FILTER (WHERE {_MISS}) AS n_missing FROM cells GROUP BY key",
    "agg_numeric_stats": _numeric("WITH vals AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v FROM lineitem)", "l_returnflag, l_linestatus"),
    "agg_column_numbers": _numeric(f"WITH {CELLS}, {_NUMBER}, {_KIND}, vals AS (SELECT table_id, col_no, num AS v FROM kinds WHERE kind IN ('integer', 'number'))", "table_id, col_no"),
    "agg_infer_type": f"""WITH {CELLS}, {_NUMBER}, {_KIND},
c AS (SELECT table_id, col_no, count(kind) AS n, count(*) FILTER (WHERE kind IN ('integer', 'number')) AS nn, count(*) FILTER (WHERE kind = 'number') AS nd, count(*) FILTER (WHERE kind IN ('calendar_year', 'fiscal_period', 'quarter', 'month', 'date')) AS nt FROM kinds GROUP BY 1, 2),
k AS (SELECT table_id, col_no, kind, count(*) AS m, min(row_no) AS f, row_number() OVER (PARTITION BY table_id, col_no ORDER BY count(*) DESC, min(row_no)) AS p FROM kinds WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT table_id, col_no, kind, row_number() OVER (PARTITION BY table_id, col_no ORDER BY count(*) DESC, kind DESC) AS p FROM kinds WHERE kind IN ('calendar_year', 'fiscal_period', 'quarter', 'month', 'date') GROUP BY 1, 2, 3)
SELECT c.table_id, c.col_no, CASE WHEN n = 0 THEN 'empty' WHEN nn / n >= 0.9 THEN CASE WHEN nd = 0 THEN 'integer' ELSE 'number' END WHEN nt / n >= 0.9 THEN u.kind WHEN m / n >= 0.9 THEN k.kind ELSE 'mixed' END AS inferred,
round(CASE WHEN n = 0 THEN 1.0 WHEN nn / n >= 0.9 THEN nn / n WHEN nt / n >= 0.9 THEN nt / n ELSE m / n END, 6) AS confidence
FROM c LEFT JOIN k ON c.table_id = k.table_id AND c.col_no = k.col_no AND k.p = 1 LEFT JOIN u ON c.table_id = u.table_id AND c.col_no = u.col_no AND u.p = 1""",
    "agg_dup_rows": f"""WITH {CELLS}, d AS (SELECT table_id, row_no, list(coalesce(raw, chr(0)) ORDER BY col_no) AS vals FROM cells GROUP BY 1, 2)
SELECT table_id, count(*) AS n_rows, count(*) - count(DISTINCT vals) AS duplicates FROM d GROUP BY table_id""",
    "fn_doc_display_name": r"SELECT DISTINCT document_id, user_id, filename, regexp_replace(regexp_replace(filename, '^.*/', ''), '(?i)\.(pdf|docx|xlsx|xls|csv)$', '') AS name FROM pdf_documents",
    "fn_key_for_label": r"""WITH l AS (SELECT DISTINCT c.label AS label FROM (SELECT unnest(columns) AS c FROM structured_tables)),
k AS (SELECT label, trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_') AS made FROM l)
SELECT label, substr(CASE WHEN made = '' THEN 'column' WHEN regexp_matches(made, '^[0-9]') THEN 'column_' || made ELSE made END, 1, 64) AS made_key FROM k""",
    "fn_norm_phrase": r"""WITH l AS (SELECT DISTINCT c.label AS label FROM (SELECT unnest(columns) AS c FROM structured_tables)),
k AS (SELECT label, array_to_string(regexp_extract_all(replace(lower(label), '&', ' and '), '[a-z0-9]+'), ' ') AS p FROM l)
SELECT label, regexp_replace(regexp_replace(p, '\br and d\b', 'research and development', 'g'), '\bsg and a\b', 'selling general and administrative', 'g') AS normal FROM k""",
    "fn_norm_signal": r"""WITH l AS (SELECT DISTINCT c.label AS label FROM (SELECT unnest(columns) AS c FROM structured_tables))
SELECT label, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(translate(lower(label), '¹²³', '123'), '_', ' '), '&', ' and '), '₹', ' inr '), '$', ' usd '), '€', ' eur '), '£', ' gbp '), '%', ' percent '), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS normal FROM l""",
    "fn_detect_unit_profile": r"""WITH l AS (SELECT c.label AS label, c.label || ' ' || title AS s FROM (SELECT unnest(columns) AS c, title FROM structured_tables)),
u AS (SELECT label, CASE WHEN contains(s, '%') OR regexp_matches(s, '(?i)\bpercent(age)?\b') THEN 'percent' ELSE nullif(concat_ws(' ',
 CASE WHEN regexp_matches(s, '(?i)₹|\binr\b') THEN 'INR' WHEN regexp_matches(s, '(?i)\$|\busd\b') THEN 'USD' WHEN regexp_matches(s, '(?i)€|\beur\b') THEN 'EUR' WHEN regexp_matches(s, '(?i)£|\bgbp\b') THEN 'GBP' END,
 CASE WHEN regexp_matches(s, '(?i)\b(?:billion|billions|bn)\b') THEN 'billion' WHEN regexp_matches(s, '(?i)\b(?:million|millions|mn)\b') THEN 'million' WHEN regexp_matches(s, '(?i)\b(?:thousand|thousands|k)\b') THEN 'thousand' WHEN regexp_matches(s, '(?i)\b(?:crore|crores)\b') THEN 'crore' WHEN regexp_matches(s, '(?i)\b(?:lakh|lakhs)\b') THEN 'lakh' END), '') END AS unit FROM l)
SELECT label, unit, count(*) AS n FROM u GROUP BY 1, 2""",
    "fn_observe_value": rf"""WITH {CELLS}, {_NUMBER}, {_KIND}
SELECT table_id, row_no, col_no, kind, CASE WHEN kind IS NOT NULL THEN lower(tt) END AS canonical, CASE WHEN kind IN ('integer', 'number') THEN num END AS number,
CASE WHEN kind = 'calendar_year' THEN tt WHEN kind = 'fiscal_period' AND regexp_matches(tt, '(?i)^(?:fy|fiscal)') THEN 'FY' || CASE WHEN length(regexp_extract(tt, '(\d+)$')) = 2 THEN '20' ELSE '' END || regexp_extract(tt, '(\d+)$') WHEN kind = 'fiscal_period' THEN regexp_extract(tt, '^\d{{4}}') || '-' || right(tt, 2) WHEN kind = 'quarter' THEN regexp_extract(tt, '(\d{{4}})') || ' Q' || regexp_extract(tt, '(?i)q([1-4])', 1) END AS period FROM kinds""",
    "agg_string_stats": rf"""WITH {CELLS}, {_NUMBER}, {_KIND}, s AS (SELECT *, lower(tt) AS canonical FROM kinds WHERE kind = 'string'),
f AS (SELECT table_id, col_no, canonical, count(*) AS n, arg_min(tt, row_no) AS display FROM s GROUP BY 1, 2, 3), best AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_no ORDER BY n DESC, canonical) AS p FROM f),
g AS (SELECT table_id, col_no, count(*) AS n_strings, round(avg(length(tt)), 6) AS mean_length, count(*) FILTER (WHERE canonical = lower(trim(label))) AS header_cells, count(*) FILTER (WHERE regexp_matches(tt, '{P.TOTAL}')) AS total_cells, count(*) FILTER (WHERE regexp_matches(tt, '{P.FOOTNOTE}')) AS footnote_cells FROM s GROUP BY 1, 2)
SELECT g.table_id, g.col_no, n_strings, mean_length, display AS top_value, n AS top_count, header_cells, total_cells, footnote_cells FROM g JOIN best b ON g.table_id = b.table_id AND g.col_no = b.col_no AND b.p = 1""",
    "agg_row_features": rf"""WITH {CELLS}, c AS (SELECT *, NOT {_MISS} AS present, trim(raw) AS tt FROM cells),
per AS (SELECT table_id, row_no, count(*) FILTER (WHERE present) AS p, count(*) FILTER (WHERE present AND lower(tt) IN (lower(trim(key)), lower(trim(label)))) AS h, coalesce(bool_or(present AND regexp_matches(tt, '{P.TOTAL}')), false) AS total, coalesce(bool_or(present AND regexp_matches(tt, '{P.FOOTNOTE}')), false) AS foot, list(coalesce(raw, chr(0)) ORDER BY col_no) AS vals FROM c GROUP BY 1, 2)
SELECT table_id, count(*) AS n_rows, count(*) - count(DISTINCT vals) AS duplicates, count(*) FILTER (WHERE p >= 2 AND h / p >= 0.6) AS headers, count(*) FILTER (WHERE total) AS totals, count(*) FILTER (WHERE foot) AS footnotes FROM per GROUP BY 1""",
    "agg_time_stats": rf"""WITH {CELLS}, {_NUMBER}, {_KIND}, p AS (SELECT table_id, col_no, row_no, CAST(regexp_extract(tt, '(\d{{4}})') AS INTEGER) AS y, CASE WHEN kind = 'calendar_year' THEN 'calendar_year' ELSE 'fiscal_year' END AS f FROM kinds WHERE kind IN ('calendar_year', 'fiscal_period')),
g AS (SELECT table_id, col_no, string_agg(DISTINCT f, ',' ORDER BY f) AS formats, min(y) AS a, max(y) AS b, list(DISTINCT y) AS seen FROM p GROUP BY 1, 2)
SELECT table_id, col_no, formats, CASE WHEN formats = 'fiscal_year' THEN 'FY' ELSE '' END || a AS first_period, CASE WHEN formats = 'fiscal_year' THEN 'FY' ELSE '' END || b AS last_period,
CASE WHEN contains(formats, ',') OR b - a > 120 THEN '' ELSE array_to_string(list_transform(list_filter(range(a, b + 1), lambda x: NOT list_contains(seen, CAST(x AS INTEGER))), lambda x: CASE WHEN formats = 'fiscal_year' THEN 'FY' ELSE '' END || x), ',') END AS missing FROM g""",
}
