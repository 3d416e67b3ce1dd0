"""Profiles of structured tables: cells in long form, statistics per column, quality per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.text import collapse, is_missing
from tabulae.functions.values import NUMERIC, TEMPORAL, observe, parse_period
from tabulae.session import checkpoint, numbered

# What makes a label an identifier or a metric, a row a total or a footnote.
ID_LABEL = r"(?i)(?:^|[_\s-])(?:id|identifier|code|account|reference|serial|sku|isin)(?:$|[_\s-])"
METRIC_LABEL = r"(?i)\b(?:amount|balance|cost|count|expense|income|margin|profit|rate|ratio|revenue|sales|total|value|volume|assets?|liabilit(?:y|ies)|cash|debt|emissions?|percentage|percent)\b"
TOTAL = r"(?i)^(?:grand\s+)?(?:sub\s*)?total\b|\bnet\s+total\b"
FOOTNOTE = r"(?i)^(?:\*+|†+|‡+|note\b|notes\b|source\s*:|excluding\b|including\b)"


def cells(tables: DataFrame) -> DataFrame:
    """One row per table, row and column: ``table_id``, ``row_no``, ``col_no``, ``key``, ``label``, ``declared``, ``unit``, ``raw``.

    Re-delivered tables count once (the latest by ``updated_at``); a cell that its row lacks is null.
    """
    ranked = tables.withColumn("_n", F.row_number().over(W.partitionBy("table_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("title")))).where("_n = 1")
    flat = ranked.select("table_id", "columns", F.posexplode("rows").alias("row_no", "row"))
    flat = flat.select("table_id", "row_no", "row", F.posexplode("columns").alias("col_no", "c"))
    return flat.select("table_id", "row_no", "col_no", F.col("c.key").alias("key"), F.col("c.label").alias("label"), F.col("c.type").alias("declared"), F.col("c.unit").alias("unit"), F.try_element_at("row", F.col("c.key")).alias("raw"))


def observed(table_cells: DataFrame) -> DataFrame:
    """Cells with ``o``, what each holds (null where missing), written once, because profiles read them several times."""
    return checkpoint(observe(table_cells, "raw", "label"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Half to even, as the profiles' figures are defined."""
    return F.bround(c, digits)


#: Quantiles of a profile.
QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def group_quantiles(values: DataFrame, by: list[str], value: str, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours: ``by`` and one column per quantile.

    Values are numbered over ranges of the groups and the two at each quantile's place are picked, so
    no task holds a group, however large. Nulls and NaN do not count.
    """
    placed = numbered(values.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)"), by, [F.asc("_v")], "_i", "_size")
    last = F.col("_size") - 1
    below = {n: F.floor(last * q) for n, q in quantiles.items()}
    near = reduce(Column.__or__, ((F.col("_i") - 1).isin(b, F.ceil(last * q)) for (n, q), b in zip(quantiles.items(), below.values())))
    at = lambda place: F.max(F.when(F.col("_i") - 1 == place, F.col("_v")))
    picked = placed.where(near).groupBy(*by).agg(*(x for n, q in quantiles.items() for x in (at(below[n]).alias(f"_a_{n}"), at(F.ceil(last * q)).alias(f"_b_{n}"), F.max(last * q - below[n]).alias(f"_f_{n}"))))
    return picked.select(*by, *((F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in quantiles))


def numeric_profile(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Statistics of a number per group: extremes, mean, population deviation, exact interpolated quantiles, zeros, negatives, and values beyond 1.5 interquartile ranges.

    Outliers are counted in a second pass over the values with the bounds joined back.
    """
    v = F.col(value)
    stats = values.groupBy(*by).agg(F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"))
    places = checkpoint(group_quantiles(values, by, value))
    spread = F.col("p75") - F.col("p25")
    bounds = places.select(*by, (F.col("p25") - 1.5 * spread).alias("low"), (F.col("p75") + 1.5 * spread).alias("high"))
    outliers = values.join(bounds, by).groupBy(*by).agg(F.count_if((v < F.col("low")) | (v > F.col("high"))).alias("outliers"))
    return stats.join(places, by).join(outliers, by).select(*by, *(rounded(F.col(c)).alias(c) for c in ("minimum", "maximum", "mean", "deviation", *QUANTILES)), "zeros", "negatives", "outliers")


def column_types(seen: DataFrame) -> DataFrame:
    """``inferred`` type and ``confidence`` per table and column: numeric or temporal from 90 % of the cells on, else the most frequent kind if it reaches that, else ``mixed``; ``empty`` without cells."""
    by = ["table_id", "col_no"]
    kind = F.col("o.kind")
    counts = seen.groupBy(*by).agg(
        F.count("o").alias("n"), F.count_if(kind.isin(NUMERIC)).alias("n_numeric"), F.count_if(kind == "number").alias("n_number"), F.count_if(kind.isin(TEMPORAL)).alias("n_temporal"),
        *(F.count_if(kind == k).alias(f"k_{k}") for k in ("boolean", "string", "integer", "number", *TEMPORAL)),
        *(F.min(F.when(kind == k, F.col("row_no"))).alias(f"f_{k}") for k in ("boolean", "string", "integer", "number", *TEMPORAL)),
    )
    # the most frequent temporal kind, the greater name on ties; the most frequent kind at all, the first seen on ties
    temporal = F.array_max(F.array(*(F.struct(F.col(f"k_{k}").alias("n"), F.lit(k).alias("kind")) for k in TEMPORAL)))
    most = F.array_max(F.array(*(F.struct(F.col(f"k_{k}").alias("n"), (-F.coalesce(f"f_{k}", F.lit(2**31 - 1))).alias("first"), F.lit(k).alias("kind")) for k in ("boolean", "string", "integer", "number", *TEMPORAL))))
    n = F.col("n")
    inferred = F.when(n == 0, "empty").when(F.col("n_numeric") / n >= 0.9, F.when(F.col("n_number") == 0, "integer").otherwise("number")).when(F.col("n_temporal") / n >= 0.9, temporal["kind"]).when(most["n"] / n >= 0.9, most["kind"]).otherwise("mixed")
    confidence = F.when(n == 0, 1.0).when(F.col("n_numeric") / n >= 0.9, F.col("n_numeric") / n).when(F.col("n_temporal") / n >= 0.9, F.col("n_temporal") / n).otherwise(most["n"] / n)
    return counts.select(*by, inferred.alias("inferred"), rounded(confidence).alias("confidence"), "n_numeric", "n_temporal")


def missing_periods(fmt: Column, seen: Column) -> Column:
    """Labels of the whole periods between the first and last of ``seen`` (interval numbers) that are not among them; none beyond a span of 120 and for dates."""
    low, high = F.array_min(seen), F.array_max(seen)
    gaps = F.array_except(F.sequence(low, high), seen)

    def label(i: Column) -> Column:
        year, quarter, month = i.cast("string"), F.floor(i / 4).cast("int"), F.floor(i / 12).cast("int")
        return (
            F.when(fmt == "calendar_year", year)
            .when(fmt == "fiscal_year", F.concat(F.lit("FY"), year))
            .when(fmt == "year_range", F.concat(year, F.lit("-"), F.substring((i + 1).cast("string"), -2, 2)))
            .when(fmt == "quarter", F.concat(quarter, F.lit(" Q"), i % 4 + 1))
            .otherwise(F.concat(F.lpad(month.cast("string"), 4, "0"), F.lit("-"), F.lpad((i % 12 + 1).cast("string"), 2, "0")))
        )

    return F.when(fmt.isNotNull() & (F.size(seen) > 0) & (high - low <= 120), F.transform(F.array_sort(gaps), label)).otherwise(F.array().cast("array<string>"))


def time_profile(seen: DataFrame) -> DataFrame:
    """Per table and column with periods: their formats, first and last label, missing labels."""
    p = F.col("o.period")
    rows = seen.where(p.isNotNull()).select("table_id", "col_no", "row_no", "o.period.*")
    key = F.struct("y", "m", "d", "row_no")
    stats = rows.groupBy("table_id", "col_no").agg(F.min_by("label", key).alias("first_period"), F.max_by("label", F.struct("y", "m", "d", -F.col("row_no"))).alias("last_period"), F.count_if(F.col("interval").isNull()).alias("open"), F.collect_set("interval").alias("seen"), F.array_sort(F.collect_set("format")).alias("kinds"))
    one = F.when((F.size("kinds") == 1) & (F.col("open") == 0), F.col("kinds")[0])
    return stats.select("table_id", "col_no", F.array_join("kinds", ",").alias("formats"), "first_period", "last_period", F.array_join(missing_periods(one, F.col("seen")), ",").alias("missing"))


def string_profile(seen: DataFrame) -> DataFrame:
    """Per table and column with strings: the most frequent value (ties: the lower), its count, mean length, cells that repeat the header, totals and footnotes."""
    s = seen.where(F.col("o.kind") == "string").select("table_id", "col_no", "label", "row_no", "o.canonical", "o.display")
    freq = s.groupBy("table_id", "col_no", "canonical").agg(F.count("*").alias("n"), F.min_by("display", "row_no").alias("display"))
    top = freq.groupBy("table_id", "col_no").agg(F.min(F.struct((-F.col("n")).alias("n"), "canonical", "display")).alias("t"))
    stats = s.groupBy("table_id", "col_no").agg(F.count("*").alias("n_strings"), rounded(F.avg(F.char_length("display"))).alias("mean_length"), F.count_if(F.col("canonical") == F.lower(collapse("label"))).alias("header_cells"), F.count_if(F.col("display").rlike(TOTAL)).alias("total_cells"), F.count_if(F.col("display").rlike(FOOTNOTE)).alias("footnote_cells"))
    return stats.join(top, ["table_id", "col_no"]).select("table_id", "col_no", "n_strings", "mean_length", F.col("t.display").alias("top_value"), (-F.col("t.n")).alias("top_count"), "header_cells", "total_cells", "footnote_cells")


def column_profiles(seen: DataFrame) -> DataFrame:
    """One row per table and column: counts, distinct values, inferred type, confidence, role and warnings."""
    by = ["table_id", "col_no"]
    base = seen.groupBy(*by).agg(F.first("key").alias("key"), F.first("label").alias("label"), F.first("declared").alias("declared"), F.count("*").alias("n_cells"), F.count("o").alias("n_present"), F.count_distinct("o.canonical").alias("n_distinct"))
    both = base.join(column_types(seen), by).join(string_profile(seen).select(*by, "mean_length"), by, "left")
    ratio = F.when(F.col("n_present") > 0, F.col("n_distinct") / F.col("n_present")).otherwise(0.0)
    both = both.withColumn("ratio", ratio)
    named = F.concat_ws(" ", "key", "label")
    inferred, has_text = F.col("inferred"), F.col("mean_length").isNotNull()
    identifier = F.col("label").rlike(ID_LABEL) | ((F.col("n_present") >= 10) & (ratio >= 0.9) & (F.col("mean_length") <= 80))
    few = (F.col("n_distinct") <= 20) & ((F.col("n_present") <= 10) | (ratio <= 0.5))
    role = (
        F.when(inferred == "empty", "unknown")
        .when(inferred == "boolean", "boolean_flag")
        .when(inferred.isin(TEMPORAL), "time_period")
        .when(named.rlike(ID_LABEL), "identifier")
        .when(inferred.isin(NUMERIC), "metric")
        .when(has_text & identifier, "identifier")
        .when(has_text & (F.col("mean_length") >= 80), "free_text")
        .when(has_text & few, "category")
        .when(named.rlike(METRIC_LABEL) & (F.col("n_present") > 0), "metric")
        .when((inferred == "string") | (ratio < 1), "dimension")
        .otherwise("unknown")
    )
    fits = F.when(inferred == "empty", True).when(F.col("declared") == "number", inferred.isin(NUMERIC)).when(F.col("declared") == "boolean", inferred == "boolean").when(F.col("declared") == "date", inferred.isin(TEMPORAL)).when(F.col("declared") == "string", inferred.isin("string", *TEMPORAL)).otherwise(False)
    share = lambda c: F.when(F.col("n_present") > 0, F.col(c) / F.col("n_present")).otherwise(0.0)
    partly = lambda c: (share(c) > 0) & (share(c) < 0.9)
    warnings = F.array_compact(F.array(F.when(inferred == "mixed", "mixed_value_types"), F.when(~fits, "declared_type_mismatch"), F.when(partly("n_numeric"), "partially_numeric"), F.when(partly("n_temporal"), "partially_temporal")))
    return both.select(*by, "key", "label", "declared", "n_cells", "n_present", (F.col("n_cells") - F.col("n_present")).alias("n_missing"), "n_distinct", rounded(F.col("ratio")).alias("distinct_ratio"), "inferred", "confidence", role.alias("role"), F.array_join(warnings, ",").alias("warnings"))


def row_features(table_cells: DataFrame) -> DataFrame:
    """Per table: rows, repeated rows, rows that repeat the header (60 % of at least 2 cells), rows with totals and with footnotes."""
    text, present = collapse("raw"), ~is_missing("raw")
    is_header = present & F.lower(text).isin(F.lower(collapse("key")), F.lower(collapse("label")))
    digest = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("col_no", "raw")))), 256)
    rows = table_cells.groupBy("table_id", "row_no").agg(F.count_if(present).alias("present"), F.count_if(is_header).alias("header"), F.coalesce(F.bool_or(present & text.rlike(TOTAL)), F.lit(False)).alias("total"), F.coalesce(F.bool_or(present & text.rlike(FOOTNOTE)), F.lit(False)).alias("footnote"), digest.alias("digest"))
    return rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("digest")).alias("duplicates"), F.count_if((F.col("present") >= 2) & (F.col("header") / F.col("present") >= 0.6)).alias("headers"), F.count_if("total").alias("totals"), F.count_if("footnote").alias("footnotes"))


def table_profiles(tables: DataFrame) -> DataFrame:
    """One row per table: orientation, quality score (0 to 1), warnings and whether it suits analysis."""
    seen = observed(cells(tables))
    columns = column_profiles(seen)
    columns = columns.withColumn("header", parse_period("label", "label"))
    numeric = F.col("inferred").isin(NUMERIC)
    is_period = F.col("header.format").isNotNull()
    shape = columns.groupBy("table_id").agg(
        F.count("*").alias("n_columns"), F.sum("n_missing").alias("missing"), F.count_if(is_period).alias("period_headers"), F.count_if(numeric).alias("numeric"), F.count_if(F.col("inferred").isin("string", "mixed")).alias("textual"), F.count_if(F.col("inferred") == "mixed").alias("mixed"),
        F.count_if(F.col("warnings").contains("declared_type_mismatch")).alias("mismatched"), F.count_if(F.col("n_present") > 0).alias("informative"), F.count_if(numeric & F.col("label").rlike(METRIC_LABEL)).alias("metric_headers"), F.min_by("role", "col_no").alias("first_role"),
    )
    first = seen.where("col_no = 0 AND o IS NOT NULL").groupBy("table_id").agg(F.avg(F.when(F.col("o.display").rlike(METRIC_LABEL), 1.0).otherwise(0.0)).alias("metric_rows"))
    pages = tables.groupBy("table_id").agg(F.max_by(F.struct((F.col("page_end") > F.col("page_start")).alias("long"), F.size("source_fragments").alias("parts")), F.struct("updated_at", "title")).alias("p"))
    t = shape.join(row_features(seen), "table_id").join(first, "table_id", "left").join(pages, "table_id", "left").fillna(0.0, ["metric_rows"])
    axis = F.col("first_role").isin("category", "dimension", "identifier")
    orientation = (
        F.when(F.col("period_headers") >= 2, "wide_time_series")
        .when((F.col("n_columns") >= 3) & (F.col("metric_rows") >= 0.5), "transposed")
        .when((F.col("totals") > 0) & (F.col("n_rows") <= 15), "summary")
        .when((F.col("n_columns") == 2) & (F.col("metric_rows") >= 0.35) & axis, "key_value")
        .when((F.col("numeric") == 0) & (F.col("textual") == F.col("n_columns")), "primarily_textual")
        .when(F.coalesce("p.long", F.lit(False)) | (F.col("p.parts") > 1), "continuation")
        .when((F.col("n_columns") >= 3) & (F.col("numeric") >= 2) & axis & (F.col("metric_headers") < F.col("numeric")), "matrix")
        .otherwise("ordinary_records")
    )
    t = t.withColumn("orientation", orientation).withColumn("missing_ratio", F.col("missing") / (F.col("n_rows") * F.col("n_columns")))
    lost = lambda cond, cap, part: F.when(cond, F.least(F.lit(cap), part)).otherwise(0.0)
    score = (
        1.0
        - lost(F.col("missing_ratio") >= 0.3, 0.35, F.col("missing_ratio") * 0.4)
        - lost(F.col("duplicates") > 0, 0.2, F.col("duplicates") / F.col("n_rows") * 0.25)
        - lost(F.col("mixed") > 0, 0.2, F.col("mixed") / F.col("n_columns") * 0.2)
        - lost(F.col("mismatched") > 0, 0.15, F.col("mismatched") / F.col("n_columns") * 0.15)
        - lost(F.col("headers") > 0, 0.1, F.col("headers") / F.col("n_rows") * 0.15)
        - F.when(F.col("informative") == 0, 0.5).otherwise(0.0)
        - F.when(F.col("orientation") == "primarily_textual", 0.1).otherwise(0.0)
    )
    score = rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return t.select("table_id", "n_rows", "n_columns", "duplicates", "headers", "totals", "footnotes", "orientation", score.alias("quality"), ((F.col("informative") > 0) & (score >= 0.45)).alias("suitable"))
