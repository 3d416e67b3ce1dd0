"""Table matrices: shaping, measures of quality, duplicates and overlapping regions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulae.functions.text import is_missing, jaccard, phrase_words


def rectangular(rows: Column) -> Column:
    """A matrix whose short rows are filled up to the widest with empty texts."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def unique_keys(keys: DataFrame, by: str, key: str, pos: str) -> DataFrame:
    """Keys with a suffix _2, _3 on later repeats within a table."""
    n = F.row_number().over(W.partitionBy(by, key).orderBy(pos))
    return keys.withColumn("unique_key", F.when(n > 1, F.concat(F.col(key), F.lit("_"), n)).otherwise(F.col(key)))


def measured(table_cells: DataFrame) -> DataFrame:
    """Per table: cells, populated share, number columns whose cells are numbers, and empty columns."""
    present = ~is_missing("raw")
    numeric = F.col("raw").rlike(r"^\s*\(?[-+]?[^\p{L}]*\d[\d,.]*[^\p{L}]*\)?\s*$")
    per = table_cells.groupBy("table_id", "col_no").agg(F.count("*").alias("n"), F.count_if(present).alias("present"), F.count_if(present & numeric).alias("numeric"), F.first("declared").alias("declared"))
    share = F.when(F.col("present") > 0, F.greatest(F.col("numeric"), F.col("present") - F.col("numeric")) / F.col("present")).otherwise(0.0)
    return per.groupBy("table_id").agg(F.sum("n").alias("cells"), F.round(F.sum("present") / F.sum("n"), 6).alias("populated"), F.round(F.avg(share), 6).alias("consistency"), F.count_if(F.col("present") == 0).alias("empty_columns"), F.count("*").alias("n_columns"))


def judged(measures: DataFrame, least: float = 0.7, poor: float = 0.55) -> DataFrame:
    """``accepted``, ``quarantined`` or ``rejected`` with the reasons, from density, consistency and shape."""
    score = F.round(0.25 * F.least(F.lit(1.0), F.col("n_columns") / 2) + 0.40 * F.col("populated") + 0.35 * F.col("consistency") - 0.10 * F.col("empty_columns") / F.col("n_columns"), 4)
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("n_columns") < 2, "too_few_columns"), F.when(F.col("populated") < 0.5, "sparse"), F.when(F.col("consistency") < 0.7, "inconsistent"), F.when(F.col("empty_columns") > 0, "empty_columns"))), ",")
    status = F.when(score >= least, "accepted").when(score >= poor, "quarantined").otherwise("rejected")
    return measures.select("table_id", score.alias("score"), status.alias("status"), reasons.alias("reasons"))


def box_overlap(a: Column, b: Column) -> Column:
    """Overlap of two boxes (left, top, right, bottom) as a share of the smaller; 0 for null or empty boxes."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    least = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(a.isNull() | b.isNull() | (F.size(a) < 4) | (F.size(b) < 4), 0.0).when(least > 0, w * h / least).otherwise(0.0)


def region_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """The greatest overlap of the regions of two records of one document on one page: ``left_id``, ``right_id``, ``overlap``.

    Both sides: ``document_id``, ``id``, ``page``, ``box``. Joined by document and page.
    """
    met = left.select("document_id", "page", F.col("id").alias("left_id"), F.col("box").alias("a")).join(right.select("document_id", "page", F.col("id").alias("right_id"), F.col("box").alias("b")), ["document_id", "page"])
    return met.groupBy("left_id", "right_id").agg(F.round(F.max(box_overlap(F.col("a"), F.col("b"))), 6).alias("overlap"))


def duplicate_tables(tables: DataFrame) -> DataFrame:
    """Pairs of tables of one document on common pages with like columns (0.8) and titles (0.75), lower id first.

    ``tables``: ``document_id``, ``table_id``, ``title``, ``keys``, ``page_start``, ``page_end``. Pages are written
    out, so tables meet by document and page; a page holds few tables.
    """
    spread = tables.select("document_id", "table_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page"), phrase_words("title").alias("words"), F.col("keys"))
    other = spread.select("document_id", "page", *(F.col(c).alias(f"other_{c}") for c in ("table_id", "words", "keys")))
    met = spread.join(other, ["document_id", "page"]).where("table_id < other_table_id").where((jaccard(F.col("keys"), F.col("other_keys")) >= 0.8) & (jaccard(F.col("words"), F.col("other_words")) >= 0.75))
    return met.select("table_id", F.col("other_table_id").alias("duplicate_id")).distinct()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts by their longest matching blocks; null texts are empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def continued_fragments(fragments: DataFrame) -> DataFrame:
    """``chain``, the first fragment of the run of pages that a fragment continues: same document, next page, same number of columns, like headers (0.78).

    ``fragments``: ``document_id``, ``fragment_id``, ``page``, ``header`` (text), ``n_columns``.
    """
    w = W.partitionBy("document_id").orderBy("page", "fragment_id")
    near = fragments.select("*", *(F.lag(c).over(w).alias(f"_{c}") for c in ("page", "header", "n_columns")))
    near = near.withColumn("_ratio", sequence_ratio("header", "_header"))
    goes_on = (F.col("page") == F.col("_page") + 1) & (F.col("n_columns") == F.col("_n_columns")) & (F.col("_ratio") >= 0.78)
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    near = near.withColumn("_run", run)
    return near.select("document_id", "fragment_id", "page", F.first("fragment_id").over(W.partitionBy("document_id", "_run").orderBy("page", "fragment_id")).alias("chain"))


def visual_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words with ``row_no``, their visual row from the top of the page: a word joins the row whose mean height is within the tolerance.

    ``words``: ``page_id``, ``word_id``, ``x``, ``y``. A page's words are few; each page is one group.
    """

    def rows_of(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x", "word_id"])
        total, count, row, out = 0.0, 0, -1, []
        for y in page.y:
            if count and abs(y - total / count) <= tolerance:
                total, count = total + y, count + 1
            else:
                total, count, row = y, 1, row + 1
            out.append(row)
        return page.assign(row_no=out)[["page_id", "word_id", "row_no"]]

    return words.where("x IS NOT NULL AND y IS NOT NULL").select("page_id", "word_id", "x", "y").groupBy("page_id").applyInPandas(rows_of, "page_id string, word_id string, row_no int")


def column_anchors(words: DataFrame, tolerance: float = 9.0, least_rows: int = 2) -> DataFrame:
    """Columns of a page: left edges clustered with a running mean, kept if they occur in ``least_rows`` rows: ``page_id``, ``anchor``, ``n_rows``."""

    def anchors(page: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for x, row in sorted(zip(page.x, page.row_no)):
            if found and abs(x - found[-1][0] / found[-1][1]) <= tolerance:
                found[-1][0] += x
                found[-1][1] += 1
                found[-1][2].add(row)
            else:
                found.append([x, 1, {row}])
        kept = [(round(s / n, 3), len(rows)) for s, n, rows in found if len(rows) >= least_rows]
        return pd.DataFrame({"page_id": [page.page_id.iloc[0]] * len(kept), "anchor": [k[0] for k in kept], "n_rows": [k[1] for k in kept]})

    return words.groupBy("page_id").applyInPandas(anchors, "page_id string, anchor double, n_rows int")
