"""How well a text covers what a question names: phrases, acronyms, concepts with variants, years and units.

A text is prepared once - its tokens, their roots, its initials and its acronyms - and compared with
prepared phrases by array functions, so matching stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.text import clean_term, col, root, signal
from tabulae.session import checkpoint

# What an acronym looks like (the capital is asked for first, as that is cheap), and the words that its expansion skips.
COMPOUND_ACRONYM = r"(?=[A-Z])\b[A-Z]{1,6}(?:\s*[&/.-]\s*[A-Z]{1,6})+\b"
ACRONYM = r"(?=[A-Z])\b[A-Z]{2,8}\b"
CONNECTORS = ("a", "an", "and", "of", "the")
# How strong a match in sequence, by acronym and in order with gaps is, and how many words the gaps may hold.
STRENGTHS = (1.0, 0.95, 0.82)
GAP = 6


def raw_tokens(c: Column | str) -> Column:
    """The words of a text as they stand; underscores part words."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def acronyms(c: Column | str) -> Column:
    """The acronyms that a text writes out, in lower case: capitals in a row, or joined by signs."""
    text = F.coalesce(col(c), F.lit(""))
    joined = F.transform(F.regexp_extract_all(text, F.lit(COMPOUND_ACRONYM), F.lit(0)), lambda a: F.regexp_replace(a, "[^A-Z]", ""))
    found = F.transform(F.concat(joined, F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0))), F.lower)
    return F.array_distinct(F.filter(found, lambda a: F.char_length(a).between(2, 8)))


def initials(words: Column) -> Column:
    """The first letters of all words but connectors, in lower case."""
    return F.array_join(F.transform(F.filter(words, lambda t: ~F.lower(t).isin(*CONNECTORS)), lambda t: F.substring(F.lower(t), 1, 1)), "")


def prepared(c: Column | str) -> Column:
    """What matching needs of a text or phrase: ``words``, ``roots``, ``joined`` (the roots as one string), ``letters`` (whether a word is one capital letter), ``initials`` (of all words but connectors) and ``acronyms``."""
    words = raw_tokens(c)
    roots = F.transform(words, root)
    letter = lambda t: (F.char_length(t) == 1) & (F.lower(t) != t)
    return F.struct(words.alias("words"), roots.alias("roots"), F.concat(F.lit(" "), F.array_join(roots, " "), F.lit(" ")).alias("joined"), F.exists(words, letter).alias("letters"), initials(words).alias("initials"), acronyms(c).alias("acronyms"))


def same_word(phrase: Column, i: Column, text: Column, j: Column) -> Column:
    """Whether word ``i`` of a phrase is word ``j`` of a text (from 0): one capital letter stands for itself, other words for their root."""
    word = F.get(phrase["words"], i)
    alike = F.get(phrase["roots"], i) == F.get(text["roots"], j)
    return alike & (~phrase["letters"] | (F.char_length(word) > 1) | (F.lower(word) == word) | (word == F.get(text["words"], j)))


def _places(text: Column) -> Column:
    return F.sequence(F.lit(0), F.size(text["words"]) - 1)


def contiguous(phrase: Column, text: Column) -> Column:
    """Whether the words of a phrase follow each other in a text (both prepared); phrases without single capitals are looked up as a string."""
    at = lambda i: F.forall(_places(phrase), lambda k: F.coalesce(same_word(phrase, k, text, i + k), F.lit(False)))
    found = (F.size(phrase["words"]) > 0) & F.contains(text["joined"], phrase["joined"])
    return F.when(found & phrase["letters"], F.exists(_places(text), at)).otherwise(found)


def ordered_near(phrase: Column, text: Column, gap: int = GAP) -> Column:
    """Whether the words of a phrase of two or more come in order in a text, from its first on within ``gap`` more words than it has."""
    n = F.size(phrase["words"])

    def met(i: Column) -> Column:
        behind = F.sequence(i + 1, F.least(F.size(text["words"]), i + n + gap) - 1)
        k = F.aggregate(behind, F.lit(1), lambda k, j: F.when((k < n) & F.coalesce(same_word(phrase, k, text, j), F.lit(False)), k + 1).otherwise(k))
        return F.when(i + 1 < F.size(text["words"]), k == n).otherwise(False)

    # whether all roots are there at all is cheap to tell
    fits = (n >= 2) & (n <= F.size(text["words"])) & F.forall(phrase["roots"], lambda r: F.contains(text["joined"], F.concat(F.lit(" "), r, F.lit(" "))))
    return F.when(fits, F.exists(_places(text), lambda i: F.when(same_word(phrase, F.lit(0), text, i), met(i)).otherwise(False))).otherwise(False)


def acronym_match(a: Column, b: Column) -> Column:
    """Whether one of two prepared texts writes an acronym whose letters begin words in a row of the other."""
    spelt = lambda x, y: F.exists(x["acronyms"], lambda s: F.contains(y["initials"], s))
    return spelt(a, b) | spelt(b, a)


def strength(phrase: Column, text: Column) -> Column:
    """1 if a phrase's words follow each other in a text, 0.95 if one spells out an acronym of the other, 0.82 if they come in order nearby, else 0; both prepared. Empty phrases and texts have 0."""
    some = (F.size(phrase["words"]) > 0) & (F.size(text["words"]) > 0)
    row, short, near = STRENGTHS
    return F.when(some & contiguous(phrase, text), row).when(some & acronym_match(phrase, text), short).when(some & ordered_near(phrase, text), near).otherwise(0.0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row; a column of its own would be copied by the optimizer to every place that reads it, lambdas and filters included."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def joined_roots(c: Column | str) -> Column:
    """``joined`` of ``prepared`` by patterns over the whole text instead of word by word."""
    words = F.lower(F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)[\W_]+", " "), F.lit(" ")))
    singular = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), r"ies(?= )(?<=[^ ]{2}ies)", "y")
    return F.regexp_replace(singular, r"s(?= )(?<=[^ ]{3}[^ s]s)", "")


def with_terms(rows: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """Candidates beside what ``matched`` needs of their request, joined by ``by``: ``_concepts``, the prepared terms of its concepts with ``sought``, their roots as they stand in a text, and ``_starts``, the initials of all."""
    sought = lambda p: F.transform(F.array_sort(F.transform(p["roots"], lambda r: F.struct((-F.char_length(r)).alias("n"), F.concat(F.lit(" "), r, F.lit(" ")).alias("r")))), lambda x: x["r"])
    fields = ("words", "roots", "joined", "letters", "initials", "acronyms")
    term = lambda t: once(prepared(t), lambda p: F.struct(*(p[f].alias(f) for f in fields), sought(p).alias("sought")))
    ready = asked.select(by, F.transform("concept_terms", lambda c: F.transform(c, term)).alias("_concepts"))
    starts = F.array_join(F.transform(F.flatten("_concepts"), lambda p: p["initials"]), " ")
    return rows.join(ready.select(by, "_concepts", starts.alias("_starts")), by)


def matched(concepts: Column, starts: Column, text: Column) -> Column:
    """For each concept 1 if a term of it has a ``strength`` above 0 in a text (null is empty), else 0; ``concepts`` and ``starts`` by ``with_terms``.

    A text without all roots of a term holds it by an acronym or not at all, so its words are only
    parted where the roots are there but do not follow each other.
    """

    def held(p: Column, t: Column) -> Column:
        there = (F.size(p["words"]) > 0) & F.forall(p["sought"], lambda r: F.contains(t["joined"], r))
        parted = once(raw_tokens(text), lambda w: F.struct(w.alias("words"), F.transform(w, root).alias("roots"), t["joined"].alias("joined")))
        in_order = (~p["letters"] & F.contains(t["joined"], p["joined"])) | once(parted, lambda x: contiguous(p, x) | ordered_near(p, x))
        spelt = F.exists(t["acronyms"], lambda a: F.contains(p["initials"], a))
        writes = F.when(F.size(p["acronyms"]) > 0, F.exists(p["acronyms"], lambda a: F.contains(initials(raw_tokens(text)), a))).otherwise(False)
        return F.when(there, in_order).otherwise(False) | spelt | writes

    ready = F.struct(joined_roots(text).alias("joined"), F.filter(acronyms(text), lambda a: F.contains(starts, a)).alias("acronyms"))
    return once(ready, lambda t: F.transform(concepts, lambda terms: F.exists(terms, lambda p: held(p, t)).cast("int")))


def strengths_of(rows: DataFrame, text: str, phrases: list[str], out: str = "strengths") -> DataFrame:
    """``rows`` with the array ``out``: the strength of each of a few phrases in the row's text; nulls are empty texts.

    The phrases are prepared once, by the same expressions, when the plan is made.
    """
    spark = rows.sparkSession
    ready = spark.createDataFrame([(p,) for p in phrases], "p string").select(prepared("p").alias("p")).collect()
    literal = lambda p: F.struct(*(_array(p[f]).alias(f) for f in ("words", "roots")), *(F.lit(p[f]).alias(f) for f in ("joined", "letters", "initials")), _array(p["acronyms"]).alias("acronyms"))
    seen = rows.withColumn("_prepared", prepared(text))
    return seen.withColumn(out, F.array(*(strength(literal(r["p"]), F.col("_prepared")) for r in ready))).drop("_prepared")


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def distinct_signals(values: Column) -> Column:
    """The cleaned entries of an array in order, without blank ones and repeats that normalise alike."""
    cleaned = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_term), lambda v: F.coalesce(signal(v), F.lit("")) != "")
    return F.aggregate(cleaned, F.array().cast("array<string>"), lambda kept, v: F.when(F.exists(kept, lambda k: signal(k) == signal(v)), kept).otherwise(F.array_append(kept, v)))


def concepts_of(values: Column, fallback: Column) -> Column:
    """Concepts as arrays of terms: each (``canonical``, ``variants``) with its cleaned variants, then the fallback terms that no concept covers."""
    whole = F.transform(F.coalesce(values, F.array().cast("array<struct<canonical:string,variants:array<string>>>")), lambda v: F.when(F.coalesce(clean_term(v["canonical"]), F.lit("")) != "", distinct_signals(F.concat(F.array(v["canonical"]), F.coalesce(v["variants"], F.array().cast("array<string>"))))))
    whole = F.array_compact(whole)
    covered = F.transform(F.flatten(whole), signal)
    rest = F.filter(distinct_signals(fallback), lambda t: ~F.array_contains(covered, signal(t)))
    return F.concat(whole, F.transform(rest, lambda t: F.array(t)))


def clean_periods(values: Column) -> Column:
    """Years and ranges without a leading FY, each once."""
    return distinct_signals(F.transform(values, lambda v: F.regexp_replace(v, r"(?i)\bfy\s*(?=(?:19|20)\d{2})", "")))


# How a question names periods and units.
PERIOD_NAMED = r"(?i)\b(?:fy\s*)?(?:19|20)\d{2}(?:\s*[-–/]\s*(?:\d{2}|(?:19|20)\d{2}))?\b"
UNIT_NAMED = r"(?i)(?:₹|\$|€|£|%|\b(?:inr|usd|eur|gbp|crores?|lakhs?|millions?|billions?|thousands?|percent(?:age)?)\b)"


def named_in(query: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(query), F.lit("")), F.lit(pattern), F.lit(0))


def signals(requests: DataFrame) -> DataFrame:
    """``requests`` with the arrays ``concept_terms``, ``year_terms`` and ``unit_terms`` that candidates are scored by.

    ``requests``: ``query``, ``concepts`` (array of ``canonical``, ``variants``), ``metrics``, ``entities``,
    ``years``, ``units``. Metrics and entities count as concepts unless one covers them; years and units
    that the query names are added to those given.
    """
    none = F.array().cast("array<string>")
    given = lambda c: F.coalesce(F.col(c), none)
    return requests.select("*", concepts_of(F.col("concepts"), F.concat(given("metrics"), given("entities"))).alias("concept_terms"), clean_periods(F.concat(given("years"), named_in("query", PERIOD_NAMED))).alias("year_terms"), distinct_signals(F.concat(given("units"), named_in("query", UNIT_NAMED))).alias("unit_terms"))


def with_signals(rows: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """Candidates beside the prepared signals of their request, joined by ``by``: ``concept_terms``, ``year_terms``, ``unit_terms`` as prepared phrases."""
    ready = asked.select(by, F.transform("concept_terms", lambda c: F.transform(c, prepared)).alias("_concepts"), F.transform("year_terms", prepared).alias("_years"), F.transform("unit_terms", prepared).alias("_units"))
    return rows.join(ready, by)


def concept_strengths(concepts: Column, text: Column) -> Column:
    """For each concept the greatest strength of its terms in a prepared text."""
    return F.transform(concepts, lambda terms: F.coalesce(F.array_max(F.transform(terms, lambda t: strength(t, text))), F.lit(0.0)))


def signal_coverage(terms: Column, text: Column) -> Column:
    """The mean strength of the terms in a prepared text; 0 without terms."""
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + strength(t, text))
    return F.when(F.size(terms) > 0, total / F.size(terms)).otherwise(0.0)


def specificities(rows: DataFrame, by: str, strengths: Column | str = "strengths") -> DataFrame:
    """``by`` and ``specificity``, per concept 0.25 + 0.75 * (n - df) / (n - 1) over the candidates of a request; 1 for a lone candidate.

    Counted per task before the shuffle, so a request with most of the rows is no hot spot. Dear
    ``strengths`` that are not written yet are given as an expression: for the explosion of a column
    the optimizer adds a filter that works it out once more.
    """
    counted = rows.select(by, F.posexplode(strengths).alias("pos", "s")).groupBy(by, "pos").agg(F.count("*").alias("n"), F.count_if(F.col("s") > 0).alias("df"))
    weight = F.when(F.col("n") <= 1, 1.0).otherwise(0.25 + 0.75 * (F.col("n") - F.col("df")) / (F.col("n") - 1))
    return counted.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", weight.alias("w")))), lambda x: x["w"]).alias("specificity"))


def concept_coverage(strengths: Column, specificity: Column) -> Column:
    """min(1, sum of specificity times strength over the number of concepts); 0 without concepts."""
    total = F.aggregate(F.zip_with(strengths, specificity, lambda s, w: s * w), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return F.when(F.size(strengths) > 0, F.least(F.lit(1.0), total / F.size(strengths))).otherwise(0.0)


# Weights of the parts of a text's and a table's relevance.
TEXT_WEIGHTS = {"rrf_part": 0.45, "concept": 0.40, "year": 0.06, "unit": 0.02, "consensus": 0.07}
TABLE_WEIGHTS = {"rrf_part": 0.36, "concept": 0.36, "schema": 0.16, "year": 0.05, "unit": 0.02, "consensus": 0.05}


def agreement(modes: Column, queries: Column, query_count: Column) -> Column:
    """How far modes and queries agree on a candidate, at 9 digits."""
    return F.round(0.35 * modes / 2 + 0.65 * F.least(F.lit(1.0), queries / F.greatest(F.lit(1), query_count)), 9)


def agreement_spread(rows: DataFrame, by: str, modes: Column, queries: Column, query_count: Column) -> DataFrame:
    """Per group ``n_candidates``, ``n_levels`` (different values of agreement) and ``most``, the greatest.

    Agreement takes few values, so these come from counts per value; no candidate meets another.
    """
    counts = rows.select(by, agreement(modes, queries, query_count).alias("raw")).groupBy(by, "raw").agg(F.count("*").alias("_ties"))
    return counts.groupBy(by).agg(F.sum("_ties").alias("n_candidates"), F.count("raw").alias("n_levels"), F.max("raw").alias("most"))


def consensus(rows: DataFrame, by: str, modes: Column, queries: Column, query_count: Column) -> DataFrame:
    """Rows with ``raw`` agreement of modes and queries and ``consensus``, its percentile among the group lowered by ties; 0 for a lone row.

    Agreement takes few values, so places come from counts per value, not from sorting the group.
    """
    marked = rows.withColumn("raw", agreement(modes, queries, query_count))
    counts = marked.groupBy(by, "raw").agg(F.count("*").alias("_ties"))
    w = W.partitionBy(by)
    below = F.coalesce(F.sum("_ties").over(w.orderBy("raw").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(by).alias("_by"), F.col("raw").alias("_raw"), "_ties", below.alias("_below"), F.sum("_ties").over(w).alias("_n"))
    met = marked.join(counts, F.col(by).eqNullSafe(F.col("_by")) & F.col("raw").eqNullSafe(F.col("_raw")))
    share = F.col("_below") / (F.col("_n") - 1) * (F.col("_n") - F.col("_ties") + 1) / F.col("_n")
    return met.withColumn("consensus", F.when(F.col("_n") <= 1, 0.0).otherwise(F.round(share, 6))).drop("_by", "_raw", "_ties", "_below", "_n")


def scored(rows: DataFrame, asked: DataFrame, by: str, text: str, weights: dict[str, float] = TEXT_WEIGHTS, schema: str | None = None) -> DataFrame:
    """Candidates with the parts of their relevance and ``relevance``, their weighted sum at 6 digits.

    ``rows``: ``by``, ``text``, ``rrf``, ``n_modes``, ``n_queries`` and, for tables, ``schema``, the text of
    its columns; ``asked``: ``by``, the signals (see ``signals``) and ``query_count``. Null texts cover nothing; the texts themselves are not in the result.
    """
    counts = asked.select(by, F.greatest(F.lit(1), "query_count").alias("_count"))
    fused = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("rrf", F.lit(0.0))) / (2 * F.col("_count") / 61))
    agreed = consensus(rows.join(counts, by).withColumn("rrf_part", F.bround(fused, 6)), by, F.col("n_modes"), F.col("n_queries"), F.col("_count"))
    both = with_signals(agreed, asked, by).withColumn("_text", prepared(text)).withColumn("strengths", concept_strengths(F.col("_concepts"), F.col("_text")))
    both = both.withColumn("year", F.bround(signal_coverage(F.col("_years"), F.col("_text")), 6)).withColumn("unit", F.bround(signal_coverage(F.col("_units"), F.col("_text")), 6))
    if schema:
        both = both.withColumn("_schema", prepared(schema)).withColumn("_on_schema", concept_strengths(F.col("_concepts"), F.col("_schema")))
    # written once: matching is the dear part, and the specificities read all of it before the first row is scored
    both = checkpoint(both.drop("_text", "_schema", "_concepts", "_years", "_units", text, *([schema] if schema else [])))
    both = both.join(specificities(both, by), by, "left").withColumn("concept", F.bround(concept_coverage(F.col("strengths"), F.col("specificity")), 6))
    if schema:
        both = both.withColumn("schema", F.bround(concept_coverage(F.col("_on_schema"), F.col("specificity")), 6)).drop("_on_schema")
    total = reduce(Column.__add__, (F.lit(w) * F.col(c) for c, w in weights.items()))
    return both.withColumn("relevance", F.bround(total, 6)).drop("strengths", "specificity", "_count", "raw")
