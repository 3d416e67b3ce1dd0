"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that stand for a missing value.
MISSING = ["", "-", "--", "—", "–", "n/a", "na", "n.m.", "nm", "nil", "none", "null", "not available"]
# Words for currencies and scales inside a number's text.
CURRENCY_OR_SCALE = r"(?i)(₹|\$|€|£|\b(?:usd|inr|eur|gbp|crores?|lakhs?|millions?|billions?|thousands?|mn|bn|k)\b)"
# Units by order of precedence.
CURRENCY_NAMES = ((r"(?i)₹|\binr\b", "INR"), (r"(?i)\$|\busd\b", "USD"), (r"(?i)€|\beur\b", "EUR"), (r"(?i)£|\bgbp\b", "GBP"))
SCALE_NAMES = ((r"(?i)\b(?:billion|billions|bn)\b", "billion"), (r"(?i)\b(?:million|millions|mn)\b", "million"), (r"(?i)\b(?:thousand|thousands|k)\b", "thousand"), (r"(?i)\b(?:crore|crores)\b", "crore"), (r"(?i)\b(?:lakh|lakhs)\b", "lakh"))
LEXICAL = r"(?U)[^\W_]+(?:[.\-'’][^\W_]+)*"
#: Words that a phrase comparison leaves out.
PHRASE_STOPS = ["a", "an", "and", "by", "for", "from", "in", "of", "on", "the", "to", "with"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White space collapsed to single blanks and trimmed; null stays null."""
    return F.btrim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def is_missing(c: Column | str) -> Column:
    """Whether a cell is null or a marker of a missing value."""
    return col(c).isNull() | F.lower(collapse(c)).isin(MISSING)


def signal(c: Column | str) -> Column:
    """Text for matching: lower case, symbols spelled out, everything that is no word a blank. Of compatibility forms only raised digits are resolved."""
    s = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "¹²³", "123")
    for symbol, word in (("_", " "), ("&", " and "), ("₹", " inr "), ("$", " usd "), ("€", " eur "), ("£", " gbp "), ("%", " percent ")):
        s = F.replace(s, F.lit(symbol), F.lit(word))
    return F.btrim(F.regexp_replace(s, r"(?U)[^\w]+", " "))


def clean_term(c: Column | str) -> Column:
    """Collapsed text without blanks and light punctuation around it."""
    return F.btrim(collapse(c), F.lit(" .,:;"))


def lexical_terms(c: Column | str) -> Column:
    """The terms of a text, in order and in lower case; compounds with inner dots, hyphens and apostrophes are one term."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(LEXICAL), F.lit(0))


def root(c: Column) -> Column:
    """A token in lower case without its plural ending."""
    t = F.lower(c)
    long = F.char_length(t) > 4
    return F.when(long & t.endswith("ies"), F.concat(F.regexp_replace(t, "ies$", ""), F.lit("y"))).when(long & t.endswith("s") & ~t.endswith("ss"), F.regexp_replace(t, "s$", "")).otherwise(t)


def phrase(c: Column | str) -> Column:
    """ASCII words of a text in lower case, with ``&`` as ``and`` and two common short forms spelled out."""
    s = F.replace(F.lower(clean_term(F.coalesce(col(c), F.lit("")))), F.lit("&"), F.lit(" and "))
    s = F.array_join(F.regexp_extract_all(s, F.lit(r"[a-z0-9]+"), F.lit(0)), " ")
    return F.regexp_replace(F.regexp_replace(s, r"\br and d\b", "research and development"), r"\bsg and a\b", "selling general and administrative")


def phrase_words(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(phrase(c), " "), lambda t: (t != "") & ~t.isin(PHRASE_STOPS)))


def lexical_score(wanted: Column | str, given: Column | str) -> Column:
    """Likeness of two labels from 0 to 1: 1 for equal phrases, up to 0.89 if all wanted words are given, else up to 0.79."""
    a, b, x, y = phrase(wanted), phrase(given), phrase_words(wanted), phrase_words(given)
    common = F.size(F.array_intersect(x, y))
    contained, jaccard = common / F.size(x), common / F.size(F.array_union(x, y))
    partial = F.when(contained == 1, F.least(F.lit(0.89), 0.76 + 0.13 * jaccard)).otherwise(F.least(F.lit(0.79), 0.60 * contained + 0.30 * jaccard))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(common == 0, 0.0).otherwise(partial)


def display_name(c: Column | str) -> Column:
    """The last part of a path without a known extension."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^.*/", ""), r"(?i)\.(pdf|docx|xlsx|xls|csv)$", "")


def detect_unit(c: Column | str) -> Column:
    """``percent``, or a currency and a scale as far as the text names them; null if neither."""
    s = col(c)

    def first(patterns):
        made = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, name in patterns:
            made = made.when(s.rlike(pattern), name)
        return made

    both = F.array_join(F.array_compact(F.array(first(CURRENCY_NAMES), first(SCALE_NAMES))), " ")
    return F.when(s.contains("%") | s.rlike(r"(?i)\bpercent(age)?\b"), "percent").otherwise(F.nullif(both, F.lit("")))


def key_for_label(c: Column | str) -> Column:
    """A column key: lower snake case of at most 64 characters; keys that start with a digit get a prefix."""
    s = F.btrim(F.regexp_replace(F.lower(collapse(c)), r"[^a-z0-9]+", "_"), F.lit("_"))
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("column_"), s)).otherwise(s)
    return F.substring(F.when(s == "", "column").otherwise(s), 1, 64)


def distinct_ignoring_case(c: Column | str) -> Column:
    """An array's non-blank texts, collapsed, without later repeats that differ only in case."""
    cleaned = F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: collapse(x)), lambda x: x.isNotNull() & (x != ""))
    return F.aggregate(cleaned, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def shingles(c: Column | str, size: int = 3) -> Column:
    """The distinct runs of ``size`` words of a text; a shorter text is one run, an empty one none."""
    words = F.filter(F.split(signal(c), " "), lambda t: t != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def uuid5(namespace_hex: str, name: Column | str) -> Column:
    """The version-5 UUID of a name in a namespace (32 hex digits)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(col(name), "UTF-8")))
    variant = F.lower(F.hex(F.shiftright(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128)), 0)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def collapse_nbsp(c: Column | str) -> Column:
    """Collapsed text in which non-breaking blanks are blanks."""
    return collapse(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\u00a0"), F.lit(" ")))


# Words of a heading's frame that say nothing about its topic.
HEADING_FRAME = r"\b(?:chapter|section|part|unit|lesson|module|appendix|figure|table|the|a|an|of|and|in|on|for|to|introduction|overview)\b"


def heading(c: Column | str) -> Column:
    """A heading in lower case without numbering, frame words and punctuation."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"^\s*\d+(?:\.\d+)*[.)]?\s+", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, HEADING_FRAME, " "), r"[^\p{L}\p{N}]+", " "), r" +", " "))


def truncate(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters: longer texts are cut at the last blank before it and end in an ellipsis."""
    s = collapse(c)
    cut = F.substring(s, 1, limit - 1)
    word = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(F.char_length(s) <= limit, s).otherwise(F.concat(F.rtrim(word), F.lit("…")))


def extracted_unit(c: Column | str) -> Column:
    """The unit that a header names at extraction: a currency symbol alone, a currency code with its scale, or a percent sign."""
    s = col(c)
    code = F.regexp_extract(s, r"(?i)\b((?:INR|USD|EUR|GBP)(?:\s+(?:crores?|lakhs?|millions?|billions?|thousands?))?)\b", 1)
    return F.when(s.contains("₹"), "INR").when(s.contains("$"), "USD").when(code != "", F.upper(code)).when(s.contains("%"), "%")


def column_label(c: Column | str, position: Column) -> Column:
    """A header without a closing "In USD" or the like; blank ones are numbered."""
    s = F.btrim(F.regexp_replace(collapse(F.coalesce(col(c), F.lit(""))), r"(?i)\s*[(\[]?\b(?:in\s+)?(?:INR|USD|EUR|GBP)\b[^)\]]*[)\]]?$", ""))
    return F.when(s == "", F.concat(F.lit("Column "), position)).otherwise(s)


def page_label(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "pages unknown").when(F.coalesce(last, first) == first, F.concat(F.lit("page "), first)).otherwise(F.concat(F.lit("pages "), first, F.lit("-"), last))


def periods_in(c: Column | str) -> Column:
    """Years and year ranges in a text, without a leading FY, each once."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?i)\b(?:fy\s*)?((?:19|20)\d{2}(?:\s*[-–/]\s*(?:(?:19|20)\d{2}|\d{2}))?)\b"), F.lit(1))
    return F.array_distinct(found)


def looks_numeric(c: Column | str) -> Column:
    """Whether a cell is a number with the usual dress, or a dash or year."""
    return F.coalesce(collapse(c).rlike(r"(?i)^[(\[]?[-+]?(?:[$€£₹]|usd|inr|eur|gbp)?\s*\d[\d,]*(?:\.\d+)?\s*(?:%|x|bn|mn|m|k)?[)\]]?$|^(?:fy)?(?:19|20)\d{2}(?:[-–/]\d{2,4})?$"), F.lit(False))


def slug(kind: Column, name: Column | str) -> Column:
    """A stable id of a kind and a name: at most 48 characters of the name in snake case and 8 digits of its hash."""
    s = F.btrim(F.regexp_replace(F.lower(col(name)), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lit("req_"), kind, F.lit("_"), F.substring(s, 1, 48), F.lit("_"), F.substring(F.sha2(col(name), 256), 1, 8))
