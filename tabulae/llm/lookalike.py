"""One consistent form for texts that look alike.

Only the stretches of a text that hold a character beyond ASCII and the letters of Latin-1 are
taken out; the distinct stretches are exploded to positioned code points, mapped by
broadcast joins, their combining marks ordered by class, recomposed and put back. Texts without
such characters are their own form.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.session import checkpoint, salted_join

# Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ա": "w", "ց": "g", "հ": "h", "ո": "n", "ս": "u", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ӏ": "l", "Ӏ": "I", "\u00b5": "\u03bc",
}
# Hyphens that look like the ASCII one.
HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d\u02d7"
#: Ligatures are the compatibility characters of these names; other compatibility characters (raised digits, fractions, circled forms) look different and stay.
LIGATURES = "LATIN SMALL LIGATURE", "LATIN CAPITAL LIGATURE", "ARMENIAN SMALL LIGATURE"


#: Stands for a joiner that stays while a stretch is treated; the text's own private-use characters are untouched but for this noncharacter.
STAYS = "\ufdd0"


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """What each character is replaced by (nothing, for invisible ones), built from the Unicode database: canonical decompositions, full-width and half-width forms, ligatures, blanks, invisible characters, then look-alikes of the results."""
    out: dict[str, str] = {}

    def resolve(c: str) -> str:
        kind, _, rest = unicodedata.decomposition(c).rpartition(">")
        parts = rest.split()
        taken = parts and (kind in ("", "<wide", "<narrow", "<noBreak") or kind == "<compat" and unicodedata.name(c, "").startswith(LIGATURES))
        if taken and not 0xAC00 <= ord(c) <= 0xD7A3:
            return "".join(resolve(chr(int(p, 16))) for p in parts)
        category = unicodedata.category(c)
        if c in HYPHENS:
            return "-"
        if category == "Zs":
            return " "
        if category == "Cf" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
            return ""
        return LOOKALIKES.get(c, c)

    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c) not in ("Cn", "Cs", "Co") and (to := resolve(c)) != c:
            out[c] = to
    return out


#: Characters that no mapping changes: ASCII and the letters of Latin-1, which recompose to themselves. Any other makes a text worth treating.
STABLE = "\\x00-\\x7F\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\xFF"
#: A stretch between blanks that holds another character; it is only tried where a stretch begins, so time is linear in the text.
STRETCH = f"(?<![^ \\t\\r\\n])[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x21-\\x7F{STABLE[9:]}]*+[^{STABLE}][^ \\t\\r\\n]*+"


#: Code points after which a long stretch is cut before the next character that nothing before it composes with: a letter or digit, but no conjoining or half-width one.
CUT = 32
CHUNK = "(?s).{1," + str(CUT) + "}(?:(?![\\p{Lu}\\p{Ll}\\p{Lo}\\p{N}&&[^\\x{1100}-\\x{11FF}\\x{A960}-\\x{A97F}\\x{D7B0}-\\x{D7FF}\\x{FF61}-\\x{FFDF}]]).)*+"


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The mapping (one row per character and part) and the classes of combining marks; both are bounded by the size of Unicode."""
    rows = [(c, k, p) for c, to in mapping().items() for k, p in enumerate(to or [""])]
    marks = [(chr(i), unicodedata.combining(chr(i))) for i in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(i))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ch", "part_no", "part"])), spark.createDataFrame(pd.DataFrame(marks, columns=["part", "class"]))


def canonical_stretches(stretches: DataFrame) -> DataFrame:
    """``stretch`` and ``form`` for each distinct ``stretch``: code points are exploded, mapped, marks sorted by class behind their base, composed and rebuilt.

    A zero-width joiner between two pictographs changes how they look and stays.
    """
    chars, classes = (F.broadcast(t) for t in _tables(stretches.sparkSession))
    keep = F.regexp_replace("stretch", "([\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}\\x{FE0F}])\\x{200D}(?=[\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}])", "$1" + STAYS)
    points = stretches.select("stretch", F.posexplode(F.split(keep, "")).alias("pos", "ch")).where("ch <> ''")
    points = points.join(chars, "ch", "left").select("stretch", "pos", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.coalesce("part", "ch").alias("part")).where("part <> ''")
    points = points.join(classes, "part", "left").fillna(0, ["class"])
    # a stretch is short, so its points are one small row; marks that stand out of the order of their classes are sorted behind their base
    placed = points.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct("pos", "part_no", "class", "part"))).alias("points"))
    cluster = lambda i: F.size(F.filter(F.slice("points", 1, i + 1), lambda p: p["class"] == 0))
    sorted_ = F.array_sort(F.transform("points", lambda p, i: F.struct(cluster(i).alias("cluster"), p["class"].alias("class"), i.alias("at"), p["part"].alias("part"))))
    crossed = F.exists(F.zip_with("points", F.slice("points", 2, F.size("points")), lambda a, b: (b["class"] > 0) & (a["class"] > b["class"])), lambda x: F.coalesce(x, F.lit(False)))
    plain = F.transform("points", lambda p: F.struct(F.lit(0).alias("cluster"), p["class"].alias("class"), p["pos"].alias("at"), p["part"].alias("part")))
    ordered = placed.select("stretch", F.when(crossed, sorted_).otherwise(plain).alias("points"))
    joined = F.array_join(F.transform("points", lambda p: p["part"]), "")

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x).replace(STAYS, "\u200d"))

    made = ordered.select("stretch", F.when(F.exists("points", lambda p: p["class"] > 0), compose(joined)).otherwise(F.replace(joined, F.lit(STAYS), F.lit("\u200d"))).alias("form"))
    return stretches.join(made, "stretch", "left").select("stretch", F.coalesce("form", F.lit("")).alias("form"))


def canonical_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` and ``form``: every text in the one form of all texts that look like it.

    Full-width and half-width forms, ligatures, composed and decomposed letters, letters of other
    scripts that look Latin, hyphens, kinds of blanks and invisible characters come out alike; case,
    accents, punctuation, line ends, numbers of blanks, and raised or lowered digits stay. Null texts
    have null forms, empty ones empty forms; repeated rows give repeated results.

    Only texts with a touched character are shuffled, as stretches between blanks; each distinct
    stretch is treated once.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # as many bytes as characters: all ASCII, which needs no pattern
    hit = F.when(F.octet_length("text") == F.char_length("text"), False).otherwise(F.col("text").rlike(f"[^{STABLE}]"))
    plain = base.where(F.col("text").isNull() | ~hit).select("key", "text", F.col("text").alias("form"))
    odd = base.where(hit).withColumn("id", F.sha2("text", 256))
    cut = odd.groupBy("id").agg(F.first("text").alias("text"))
    # written once: the stretches are read for the vocabulary, for their places and for putting texts back
    cut = cut.select("id", F.split("text", STRETCH, -1).alias("between"), F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0)).alias("parts"))
    # stretches are cut to a bounded length, with nothing between their parts, so a page without blanks costs in proportion to its length
    chunks = lambda p: F.regexp_extract_all(p, F.lit(CHUNK), F.lit(0))
    spaced = F.flatten(F.zip_with("between", "parts", lambda b, p: F.when(F.char_length(p) > CUT, F.concat(F.array(b), F.array_repeat(F.lit(""), F.size(chunks(p)) - 1))).otherwise(F.array(b))))
    pieces = F.flatten(F.transform("parts", lambda p: F.when(F.char_length(p) > CUT, chunks(p)).otherwise(F.array(p))))
    cut = checkpoint(cut.select("id", spaced.alias("between"), pieces.alias("parts")))
    spread = cut.select("id", F.posexplode("parts").alias("pos", "stretch"))
    forms = canonical_stretches(spread.select("stretch").distinct())
    put = salted_join(spread, forms, ["stretch"], F.col("id"), "inner", 8).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"]).alias("forms"))
    whole = cut.join(put, "id").select("id", F.array_join(F.flatten(F.zip_with("between", "forms", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "").alias("form"))
    made = odd.join(whole, "id").select("key", "text", "form")
    return plain.unionByName(made).withColumnRenamed("key", key)


def _shaped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``form`` and ``body``, as hashes, of documents with something to see."""
    shaped = canonical_texts(docs, key, text).where(F.col("form").rlike(r"\S"))
    return checkpoint(shaped.select(F.col(key).alias("doc"), F.sha2("form", 256).alias("form"), F.sha2("text", 256).alias("body")).distinct())


def lookalike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that shares its form with a different text: ``key``, ``class_id`` (the least key of the form), ``copy_of`` (the least key of its own text) and ``n_texts``, the different texts of the class.

    This is the result for any size: every pair of different texts of a class looks alike, and copies
    of a text are told by ``copy_of``. Null, empty and blank texts are in no class; a document listed
    twice is one. Counted per text before the shuffle by form, so a text with many copies is one row.
    """
    named = _shaped(docs, key, text)
    texts = named.groupBy("form", "body").agg(F.min("doc").alias("copy_of"))
    classes = texts.groupBy("form").agg(F.min("copy_of").alias("class_id"), F.count("*").alias("n_texts")).where("n_texts > 1")
    members = texts.join(classes, "form").select("body", "class_id", "copy_of", "n_texts")
    return salted_join(named.select("doc", "body"), members, ["body"], F.col("doc"), "inner").select(F.col("doc").alias(key), "class_id", "copy_of", "n_texts")


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents (``<key>_a`` < ``<key>_b``) whose texts are different strings of one form.

    Null texts and texts whose form is white space alone form no pairs; exact copies form none with
    each other. A document listed twice gives its pairs once. Different texts of a form are paired
    first, by hash, and only those pairs are expanded to documents, so copies of one text are never
    compared with each other. The result has every pair; ``lookalike_classes`` has the classes.
    """
    named = _shaped(docs, key, text)
    bodies = named.select("form", "body").distinct()
    pairs = bodies.select("form", F.col("body").alias("body_a")).join(bodies.select("form", F.col("body").alias("body_b")), "form").where("body_a < body_b")
    a, b = (named.select(F.col("body").alias(f"body_{x}"), F.col("doc").alias(f"doc_{x}")) for x in "ab")
    met = pairs.join(a, "body_a").join(b, "body_b").where("doc_a <> doc_b")
    return met.select(F.least("doc_a", "doc_b").alias(f"{key}_a"), F.greatest("doc_a", "doc_b").alias(f"{key}_b")).distinct()
