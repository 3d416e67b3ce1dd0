"""Quantities recorded in different units: the unit in force of a column, chosen by least log residual.

Each column has candidate readings (a dimension and a size in base units). Every statement about a
column - its unit, its label, its cells, its table's title - is an identity that a reading should
fulfil; the difference of the logarithms is its residual. Physical identities among the columns of
a dataset (a margin is a profit over a revenue, a mass a density times a volume) add residuals over
pairs and triples of columns and decide where the statements leave several readings or none. The
combination of all columns with the least sum wins; if others come as low the result is flagged.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulae.operators.orphans import clean_key
from tabulae.session import salted_join

# Units with their dimension and size in the dimension's base (USD, INR, EUR, GBP: one; share: one basis point; energy: J; mass: mg; volume: mL; area: cm2; duration: s; density: mg a mL; power: W).
CURRENCIES = {"USD": "USD", "US$": "USD", "$": "USD", "DOLLAR": "USD", "DOLLARS": "USD", "EUR": "EUR", "€": "EUR", "EURO": "EUR", "EUROS": "EUR", "GBP": "GBP", "£": "GBP", "POUND": "GBP", "POUNDS": "GBP", "INR": "INR", "₹": "INR", "RS": "INR", "RS.": "INR", "RUPEE": "INR", "RUPEES": "INR"}
SCALES = {"k": 3, "thousand": 3, "thousands": 3, "000": 3, "'000": 3, "000s": 3, "'000s": 3, "tsd": 3, "lakh": 5, "lakhs": 5, "lac": 5, "lacs": 5, "m": 6, "mn": 6, "mm": 6, "mio": 6, "mln": 6, "million": 6, "millions": 6, "crore": 7, "crores": 7, "cr": 7, "b": 9, "bn": 9, "mrd": 9, "bln": 9, "billion": 9, "billions": 9, "tn": 12, "trillion": 12, "trillions": 12}
PREFIXES = {"": 0, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15}
PREFIX_WORDS = {"": 0, "kilo": 3, "mega": 6, "giga": 9, "tera": 12, "peta": 15}
SHARES = {"%": 100, "percent": 100, "per cent": 100, "pct": 100, "in %": 100, "percentage": 100, "‰": 10, "permille": 10, "bp": 1, "bps": 1, "basis point": 1, "basis points": 1, "fraction of 1": 10000, "fraction": 10000, "ratio": 10000, "ratio (0-1)": 10000, "ratio 0-1": 10000, "share of 1": 10000}
SYMBOLS = {"mg": ("mass", 1), "g": ("mass", 1000), "kg": ("mass", 10**6), "t": ("mass", 10**9), "kt": ("mass", 10**12), "Mt": ("mass", 10**15), "Gt": ("mass", 10**18), "mL": ("volume", 1), "ml": ("volume", 1), "cL": ("volume", 10), "L": ("volume", 1000), "l": ("volume", 1000), "hL": ("volume", 10**5), "hl": ("volume", 10**5), "kL": ("volume", 10**6), "kl": ("volume", 10**6), "ML": ("volume", 10**9), "GL": ("volume", 10**12), "cm3": ("volume", 1), "dm3": ("volume", 1000), "m3": ("volume", 10**6), "km3": ("volume", 10**15), "cm2": ("area", 1), "m2": ("area", 10**4), "ha": ("area", 10**8), "km2": ("area", 10**10), "s": ("duration", 1), "sec": ("duration", 1), "min": ("duration", 60), "h": ("duration", 3600), "hr": ("duration", 3600), "hrs": ("duration", 3600), "d": ("duration", 86400)}
WORDS = {"milligram": ("mass", 1), "gram": ("mass", 1000), "gramme": ("mass", 1000), "kilogram": ("mass", 10**6), "tonne": ("mass", 10**9), "metric ton": ("mass", 10**9), "metric tonne": ("mass", 10**9), "ton": ("mass", 10**9), "kilotonne": ("mass", 10**12), "megatonne": ("mass", 10**15), "millilitre": ("volume", 1), "milliliter": ("volume", 1), "litre": ("volume", 1000), "liter": ("volume", 1000), "hectolitre": ("volume", 10**5), "kilolitre": ("volume", 10**6), "kiloliter": ("volume", 10**6), "megalitre": ("volume", 10**9), "megaliter": ("volume", 10**9), "cubic metre": ("volume", 10**6), "cubic meter": ("volume", 10**6), "square metre": ("area", 10**4), "square meter": ("area", 10**4), "sq m": ("area", 10**4), "hectare": ("area", 10**8), "square kilometre": ("area", 10**10), "square kilometer": ("area", 10**10), "sq km": ("area", 10**10), "second": ("duration", 1), "minute": ("duration", 60), "hour": ("duration", 3600), "day": ("duration", 86400), "week": ("duration", 604800)}
FILLERS = {"in", "of", "amounts", "amount", "figures", "all", "expressed", "stated", "as", "values", "the"}
MONEY = ("USD", "INR", "EUR", "GBP")


@dataclass(frozen=True)
class Reading:
    """What a text says about a unit: a dimension (none for a scale alone), a size in base units, and whether a money unit names the bare currency."""

    dimension: str | None
    size: Fraction
    bare: bool = False


def _energy(text: str) -> tuple[str, int] | None:
    if m := re.fullmatch(r"([kMGTP]?)(J|Wh)", text):
        return "energy", 10 ** PREFIXES[m[1]] * (3600 if m[2] == "Wh" else 1)
    if m := re.fullmatch(r"(|kilo|mega|giga|tera|peta)(joules?|watt[ -]?hours?)", text.lower()):
        return "energy", 10 ** PREFIX_WORDS[m[1]] * (3600 if m[2][0] == "w" else 1)
    return None


def _power(text: str) -> tuple[str, int] | None:
    if m := re.fullmatch(r"([kMGTP]?)W", text):
        return "power", 10 ** PREFIXES[m[1]]
    if m := re.fullmatch(r"(|kilo|mega|giga|tera|peta)watts?", text.lower()):
        return "power", 10 ** PREFIX_WORDS[m[1]]
    return None


def _density(text: str) -> tuple[str, Fraction] | None:
    """A mass over a volume."""
    if not (m := re.fullmatch(r"([^/]+?)(?: ?/ ?| per )([^/]+)", text)):
        return None
    mass, volume = _plain(m[1]), _plain(m[2])
    return ("density", Fraction(mass[1]) / volume[1]) if mass and volume and (mass[0], volume[0]) == ("mass", "volume") else None


def _plain(text: str) -> tuple[str, int | Fraction] | None:
    """A unit without scale words."""
    low = re.sub(r"[ -]+", " ", text.lower())
    if low in SHARES or text.lower() in SHARES:
        return "share", SHARES.get(low) or SHARES[text.lower()]
    if text in SYMBOLS:
        return SYMBOLS[text]
    if found := _energy(text) or _power(text) or _density(text):
        return found
    return WORDS.get(low) or (WORDS.get(low[:-1]) if low.endswith("s") else None) or (WORDS.get(low.replace("tres", "tre").replace("ters", "ter").replace("tons", "ton")))


@lru_cache(maxsize=100_000)
def parse_unit(text: str | None) -> Reading | None:
    """The reading of a text that is nothing but a unit, a scale or both; None for anything else, null and blank texts."""
    if text is None:
        return None
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).replace("’", "'")).strip(" .,;:" if not re.search(r"(?i)\brs\.$", text.strip()) else " ,;:")
    s = re.sub(r"(?i)[ -]*co2[ -]?(e|eq|equivalents?)?$", "", s) if re.search(r"(?i)\w[ -]*co2", s) else s
    if not s:
        return None
    if found := _plain(s):
        return Reading(found[0], Fraction(found[1]))
    s = re.sub(r"(?i)\bus dollars?\b", "USD", s)
    s = re.sub(r"(?i)\bpounds sterling\b", "GBP", s)
    if m := re.fullmatch(r"([TMk])(EUR|USD|GBP|INR|€|£|\$|₹)", s):
        return Reading(CURRENCIES[m[2]], Fraction(10) ** {"T": 3, "k": 3, "M": 6}[m[1]])
    tokens = re.findall(r"US\$|[$€£₹]|'?000s?|[A-Za-z%‰]+[23]?\.?|[^\s]", s)
    currency, scale, scaled, i = None, Fraction(1), False, 0
    while i < len(tokens):
        t = tokens[i]
        if t.upper() in CURRENCIES or t.upper().rstrip(".") in CURRENCIES:
            code = CURRENCIES.get(t.upper()) or CURRENCIES[t.upper().rstrip(".")]
            if currency not in (None, code):
                return None
            currency = code
        elif t.lower() in FILLERS:
            pass
        elif t.lower().rstrip(".") in SCALES and (t.lower().rstrip(".") not in ("m", "k", "b") or currency or len(tokens) > 1 and tokens[1] in "$€£₹"):
            scale, scaled = scale * 10 ** SCALES[t.lower().rstrip(".")], True
        else:
            if currency is None and (found := _plain(" ".join(tokens[i:]))):
                return Reading(found[0], found[1] * scale)
            return None
        i += 1
    if currency:
        return Reading(currency, scale, not scaled)
    return Reading(None, scale) if scaled else None


@lru_cache(maxsize=100_000)
def parse_within(text: str | None) -> Reading | None:
    """The reading of the part of a label or title that names a unit: in brackets, or behind a comma, a dash or "in" at its end."""
    if text is None:
        return None
    s = text.strip()
    parts = []
    for p in (r"\[([^\[\]]*)\]$", r"\(((?:[^()]|\([^()]*\))*)\)$", r"[,;] (.+)$", r" [–—-] (.+)$", r" (in .+)$"):
        if m := re.search(p, s):
            parts.append(m[1])
    for p in parts:
        for inner in (p, re.sub(r"^in ", "", p)):
            if r := parse_unit(inner):
                return r
    return None


def strip_number(cell: Column) -> Column:
    """What a cell holds besides its number: the text behind a leading one or before a trailing one."""
    number = r"\(?[-−–]?\d[\d,.]*\)?"
    led = F.regexp_replace(cell, "^\\s*" + number + r"(?![\w'])\s*", "")
    return F.btrim(F.when(led != cell, led).otherwise(F.regexp_replace(cell, r"\s*" + number + r"\s*$", "")))


@dataclass(frozen=True)
class Identity:
    """Physical relation: the ``whole`` is the product of the ``parts`` to their powers, in base units.

    A role is a dimension (``money`` for any one currency) and a word that the column's key or label
    must hold, or none. Columns are bound to roles by these, and only together if what else their keys
    say, where they say anything else, is the same (``steel_mass``, ``steel_density``, ``volume``).
    """

    whole: tuple[str, str | None]
    parts: tuple[tuple[str, str | None, int], ...]


IDENTITIES = (
    Identity(("mass", None), (("density", None, 1), ("volume", None, 1))),
    Identity(("energy", None), (("power", None, 1), ("duration", None, 1))),
    Identity(("share", "margin"), (("money", "profit", 1), ("money", "revenue", -1))),
)
#: Words of a key that name what is measured: the dimension that a column of which nothing is stated may have.
MEASURED = {"mass": "mass", "weight": "mass", "density": "density", "volume": "volume", "energy": "energy", "power": "power", "duration": "duration", "hours": "duration", "time": "duration", "area": "area", "margin": "share", "profit": None, "revenue": None}

#: Weights of the statements' residuals: a column's own statements outweigh its table's.
WEIGHTS = {"unit": 8.0, "label": 4.0, "cells": 2.0, "title": 1.0}
#: Residual from which a reading that no statement backs is not believed: what leaving the column unread costs.
BELIEVED = 0.05
#: Sums of residuals that differ by less count as equal.
EQUAL = 1e-6


def candidates(own: str | None, label: str | None, cells: str | None, title: str | None, dimension: str | None) -> list[tuple[Reading, float]]:
    """Readings of a column with the weighted log residual of each against all that is said about it.

    A money column without a currency of its own takes the title's; a scale told alone, by the label or
    else the title, multiplies a unit that names the bare currency. Columns of other dimensions hear
    their title and bare scales not at all.
    """
    said = {"unit": parse_unit(own), "label": parse_within(label), "cells": parse_unit(cells), "title": parse_within(title)}
    mine = [(k, said[k]) for k in ("unit", "label", "cells") if said[k] and said[k].dimension]
    alone = next((said[k].size for k in ("label", "title") if said[k] and said[k].dimension is None), None)
    if not mine and dimension in MONEY + ("money",) and said["title"] and said["title"].dimension in MONEY:
        mine = [("title", said["title"])]
    terms = [(k, Reading(r.dimension, r.size * alone) if r.dimension in MONEY and r.bare and alone else r) for k, r in mine]
    readings = {(r.dimension, r.size): r for _, r in terms}
    out = []
    for r in readings.values():
        miss = sum(WEIGHTS[k] * (abs(math.log10(r.size) - math.log10(s.size)) if s.dimension == r.dimension else 6.0) for k, s in terms)
        out.append((r, miss))
    return sorted(out, key=lambda x: (x[1], str(x[0].dimension), x[0].size))


def _words(column: dict) -> tuple[set[str], frozenset[str]]:
    """The words of a column's key and label, and those of its key that do not name what is measured."""
    key = re.findall(r"[^\W_]+", column["key"].lower())
    return {*key, *re.findall(r"[^\W_]+", (column.get("label") or "").lower())}, frozenset(w for w in key if w not in MEASURED)


def bindings(columns: list[dict], options: list[list], identities=IDENTITIES) -> list[tuple[int, list[tuple[int, int]]]]:
    """All ways to bind columns with a median to the roles of the identities: the column of the whole and those of the parts with their powers."""
    words = [_words(c) for c in columns]

    def fit(dimension: str, word: str | None) -> list[int]:
        kinds = MONEY if dimension == "money" else (dimension,)
        return [i for i, c in enumerate(columns) if c.get("log") is not None and (word is None or word in words[i][0]) and any(r and r.dimension in kinds for r, _ in options[i])]

    out = []
    for identity in identities:
        for found in itertools.product(fit(*identity.whole), *(fit(d, w) for d, w, _ in identity.parts)):
            if len(set(found)) == len(found) and len({words[i][1] for i in found if words[i][1]}) <= 1:
                out.append((found[0], [(i, p) for i, (_, _, p) in zip(found[1:], identity.parts)]))
    return out


def solve(columns: list[dict], identities=IDENTITIES) -> list[tuple[Reading | None, float, bool]]:
    """For each column (``key``, ``candidates``, ``free`` readings if none, ``log`` median of its values) the chosen reading, its residual and whether others came as low.

    A column with statements keeps their best readings; a column without any may take one of its
    ``free`` readings if an identity binds it to others, or stay unread at the cost of ``BELIEVED``.
    The combination of all columns that identities connect is chosen at once, by the least sum of the
    residuals of all of them; if other combinations come as low, what no statement backs is flagged.
    """
    options: list[list[tuple[Reading | None, float]]] = []
    for c in columns:
        best = [x for x in c["candidates"] if x[1] - c["candidates"][0][1] < 1e-9]
        options.append(best or [(None, BELIEVED), *((r, 0.0) for r in c.get("free", []) if r)])
    stated = [bool(c["candidates"]) for c in columns]
    bound = bindings(columns, options, identities)
    out = [(o[0][0], o[0][1] if known else 0.0, known and len(o) > 1) for o, known in zip(options, stated)]
    groups: list[set[int]] = []
    for whole, parts in bound:
        mine = {whole, *(i for i, _ in parts)}
        for g in [g for g in groups if g & mine]:
            mine |= g
            groups.remove(g)
        groups.append(mine)
    for group in groups:
        if all(len(options[i]) == 1 for i in group):
            continue
        rules = [b for b in bound if b[0] in group]
        for i, found in _least(columns, options, stated, sorted(group), rules).items():
            out[i] = found
    return out


def _log(column: dict, reading: Reading) -> float:
    return column["log"] + math.log10(reading.size) - (4 if reading.dimension == "share" else 0)


def _least(columns, options, stated, order, rules) -> dict[int, tuple[Reading | None, float, bool]]:
    """The combination of the group's readings with the least sum of residuals, by search that gives up a branch once it costs more than the best."""
    needed = [max(order.index(i) for i in (w, *(p for p, _ in parts))) for w, parts in rules]
    best: list[tuple[float, tuple]] = []

    def miss(rule, taken) -> float | None:
        whole, parts = rule
        if any(taken[i][0] is None for i in (whole, *(p for p, _ in parts))):
            return None
        money = {taken[i][0].dimension for i, _ in parts if taken[i][0].dimension in MONEY}
        if len(money) > 1:
            return math.inf
        return abs(_log(columns[whole], taken[whole][0]) - sum(p * _log(columns[i], taken[i][0]) for i, p in parts))

    def search(k: int, taken: dict, cost: float, backed: frozenset) -> None:
        if best and cost > best[0][0] + EQUAL:
            return
        if k == len(order):
            if all(stated[i] or taken[i][0] is None or i in backed for i in order):
                if best and cost < best[0][0] - EQUAL:
                    best.clear()
                best.append((cost, tuple(taken[i] for i in order)))
                best.sort(key=lambda x: x[0])
            return
        for option in options[order[k]]:
            taken[order[k]] = option
            more, now = option[1], set()
            for rule, at in zip(rules, needed):
                if at == k and (m := miss(rule, taken)) is not None:
                    more += m
                    now |= {rule[0], *(i for i, _ in rule[1])}
            search(k + 1, taken, cost + more, backed | now)
            del taken[order[k]]

    search(0, {}, 0.0, frozenset())
    least = [b for b in best if b[0] - best[0][0] < EQUAL]
    chosen = dict(zip(order, least[0][1]))
    residual = {i: 0.0 for i in order}
    for rule in rules:
        if (m := miss(rule, chosen)) is not None:
            for i in (rule[0], *(p for p, _ in rule[1])):
                residual[i] += m
    open_ = lambda i: len(options[i]) > 1 and chosen[i][0] is not None and len(least) > 1
    return {i: (r, (w if stated[i] else 0.0) + residual[i], open_(i)) for i, (r, w) in chosen.items()}


FREE = {"share": ["%", "fraction of 1", "bp"], "mass": ["g", "kg", "t", "kt", "Mt"], "volume": ["L", "m3", "ML"], "energy": ["kJ", "MJ", "GJ", "TJ", "kWh", "MWh", "GWh"], "duration": ["h", "d"], "area": ["m2", "ha", "km2"], "density": ["kg/m3", "g/cm3", "mg/L"], "power": ["W", "kW", "MW", "GW"]}

UNITS = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("common_unit", T.StringType()), T.StructField("factor", T.DoubleType()), T.StructField("common_number", T.LongType()), T.StructField("residual", T.DoubleType()), T.StructField("non_unique", T.BooleanType())]))


def common(reading: Reading, targets: dict[str, str]) -> tuple[str, Fraction] | None:
    """The common unit of a reading's dimension and how many of it one recorded unit holds."""
    unit = targets.get(reading.dimension)
    base = parse_unit(unit) if unit else None
    return (unit, reading.size / base.size) if base and base.dimension == reading.dimension else None


def _targets(unit_targets: DataFrame) -> dict[str, str]:
    """Common unit by dimension; the table is fixed by its nature (one row a dimension), which is checked."""
    rows = unit_targets.select("dimension", "common_unit").where("dimension IS NOT NULL AND common_unit IS NOT NULL").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("unit_targets has more rows than there are dimensions")
    return {r["dimension"]: r["common_unit"] for r in sorted(rows, reverse=True)}


def dimension_votes(columns: DataFrame) -> DataFrame:
    """``key`` and ``dimension``: what most columns of a key with a unit of their own are measured in; currencies count as ``money``, ties go to the lower name."""

    @F.pandas_udf("string")
    def dim(unit: pd.Series, label: pd.Series) -> pd.Series:
        own = [parse_unit(u) or parse_within(x) for u, x in zip(unit, label)]
        return pd.Series([None if r is None or r.dimension is None else "money" if r.dimension in MONEY else r.dimension for r in own])

    per = columns.groupBy("key", "unit", "label").count().withColumn("dimension", dim("unit", "label")).where("dimension IS NOT NULL")
    per = per.groupBy("key", "dimension").agg(F.sum("count").alias("n"))
    return per.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "dimension")).alias("m")).select("key", F.col("m.dimension").alias("dimension"))


def cell_units(tables: DataFrame) -> DataFrame:
    """Per table and column: ``cell_unit``, the text that most cells hold besides their number (ties: the lower text), and ``log``, the median log10 of the cells' size."""
    cells = tables.select(clean_key(F.col("table_id")).alias("table"), F.explode("rows").alias("row")).where("table IS NOT NULL").select("table", F.explode("row").alias("key", "cell")).where(F.col("cell").rlike(r"\d"))
    bare = F.regexp_replace(F.regexp_extract("cell", r"\d[\d,]*(?:\.\d+)?", 0), ",", "").cast("double")
    cells = cells.select("table", "key", strip_number(F.col("cell")).alias("said"), F.when(bare > 0, F.log10(bare)).alias("log"))
    return cells.groupBy("table", "key").agg(F.mode(F.when(F.col("said") != "", F.col("said")), True).alias("cell_unit"), F.median("log").alias("log"))


def dataset_units(datasets: DataFrame, tables: DataFrame, unit_targets: DataFrame) -> DataFrame:
    """Units in force of the columns and pages of datasets: ``rec_key``, ``item``, ``common_unit``, ``factor``, ``common_number``, ``residual``, ``non_unique``.

    One row per number column whose unit in force is known (``item`` is its key; ``common_number``
    1 means that it is recorded in the common unit) and one per source region (``region_`` and
    position; ``common_number`` is the right page, ``factor`` the pages to add). Columns of which
    nothing is known, plain counts and regions with null pages give no rows, nor do the regions of a
    dataset without ``page_start``. ``factor`` is exact where ``common_number``, rounded, is not.
    Re-delivered rows give one result; null arrays, null columns and empty tables give none; of
    several columns with one key the first counts for identities.

    The tables' cells are reduced to one row per column before the join; votes are joined by salted key.
    """
    goal = _targets(unit_targets)
    rows = datasets.select(F.col("dataset_id").alias("rec_key"), clean_key(F.col("table_id")).alias("table"), "title", "page_start", "page_end", "columns", F.transform("source_regions", lambda r: r["page"]).alias("pages"))
    rows = rows.withColumn("row", F.sha2(F.to_json(F.struct("*")), 256)).dropDuplicates(["row"])
    flat = rows.select("row", "table", F.posexplode("columns").alias("pos", "c")).where("c.type = 'number' AND c.key IS NOT NULL").select("row", "table", "pos", "c.key", "c.unit", "c.label")
    known = salted_join(flat, dimension_votes(flat), ["key"], F.col("row")).join(cell_units(tables), ["table", "key"], "left")
    given = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "unit", "label", "cell_unit", "log", "dimension"))).alias("given"))
    picked = rows.select("row", "rec_key", "title", "page_start", "page_end", "pages").join(given, "row", "left").select("rec_key", "title", "page_start", "page_end", "given", "pages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rec_key": b.rec_key, "units": [_dataset(*x, goal) for x in zip(b.title, b.page_start, b.page_end, b.given, b.pages)]})

    out = picked.mapInPandas(run, T.StructType([T.StructField("rec_key", picked.schema["rec_key"].dataType), T.StructField("units", UNITS)]))
    return out.select("rec_key", F.explode("units").alias("u")).select("rec_key", "u.*").distinct()


def _dataset(title, page_start, page_end, given, pages, goal) -> list[dict]:
    out = []
    columns = []
    for c in given if given is not None else []:
        named = next((MEASURED[w] for w in reversed(re.findall(r"[^\W_]+", c["key"].lower())) if MEASURED.get(w)), None)
        free = [parse_unit(u) for u in FREE.get(c["dimension"] or named, [])]
        columns.append({"key": c["key"], "label": c["label"], "candidates": candidates(c["unit"], c["label"], c["cell_unit"], title, c["dimension"]), "free": free, "log": c["log"]})
    for c, (reading, miss, unsure) in zip(columns, solve(columns)):
        if reading and (to := common(reading, goal)):
            out.append({"item": c["key"], "common_unit": to[0], "factor": float(to[1]), "common_number": round(to[1]), "residual": float(miss), "non_unique": bool(unsure)})
    known = [(i, int(p)) for i, p in enumerate(pages if pages is not None else []) if p is not None and p == p]
    if known and page_start is not None and page_start == page_start and "page" in goal:
        shift, miss = page_shift([p for _, p in known], int(page_start), None if page_end is None or page_end != page_end else int(page_end))
        out.extend({"item": f"region_{i}", "common_unit": goal["page"], "factor": float(shift), "common_number": p + shift, "residual": miss, "non_unique": False} for i, p in known)
    return out


def page_shift(pages: list[int], first: int, last: int | None) -> tuple[int, float]:
    """What to add to pages counted in one way so that the first of them is ``first``, and how far the last then misses ``last``."""
    shift = first - min(pages)
    return shift, float(abs(max(pages) + shift - last)) if last is not None else 0.0


def expected_units(refs: DataFrame, unit_targets: DataFrame) -> DataFrame:
    """Units of free-text entries: ``rec_key``, ``item`` (position from 0), ``common_unit``, ``factor``, ``common_number``; entries that are null, blank or no unit give no rows, repeated rows one result."""
    goal = _targets(unit_targets)
    kind = T.StructType([T.StructField("common_unit", T.StringType()), T.StructField("factor", T.DoubleType()), T.StructField("common_number", T.LongType())])

    @F.pandas_udf(kind)
    def convert(unit: pd.Series) -> pd.DataFrame:
        read = [parse_unit(u) for u in unit]
        made = [common(r, goal) if r and r.dimension else None for r in read]
        return pd.DataFrame({"common_unit": [m and m[0] for m in made], "factor": [m and float(m[1]) for m in made], "common_number": pd.array([m and round(m[1]) for m in made], dtype="Int64")})

    rows = refs.select(F.col("ref_id").cast("string").alias("rec_key"), F.posexplode("expected_units").alias("pos", "unit")).where("trim(unit) <> ''")
    rows = rows.withColumn("u", convert("unit")).where("u.common_unit IS NOT NULL")
    return rows.select("rec_key", F.col("pos").cast("string").alias("item"), "u.*").distinct()
