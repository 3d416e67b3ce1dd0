"""Repair of texts read from scanned pages.

Words are grouped by a skeleton in which glyphs that recognition confuses are one; a rare form that
differs from a frequent one of its group only by such confusions is a misreading. Where several forms
explain it, the one that stands beside its neighbours most often in the corpus is taken. Lines whose
text, with digits masked, comes dressed with page numbers across the corpus or says the document's
name are running headers; lines with nothing but the page's number are page numbers. What remains is
running text, which windows over the lines of a row put back together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.session import checkpoint, salted_join

# What a glyph is misread as; in words and in numbers.
CONFUSIONS = (("o", "0"), ("e", "c"), ("i", "l"), ("i", "1"), ("l", "1"), ("n", "ri"), ("t", "f"), ("a", "o"), ("s", "5"), ("d", "cl"), ("u", "ii"), ("g", "q"), ("m", "rn"), ("h", "b"), ("b", "6"), ("é", "6"), ("li", "h"), ("w", "vv"), ("y", "v"), ("g", "9"), ("z", "2"), ("b", "8"))
DIGITS_READ = {"Z": "2", "S": "5", "B": "8", "b": "6", "g": "9", "l": "1", "O": "0"}
#: One glyph for each set of confusable single ones, and what glyphs that are confused with pairs are read as.
SAME = {"a": "o", "0": "o", "e": "c", "l": "i", "1": "i", "f": "t", "y": "v", "q": "g", "9": "g", "5": "s", "2": "z", "b": "h", "6": "h", "8": "h", "é": "h", "u": "h"}
PAIRS = (("m", "rri"), ("n", "ri"), ("d", "ci"), ("h", "ii"), ("w", "vv"))
#: A form counts as misread if a form of its group is so many times as frequent, and that one occurs so often.
RATIO, LEAST = 10, 5
#: Short words look like each other by chance: the ratio for words of up to 3 and of 4 characters.
SHORT_RATIO = {3: 200, 4: 50}
#: Most frequent words that no look-up can concern: they are neither misread nor can they be parts of numbers or quarters, so leaving them out changes no row.
COMMON = 5_000
#: Share of a line's occurrences that must carry a page number for it to be a running header.
DRESSED = 0.1
#: Forms of a skeleton up to which a word is compared with each; beyond it, its possible readings are looked up instead.
COMPARED = 64
#: Characters from which a misread word alone tells that a row is of a scanned page.
TELLING = 4
#: A page's greatest width and a wrapped line's least, which tell wrapped lines from headings, lists and codes.
WIDEST, WRAPPED = 150, 30

HYPHEN = "-\u2010\u2011\u00ac\u00ad"
WORD = re.compile("[^\\W_]+(?:[-\u2010\u2011][^\\W_]+)*")
PART = re.compile(r"[^\W_]+")
WORD_PART = r"[\p{L}\p{N}]+"
_STRIP = " \t\r\n\f\v\u00a0"
_STOPS = ".!?;:,|"
_BEFORE_BREAK = ",)%"
_NUMBER_LINE = re.compile(r"(?i)(?:page|seite|p[áa]gina|p[áa]g\.?|p\.|s\.)\s*\d{1,5}(?:\s*(?:of|de|von|sur|/)\s*\d{1,5})?|[-–—]\s?\d{1,5}\s?[-–—]|\[\d{1,5}\]|\(\d{1,5}\)|\d{1,5}\s?/\s?\d{1,5}")
_BARE = re.compile(r"\d{1,5}")
_FIGURE = re.compile(r"[(\-–]?[\d.,]+[)%]?")
_DRESS = re.compile(r"^\d{1,5}\s*\|\s*|\s+[–—-]\s*\d{1,5}$|\s{2,}\d{1,5}$|\s*\|\s*\d{1,5}$")
_OWN_NUMBER = re.compile(r"^(\d{1,5})\s*\||(\d{1,5})$")
_MASK = re.compile(r"(?<![^\W_])[0-9OlZSBbg]*[0-9][0-9OlZSBbg]*(?![^\W_])")
_APART = re.compile(r"(?:[^\w#]|_)+")
_SECTION = re.compile(r"\d{1,2}\.\d{1,2} [^\W\d_][^.]* [^.]*")
_READ = "".join(DIGITS_READ)
_LETTERS_READ = frozenset(_READ)
_FIGURES_READ = str.maketrans(DIGITS_READ)
_NUMBER = re.compile(f"(FY|Q)?([0-9{_READ}]+(?:[.,][0-9{_READ}]+)*)")


def skeleton(word: Column) -> Column:
    """The word in lower case with each set of confusable glyphs as one, glyph by glyph, so that both sides of a confusion come out the same whatever stands beside it."""
    s = F.translate(F.lower(word), "".join(SAME), "".join(SAME.values()))
    for one, many in PAIRS:
        s = F.replace(s, F.lit(one), F.lit(many))
    return s


_SPREAD = str.maketrans({**SAME, **dict(PAIRS), **{c: dict(PAIRS)[k] for c, k in SAME.items() if k in dict(PAIRS)}})


def skeleton_of(text: str) -> str:
    """``skeleton`` of a text in a Python worker."""
    return text.lower().translate(_SPREAD)


def explained(word: str, form: str, edits: int = 2) -> bool:
    """Whether ``form`` read with at most ``edits`` confusions gives ``word``."""
    if word == form:
        return True
    if edits == 0:
        return False
    at = 0
    while at < min(len(word), len(form)) and word[at] == form[at]:
        at += 1
    for true, read in CONFUSIONS:
        for back in range(2):
            i = at - back
            if i >= 0 and form.startswith(true, i) and word.startswith(read, i) and explained(word[i + len(read) :], form[i + len(true) :], edits - 1):
                return True
    return False


def readings(word: str, edits: int = 2) -> set[str]:
    """All forms that ``explained`` accepts for a word, the word itself left out."""
    found, at = {(word, 0)}, {(word, 0)}
    for _ in range(edits):
        at = {(w[:i] + true + w[i + len(read) :], i + len(true)) for w, begin in at for true, read in CONFUSIONS for i in range(begin, len(w)) if w.startswith(read, i)}
        found |= at
    return {w for w, _ in found if w != word and explained(word, w, edits)}


def lexicon(rows: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words in lower case, and of all pairs in compounds as ``a-b``.

    Counted per task before the one shuffle, of distinct words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

        def send() -> pa.RecordBatch:
            for w in [w for w in seen if not w.isalnum()]:
                n = seen.pop(w)
                parts = re.split("[-\u2010\u2011]", w)
                for p in parts:
                    seen[p] += n
                for p, q in zip(parts, parts[1:]):
                    seen[f"{p}-{q}"] += n
            return pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema)

        read = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(WORD.findall(t.lower()))
                read += len(t)
            # few words or long ones: the characters read bound what is held
            if len(seen) > 500_000 or read > 400_000_000:
                yield send()
                seen.clear()
                read = 0
        yield send()

    words = rows.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def candidate_forms(words: DataFrame) -> DataFrame:
    """``word``, ``form`` and ``n_form``: every frequent form that explains a rare word; ``words``: ``word`` and ``n``.

    A word meets the forms of its skeleton, one row a pair, joined by salted key. Words of a skeleton
    with more than ``COMPARED`` forms meet them by their possible readings instead, which are few
    however many words look alike; both ways give the same rows.
    """
    plain = words.where((F.char_length("word") >= 2) & ~F.col("word").contains("-") & F.col("word").rlike(r"^[\p{IsLatin}0-9]+$") & F.col("word").rlike(r"\p{L}"))
    plain = plain.withColumn("skeleton", skeleton(F.col("word")))
    forms = plain.where((F.col("n") >= RATIO) & ~F.col("word").rlike("[0-9]"))
    size = forms.groupBy("skeleton").agg(F.count("*").alias("n_forms"), F.max("n").alias("most"))
    size_of_word = F.char_length("word")
    need = F.when(size_of_word <= 3, SHORT_RATIO[3]).when(size_of_word == 4, SHORT_RATIO[4]).otherwise(RATIO) * F.greatest("n", F.lit(1))
    rare = checkpoint(salted_join(plain, size, ["skeleton"], F.col("word"), "inner").withColumn("need", need).where("most >= need").drop("most", "n"))
    offered = forms.select("skeleton", F.col("word").alias("form"), F.col("n").alias("n_form"))

    @F.pandas_udf("boolean")
    def explains(word: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([explained(w, f) for w, f in zip(word, form)], dtype=bool)

    @F.pandas_udf("array<string>")
    def may_be(word: pd.Series) -> pd.Series:
        return word.map(lambda w: sorted(readings(w)))

    met = salted_join(rare.where(F.col("n_forms") <= COMPARED), offered, ["skeleton"], F.col("word"), "inner").where("n_form >= need AND word <> form").where(explains("word", "form"))
    crowded = rare.where(F.col("n_forms") > COMPARED).withColumn("form", F.explode(may_be("word")))
    looked = crowded.join(offered.drop("skeleton"), "form").where("n_form >= need")
    columns = ["word", "form", "n_form"]
    return met.select(*columns).unionByName(looked.select(*columns))


def corrections(words: DataFrame) -> DataFrame:
    """``word`` and ``form``, the most frequent form that explains each misread word; ties go to the greater form."""
    return candidate_forms(words).groupBy("word").agg(F.max_by("form", F.struct("n_form", "form")).alias("form"))


#: Marks a compound broken at its own hyphen until its parts are joined; a noncharacter, so no text holds it.
STAYS = "\ufdd1"


def is_scanned(lines: list[str]) -> bool:
    """Whether the stripped lines of a text break as on a page: before a small letter, digit or bracket, behind a hyphen, or without a stop before a capital that would not have fitted in the width of the lines."""
    full = [x for x in lines if x]
    for a, b in zip(full, full[1:]):
        if (a[-1].isalnum() or a[-1] in _BEFORE_BREAK) and (b[0].islower() or b[0].isnumeric() or b[0] == "("):
            return True
    if any(len(a) > 1 and a[-1] in HYPHEN and a[-2].isalpha() for a in lines[:-1]):
        return True
    width = max(map(len, lines))
    if width > WIDEST:
        return False
    return any(len(a) >= WRAPPED and b and b[0].isupper() and " " in a and (a[-1].isalnum() or a[-1] in _BEFORE_BREAK) and len(a) + 1 + len(b.split(" ", 1)[0]) > width for a, b in zip(lines, lines[1:]))


@lru_cache(maxsize=50_000)
def _name_words(name: str) -> frozenset[str]:
    return frozenset(_APART.split(skeleton_of(_MASK.sub("#", re.sub(r"\.[a-z]{2,4}$", "", name.lower())))))


def _key(core: str) -> bytes:
    return blake2b(core.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@lru_cache(maxsize=50_000)
def _core(line: str) -> tuple[str, bool, int | None, bool]:
    """A line without its page number, masked, as a skeleton; whether it had a number, which, and whether it is in capitals."""
    core = _DRESS.sub("", line) if line[0].isdigit() or line[-1].isdigit() else line
    own = _OWN_NUMBER.search(line)
    shouted = len(core) >= 10 and " " in core and core.upper() == core
    return _APART.sub(" ", skeleton_of(_MASK.sub("#", core))).strip(" "), core != line, int(own[1] or own[2]) if own else None, shouted


LINES = "ref_id bigint, line_no int, broken boolean, line string, core binary, is_page boolean, dressed boolean, strong boolean, titled boolean, section binary"


def _page_lines(ref, name, page, text, always: bool) -> Iterator[tuple]:
    """The ``LINES`` of one text; of texts that do not break as on a page only those that may be furniture."""
    raws = text.split("\n")
    lines = [x.strip(_STRIP) for x in raws]
    broken = always or len(lines) > 1 and is_scanned(lines)
    names = _name_words(name) if name else frozenset()
    feeds, out = 0, []
    figure = [bool(x) and x[-1] in "0123456789.,)%" and _FIGURE.fullmatch(x) is not None for x in lines]
    for i, x in enumerate(lines):
        feeds += raws[i].count("\f")
        core = key = section = None
        dressed = strong = titled = is_page = False
        if x:
            expected = None if page is None else page + feeds
            if x[-1] in "0123456789)]-–—" and (bare := _BARE.fullmatch(x) is not None) | (clothed := _NUMBER_LINE.fullmatch(x) is not None):
                number = int(_BARE.search(x)[0])
                block = i > 0 and figure[i - 1] or i + 1 < len(lines) and figure[i + 1]
                is_page = number == expected if expected is not None else clothed or bare and not block
            if not is_page and len(x) >= 3 and x[-1] not in _STOPS and x[-1] not in HYPHEN and sum(map(str.isalpha, x)) >= 2:
                core, dressed, number, shouted = _core(x)
                strong = shouted or dressed and number is not None and number == expected
                parts = [p for p in core.split(" ") if p and p != "#"]
                titled = len(parts) >= 3 and names.issuperset(parts)
                if core.startswith("# # ") and x[0].isdigit() and _SECTION.fullmatch(x) and x.split(" ", 1)[1][0].isupper():
                    section = _key(core[4:])
                key = _key(core) if core else None
        if broken or key or is_page:
            out.append([ref, i + 1, broken, x, key, is_page, dressed, strong, titled, section])
    if not broken and any(o[5] or o[8] for o in out):  # the page's number or the document's name tell a page as well
        return _page_lines(ref, name, page, text, True)
    if not broken:
        for o in out:
            o[3] = None
    return iter(out)


def lines_of(rows: DataFrame, always: bool = False) -> DataFrame:
    """The lines of rows of scanned pages, and of others those that may be furniture, see ``LINES``: one pass over each text, in which a line sees its whole text.

    ``rows``: ``ref_id``, ``document_name``, ``page_number``, ``text``. A repeated row gives its lines once.
    """
    schema = pa.schema([("ref_id", pa.int64()), ("line_no", pa.int32()), ("broken", pa.bool_()), ("line", pa.string()), ("core", pa.binary()), ("is_page", pa.bool_()), ("dressed", pa.bool_()), ("strong", pa.bool_()), ("titled", pa.bool_()), ("section", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [line for row in zip(*(c.to_pylist() for c in b.columns)) for line in _page_lines(*row, always)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    read = rows.where("ref_id IS NOT NULL AND text IS NOT NULL").select(F.col("ref_id").cast("bigint").alias("ref_id"), "document_name", F.col("page_number").cast("int").alias("page_number"), "text")
    return read.mapInArrow(run, LINES).repartition("ref_id").dropDuplicates(["ref_id", "line_no"])


def classified(rows: DataFrame) -> DataFrame:
    """The lines of scanned pages and of furniture with ``role``: ``page_number``, ``header``, ``blank`` or ``text``.

    Headers are lines that say the document's name, or whose masked skeleton carries a page number or
    stands in capitals in a tenth of its occurrences or more. Rows with a header that carries a page
    number count as scanned too.
    """
    lines = checkpoint(lines_of(rows))
    stats = lines.where("core IS NOT NULL").groupBy("core").agg(F.count("*").alias("n"), F.count_if(F.col("dressed") | F.col("strong")).alias("n_dressed"), F.count_if("strong").alias("n_strong"))
    known = stats.where(((F.col("n_strong") >= 1) | (F.col("n_dressed") >= 2)) & (F.col("n_dressed") >= DRESSED * F.col("n"))).select("core")
    # titles of numbered sections, which running headers repeat without their numbers
    known = known.unionByName(lines.where("section IS NOT NULL").select(F.col("section").alias("core"))).distinct()
    loose = lines.where("core IS NOT NULL AND NOT titled").select("ref_id", "line_no", "core", "broken", (F.col("dressed") | F.col("strong")).alias("own"))
    heads = salted_join(loose, known, ["core"], F.col("ref_id"), "left_semi")
    # per row, so that the lines keep their partitioning: a row has as many as it has lines
    heads = checkpoint(heads.groupBy("ref_id").agg(F.collect_set("line_no").alias("heads"), F.bool_or(F.col("own") & ~F.col("broken")).alias("found")))
    more = checkpoint(lines_of(rows.join(heads.where("found").select("ref_id"), "ref_id", "left_semi"), True))
    plain = lines.join(heads.where("found").select("ref_id"), "ref_id", "left_anti").where(F.col("broken") | F.col("core").isNotNull() | F.col("is_page"))
    every = plain.unionByName(more).join(heads.select("ref_id", "heads"), "ref_id", "left")
    head = F.col("titled") | F.coalesce(F.array_contains("heads", F.col("line_no")), F.lit(False))
    role = F.when(F.col("is_page"), "page_number").when(head, "header").when(F.col("line") == "", "blank").otherwise("text")
    return every.select("ref_id", "line_no", "line", "broken", role.alias("role")).where("broken OR role <> 'text'")


def _joints(lines: DataFrame) -> DataFrame:
    """Running lines that end in a hyphen behind a word, with the beginning of the next running line of the row (null if none follows)."""
    behind = W.partitionBy("ref_id").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1)
    text = F.when(F.col("role") == "text", F.struct("line_no", "line"))
    following = lines.where("broken").withColumn("next", F.last(text, ignorenulls=True).over(behind))
    ends = following.where((F.col("role") == "text") & F.substring("line", -1, 1).isin(*HYPHEN) & F.col("line").rlike(r"[\p{L}\p{N}].$"))
    a, b = F.regexp_extract("line", r"([\p{L}\p{N}]+).$", 1), F.regexp_extract("next.line", r"^([\p{L}\p{N}]+)", 1)
    ends = ends.select("ref_id", "line_no", F.col("next.line_no").alias("next_no"), a.alias("raw_a"), F.coalesce(b, F.lit("")).alias("raw_b"), (~F.col("line").endswith("-")).alias("soft"))
    ends = ends.withColumn("a", F.lower("raw_a")).withColumn("b", F.lower("raw_b"))
    return ends.where(F.col("a").rlike(r"\p{L}")).withColumn("joined", F.concat("a", "b")).withColumn("pair", F.concat_ws("-", "a", "b"))


def _is_code(stretch: str) -> bool:
    """Whether a stretch between blanks is an encoded string: signs, digits beside letters and capitals behind small letters in one."""
    return re.search(r"[+/=_\\@#]", stretch) is not None and re.search(r"\d[^\W\d_]|[^\W\d_]\d", stretch) is not None and re.search(r"[a-z][A-Z]", stretch) is not None


TOKENS = "ref_id bigint, line_no int, pos int, token string, word string, form string, before string, after string, first boolean, last boolean"


def _line_tokens(line: str, common: set[str]) -> Iterator[tuple]:
    """The rare words of a line, and the parts of its numbers that letters were read into, with ``form``; by place among the line's words."""
    codes = [m.span() for m in re.finditer(r"\S+", line) if _is_code(m[0])] if re.search(r"[+/=_\\@#]", line) else []
    parts = list(PART.finditer(line))
    low = [m[0].lower() for m in parts]
    cut = len(line) > 1 and line[-1] in HYPHEN
    k = 0
    while k < len(parts):
        # a number with its inner stops and commas is one
        end = k + 1
        while end < len(parts) and parts[end].start() == parts[end - 1].end() + 1 and line[parts[end - 1].end()] in ".,":
            end += 1
        begin = parts[k].start()
        whole = line[begin : parts[end - 1].end()]
        m = _NUMBER.fullmatch(whole) if not _LETTERS_READ.isdisjoint(whole) else None
        number = m is not None and (any(c.isdigit() for c in whole) or m[1] == "Q" and len(m[2]) == 1)
        if number and not any(c in m[2] for c in _READ):
            number = False
        if not any(a <= begin < z for a, z in codes):
            for j in range(k, end):
                token = parts[j][0]
                if number:
                    form = (m[1] or "") + token[len(m[1] or "") :].translate(_FIGURES_READ) if j == k else token.translate(_FIGURES_READ)
                    if form == token:
                        continue
                elif low[j] in common or not any(c < "\u0250" and c.isalpha() or "\u1e00" <= c < "\u1f00" for c in token):
                    continue
                else:
                    form = None
                yield j, token, low[j], form, low[j - 1] if j else None, low[j + 1] if j + 1 < len(low) else None, j == 0, cut and j == len(parts) - 1
        k = end


def _rare_tokens(rows: DataFrame, common: set[str]) -> DataFrame:
    """``TOKENS`` of all texts; texts of common words alone are passed over as a whole."""
    held = rows.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("ref_id", pa.int64()), ("line_no", pa.int32()), ("pos", pa.int32()), *((c, pa.string()) for c in ("token", "word", "form", "before", "after")), ("first", pa.bool_()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            made = []
            for ref, text in zip(*(c.to_pylist() for c in b.columns)):
                odd = set(PART.findall(text.lower())).difference(known)
                if odd:
                    for i, line in enumerate(text.split("\n")):
                        line = line.strip(_STRIP)
                        if line and not odd.isdisjoint(PART.findall(line.lower())):
                            made.extend((ref, i + 1, *t) for t in _line_tokens(line, known))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return rows.where("ref_id IS NOT NULL AND text IS NOT NULL").select(F.col("ref_id").cast("bigint").alias("ref_id"), "text").mapInArrow(run, TOKENS)


def _with_forms(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Numbers with their own ``form`` and ``n_form`` 0, words once with each form that explains them; the texts are read once for both."""
    # numbers meet no word: their key holds a sign, and differs by row so that they stay spread
    key = F.when(F.col("form").isNull(), F.col("word")).otherwise(F.concat(F.lit("#"), F.col("ref_id")))
    met = tokens.withColumn("_key", key).join(forms.select(F.col("word").alias("_key"), F.col("form").alias("_form"), F.col("n_form").alias("_n")), "_key", "left")
    met = met.where("form IS NOT NULL OR _form IS NOT NULL").withColumn("form", F.coalesce("form", "_form")).withColumn("n_form", F.coalesce("_n", F.lit(0).cast("bigint")))
    return met.drop("_key", "_form", "_n")


def neighbour_counts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``n``, how often word ``b`` follows word ``a`` in the texts, for the ``pairs`` asked about."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*zip(*seen), list(seen.values())), (pa.string(), pa.string(), pa.int64()))], names=["a", "b", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                words = PART.findall(t.lower())
                seen.update(zip(words, words[1:]))
            if len(seen) > 500_000:
                yield send()
                seen.clear()
        if seen:
            yield send()

    counted = rows.where("text IS NOT NULL").select("text").mapInArrow(count, "a string, b string, n bigint")
    return salted_join(counted, pairs.distinct(), ["a", "b"], F.col("n"), "left_semi").groupBy("a", "b").agg(F.sum("n").alias("n"))


def supported(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Occurrences of misread words with one ``form`` each: the one that comes most often beside their neighbours, then the most frequent, then the greater.

    ``met``: ``TOKENS`` with each ``form`` and ``n_form`` that explains the word. Words that one form explains need no context; only for others are neighbours counted, over all texts.
    """
    at = ["ref_id", "line_no", "pos"]
    per = W.partitionBy(*at)
    met = checkpoint(met.withColumn("n_forms", F.count("*").over(per)))
    several = met.where("n_forms > 1")
    if several.isEmpty():
        return met.drop("n_forms", "n_form")
    left, right = several.select(F.col("before").alias("a"), F.col("form").alias("b")), several.select(F.col("form").alias("a"), F.col("after").alias("b"))
    counts = checkpoint(neighbour_counts(rows, left.unionByName(right).where("a IS NOT NULL AND b IS NOT NULL")))
    ahead, behind = counts.select(F.col("a").alias("before"), F.col("b").alias("form"), F.col("n").alias("n_before")), counts.select(F.col("a").alias("form"), F.col("b").alias("after"), F.col("n").alias("n_after"))
    weighed = several.join(ahead, ["before", "form"], "left").join(behind, ["form", "after"], "left").fillna(0, ["n_before", "n_after"])
    best = weighed.withColumn("place", F.row_number().over(per.orderBy(F.desc(F.col("n_before") + F.col("n_after")), F.desc("n_form"), F.desc("form")))).where("place = 1")
    return met.where("n_forms = 1").unionByName(best.select(met.columns)).drop("n_forms", "n_form")


def noise(rows: DataFrame) -> dict[str, DataFrame]:
    """The classified ``lines`` of the rows, their ``joints`` with the decision ``cut``, and ``misread`` words with their place ``pos`` in the line (null for halves of cut words) and what they should be."""
    # materialised once each: the lexicon, the lines and the corrections are read several times
    words = checkpoint(lexicon(rows))
    lines = checkpoint(classified(rows))
    ends = _joints(lines)
    counts = words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    pairs = words.where(F.col("word").contains("-")).select(F.col("word").alias("pair"), F.col("n").alias("n_pair"))
    ends = checkpoint(ends.join(counts, "joined", "left").join(pairs, "pair", "left").fillna(0, ["n_joined", "n_pair"]))
    built = ends.where("n_joined = 0 AND n_pair = 0 AND b <> ''").select(F.col("joined").alias("word"), F.lit(0).cast("bigint").alias("n")).distinct()
    forms = checkpoint(candidate_forms(words.unionByName(built)))
    fixes = forms.groupBy("word").agg(F.max_by("form", F.struct("n_form", "form")).alias("form"))

    joined_fix = fixes.select(F.col("word").alias("joined"), F.col("form").alias("joined_form"))
    a_count = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    b_fix = fixes.select(F.col("word").alias("b"), F.col("form").alias("b_form"))
    known_b = words.select(F.col("word").alias("b_form"), F.col("n").alias("n_b"))
    open_ = ends.where("n_joined = 0 AND n_pair = 0").join(joined_fix, "joined", "left").join(a_count, "a", "left").join(b_fix, "b", "left")
    open_ = open_.withColumn("b_form", F.coalesce("b_form", "b")).join(known_b, "b_form", "left").fillna(0, ["n_a", "n_b"])
    compound = ~F.col("soft") & (F.col("n_a") >= LEAST * RATIO) & (F.col("n_b") >= LEAST * RATIO)
    no_rest = (F.col("b") == "") & ~F.col("soft") & (F.col("n_a") >= LEAST * RATIO)
    cut_open = F.when(F.col("joined_form").isNotNull(), True).otherwise(~compound & ~no_rest)
    shared = ["ref_id", "line_no", "next_no", "raw_a", "raw_b", "joined"]
    settled = ends.where("n_joined > 0 OR n_pair > 0").join(joined_fix, "joined", "left").select(*shared, "joined_form", (F.col("n_joined") > F.col("n_pair")).alias("cut"))
    joints = checkpoint(settled.unionByName(open_.select(*shared, "joined_form", cut_open.alias("cut"))))

    plain = words.join(fixes, "word", "left_anti").where(F.col("word").rlike(r"^(?:\p{L}+|[0-9]+)$") & ~F.col("word").rlike(f"^(?:fy|q)?[{_READ.lower()}]+$"))
    common = {r["word"] for r in plain.orderBy(F.desc("n"), "word").limit(COMMON).collect()}
    tokens = checkpoint(_with_forms(_rare_tokens(rows, common), forms).distinct())
    tokens = tokens.join(lines.where("role IN ('header', 'page_number')").select("ref_id", "line_no"), ["ref_id", "line_no"], "left_anti")
    # words that a line end cuts are judged as wholes
    cut = joints.where("cut")
    tokens = tokens.join(cut.select("ref_id", "line_no", F.lit(True).alias("last")), ["ref_id", "line_no", "last"], "left_anti")
    tokens = tokens.join(cut.where("raw_b <> ''").select("ref_id", F.col("next_no").alias("line_no"), F.lit(True).alias("first")), ["ref_id", "line_no", "first"], "left_anti")
    pages = lines.where("broken").select("ref_id").distinct().withColumn("page", F.lit(True))
    tokens = tokens.join(pages, "ref_id", "left")
    # words come from any text, numbers of letters and short words only from texts that are known to be scanned
    telling = F.col("page") | (F.col("n_form") > 0) & (F.char_length("word") >= TELLING)
    tokens = checkpoint(_of_pages(tokens, telling))
    chosen = supported(rows, tokens.where("n_form > 0")).unionByName(tokens.where("n_form = 0").drop("n_form"))
    first_up = F.substring("token", 1, 1) != F.substring("word", 1, 1)
    spelt = F.when((F.col("word") != F.col("token")) & first_up, F.concat(F.upper(F.substring("form", 1, 1)), F.expr("substring(form, 2)"))).otherwise(F.col("form"))
    wrong = chosen.select("ref_id", "line_no", "pos", spelt.alias("form"), F.col("page").isNull().alias("late"))
    broken = joints.where("cut AND joined_form IS NOT NULL")
    in_a = ~F.col("joined_form").startswith(F.lower("raw_a"))
    halves = broken.select("ref_id", F.when(in_a, F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"), F.lit(None).cast("int").alias("pos"), F.col("joined_form").alias("form"), F.lit(False).alias("late"))
    return {"lines": lines, "joints": joints, "misread": wrong.unionByName(halves).distinct()}


def _of_pages(tokens: DataFrame, telling: Column) -> DataFrame:
    """The tokens of rows that are known to be scanned or that hold a telling word."""
    told = tokens.where(F.coalesce(telling, F.lit(False))).select("ref_id").distinct()
    return tokens.join(told, "ref_id", "left_semi")


def noisy_lines(rows: DataFrame) -> DataFrame:
    """``ref_id``, ``line_no`` and ``kind`` (``hyphen``, ``misread``, ``header``, ``page_number``) of noisy lines; a line may have several kinds.

    ``rows``: ``ref_id``, ``document_name``, ``page_number``, ``text``; lines are split at line feeds and
    counted from 1 with empty ones. Null and empty texts give none, repeated rows one result, an empty
    table none; unknown pages and names only withhold their evidence. A hyphen at the end of the
    last running line counts unless what precedes it is a frequent word. Misread words are sought in
    all texts, misread numbers in those that are known to be of scanned pages, by their layout, their
    furniture or a misread word.
    """
    found = noise(rows)
    furniture = found["lines"].where("role IN ('header', 'page_number')").select("ref_id", "line_no", F.col("role").alias("kind"))
    hyphens = found["joints"].where("cut").select("ref_id", "line_no", F.lit("hyphen").alias("kind"))
    misread = found["misread"].select("ref_id", "line_no", F.lit("misread").alias("kind")).distinct()
    return furniture.unionByName(hyphens).unionByName(misread)


def paragraphs(rows: DataFrame) -> DataFrame:
    """``ref_id``, ``paragraph_no`` and ``text``: the running text of each row of a scanned page, repaired and reflowed.

    Furniture is left out, cut words are joined, misread words and numbers replaced. A paragraph ends
    where a line ends in a full stop and is followed by a blank line, furniture or the row's end.
    Rows that are not of scanned pages are not in the result.
    """
    found = noise(rows)
    fix = found["misread"].where("pos IS NOT NULL").groupBy("ref_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("pos", "form"))).alias("fixes"))
    joints = found["joints"].where("cut").select("ref_id", "line_no", "joined_form", "raw_a")
    kept = found["joints"].where("NOT cut AND next_no IS NOT NULL").select("ref_id", "line_no", F.lit(True).alias("compound"))
    comes = found["joints"].where("cut").select("ref_id", F.col("next_no").alias("line_no"), "raw_b", F.lit(True).alias("continues")).where("line_no IS NOT NULL")
    order = W.partitionBy("ref_id").orderBy("line_no")
    # texts that only a misread word tells to be scanned have not given all of their lines yet
    late = rows.join(found["misread"].where("late").select("ref_id").distinct(), "ref_id", "left_semi")
    late = lines_of(late, True).select("ref_id", "line_no", "line", F.when(F.col("is_page"), "page_number").when(F.col("titled"), "header").when(F.col("line") == "", "blank").otherwise("text").alias("role"))
    lines = found["lines"].where("broken").drop("broken").unionByName(late)
    lines = lines.withColumn("gap", F.coalesce(F.lag(F.col("role") != "text").over(order), F.lit(True))).where("role = 'text'")
    lines = lines.join(fix, ["ref_id", "line_no"], "left").join(joints, ["ref_id", "line_no"], "left").join(comes, ["ref_id", "line_no"], "left").join(kept, ["ref_id", "line_no"], "left")
    # words are put in by their place, so no other word that holds their letters is touched
    words = F.transform(F.regexp_extract_all("line", F.lit(WORD_PART), F.lit(0)), lambda w, i: F.coalesce(F.col("fixes")[i], w))
    put = F.array_join(F.flatten(F.zip_with(F.split("line", WORD_PART, -1), words, lambda a, w: F.array(a, F.coalesce(w, F.lit(""))))), "")
    body = F.when(F.col("fixes").isNotNull(), put).otherwise(F.col("line"))
    whole = F.coalesce("joined_form", F.concat("raw_a", F.coalesce("next_b", F.lit(""))))
    lines = lines.withColumn("ends", F.coalesce(F.lag(F.col("line").rlike(r"[.!?:]['\")\]]?$")).over(order), F.lit(True)))
    begins = F.when(F.col("gap") & F.col("ends"), 1).otherwise(0)
    lines = lines.withColumn("begins", begins).withColumn("paragraph_no", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    lines = lines.withColumn("next_b", F.lead("raw_b").over(order))
    head = F.when(F.col("continues"), F.ltrim(F.regexp_replace(body, r"^[\p{L}\p{N}]+", ""))).otherwise(body)
    tail = F.when(F.col("raw_a").isNotNull(), F.concat(F.regexp_replace(head, r"[\p{L}\p{N}]+[" + HYPHEN + "]$", ""), whole)).otherwise(head)
    made = lines.select("ref_id", "paragraph_no", "line_no", F.when(F.col("compound"), F.concat(tail, F.lit(STAYS))).otherwise(tail).alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), " ")
    return made.groupBy("ref_id", "paragraph_no").agg(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(STAYS + " "), F.lit("")), r"\s+", " "), r" ([.,;:!?%)])", "$1").alias("text"))
