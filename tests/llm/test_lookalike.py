import itertools
import unicodedata

import pytest

from tabulae.llm.lookalike import canonical_texts, lookalike_classes, lookalike_pairs, mapping

SCHEMA = "doc_id bigint, text string, form string, key string"
ALIKE = [
    ("Customer", "Сustоmеr"), ("Report 12", "\uff32\uff45\uff50\uff4f\uff52\uff54 \uff11\uff12"), ("café", "cafe\u0301"), ("office", "o\ufb03ce"), ("non-current", "non\u2011current"), ("a b", "a\u00a0b"), ("a b", "a\u202fb"),
    ("word", "wo\u200brd"), ("word", "\ufeffword"), ("co\u00adop", "coop"), ("Ångström", "A\u030angstro\u0308m"), ("ệ", "e\u0302\u0323"), ("ệ", "e\u0323\u0302"), ("νοτε", "voτε"), ("ёж", "е\u0308ж"),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("m²", "m2"), ("a,b", "ab"), ("a b", "a  b"), ("a\nb", "a\r\nb"), ("0", "O"), ("1", "l"), ("a\tb", "a b"), ("½", "1/2"), ("x–y", "x-y"), ("👩\u200d🏭", "👩🏭")]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def plain(text):
    return unicodedata.normalize("NFC", "".join(mapping().get(c, c) for c in text))


@pytest.fixture(scope="module")
def forms(spark):
    texts = [t for p in ALIKE + DIFFERENT for t in p] + ["", None, " ", "\u00a0", "x" * 20_000 + "é" + "о" * 20_000, "\u0301", "\u200b"]
    return {r.text: r.form for r in canonical_texts(frame(spark, texts)).collect()}


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(forms, a, b):
    assert forms[a] == forms[b]


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(forms, a, b):
    assert forms[a] != forms[b]


def test_same_as_plain_form(forms):
    assert forms[None] is None and forms[""] == "" and forms["\u200b"] == "" and forms["\u00a0"] == " "
    for text, form in forms.items():
        if text and "\U0001f469" not in text:
            assert form == plain(text), text


def test_pairs_against_brute_force(spark):
    texts = [t for p in ALIKE for t in p] * 2 + [" ", "\u00a0", "", None, "Report 12", "\u200b"]
    got = sorted(tuple(r) for r in lookalike_pairs(frame(spark, texts)).collect())
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a and b and a != b and plain(a) == plain(b) and plain(a).strip())
    assert got == want


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all(r.form == (None if r.text is None else plain(r.text)) for r in canonical_texts(docs).collect() if r.text is None or "\u200d" not in r.text)


def test_empty_and_repeated(spark):
    assert lookalike_pairs(frame(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (2, "a\u00a0b", "", "")], SCHEMA)
    assert [tuple(r) for r in lookalike_pairs(twice).collect()] == [(1, 2)]


def test_classes_hold_copies_and_texts(spark):
    rows = spark.createDataFrame([(1, "caf\u00e9"), (2, "cafe\u0301"), (3, "cafe\u0301"), (4, "cafe"), (5, None), (6, " "), (7, "\u00a0"), (1, "caf\u00e9")], "doc_id bigint, text string")
    got = {(r.doc_id, r.class_id, r.copy_of, r.n_texts) for r in lookalike_classes(rows).collect()}
    assert got == {(1, 1, 1, 2), (2, 1, 2, 2), (3, 1, 2, 2)}
    assert {tuple(r) for r in lookalike_pairs(rows).collect()} == {(1, 2), (1, 3)}


def test_long_stretches_are_cut_where_nothing_composes(spark):
    import unicodedata

    han, kana, jamo = "\u6c34\u96fb" * 70, "\u30ab\u3099" * 50, "\u1112\u1161\u11ab" * 40
    text = han + kana + jamo + "e\u0301\u0323" * 60 + "\uff76\uff9e" * 40 + "\u09c7\u09be" * 50
    got = canonical_texts(spark.createDataFrame([(1, text), (2, "x" * 31 + "e\u0323\u0301" * 3)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.form for r in got} == {1: unicodedata.normalize("NFC", text.replace("\uff76\uff9e", "\u30ab\u3099")), 2: unicodedata.normalize("NFC", "x" * 31 + "e\u0323\u0301" * 3)}
