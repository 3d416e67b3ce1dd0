import pytest

from pyspark.sql import functions as F

from tabulae.llm import scanned
from tabulae.llm.scanned import CONFUSIONS, corrections, explained, noisy_lines, paragraphs, readings, skeleton, skeleton_of

SCHEMA = "ref_id bigint, document_name string, page_number int, text string, line string, core string, broken int"
PLAIN = "The pension scheme reported the consolidated revenue and non-current assets within the approved tolerance. The programme continued."
PAGE = """Acme Energy – Annual Report 2024

The pension scheme reported the consoli-
7
Liquidity and funding – 7
dated revenue and non-
current assets within the approved toler¬
ance. The prograrnme continued for 2O24 by
12.S percent.
"""


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "other.pdf", 1, PLAIN, "x", "y", 1) for i in range(100, 160)]
    data += [(1, "acme_energy_annual_report_2024.pdf", 7, PAGE, "x", "y", 1)] * 2
    data += [(2, None, None, "Liquidity and funding – 8\nthe pension scheme reported\nthe revenue.", "x", "y", 1), (3, "", 4, None, "x", "y", 1), (4, "", 4, "", "x", "y", 1), (5, "a", 4, "Vessels\n188\n195\n4,201", "x", "y", 1), (6, "a", 9, "\n\n9\n", "x", "y", 1)]
    return spark.createDataFrame(data, SCHEMA)


def test_kinds(rows):
    got = {(r.ref_id, r.line_no, r.kind) for r in noisy_lines(rows).collect()}
    assert got == {
        (1, 1, "header"), (1, 3, "hyphen"), (1, 4, "page_number"), (1, 5, "header"), (1, 7, "hyphen"), (1, 8, "misread"), (1, 9, "misread"),
        (2, 1, "header"), (6, 3, "page_number"),
    }


def test_paragraphs(rows):
    got = {(r.ref_id, r.paragraph_no): r.text for r in paragraphs(rows).collect()}
    assert got[1, 1] == "The pension scheme reported the consolidated revenue and non-current assets within the approved tolerance. The programme continued for 2024 by 12.5 percent."


def test_empty(spark):
    assert noisy_lines(spark.createDataFrame([], SCHEMA)).count() == 0 and paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("word", "form", "want"), [("prograrnme", "programme", True), ("n0rthern", "northern", True), ("assiimptions", "assumptions", True), ("dcprcciation", "depreciation", True), ("cost", "cast", True), ("cast", "cost", False), ("abc", "xyz", False)])
def test_explained(word, form, want):
    assert explained(word, form) is want


def test_corrections_need_frequent_forms(spark):
    words = spark.createDataFrame([("percent", 500), ("percenf", 3), ("farm", 90), ("form", 80), ("rn", 900), ("m", 1), ("тест", 5)], "word string, n bigint")
    assert [(r.word, r.form) for r in corrections(words).collect()] == [("percenf", "percent")]


def test_confusions_beside_confusable_glyphs(spark):
    right = ["liability", "volume", "delivered", "procurement", "filial"]
    misread = ["liabihty", "voliime", "dehvered", "prociirement", "fihal"]
    words = spark.createDataFrame([(w, 400) for w in right] + [(w, 2) for w in misread], "word string, n bigint")
    assert {r.word: r.form for r in corrections(words).collect()} == dict(zip(misread, right))


def test_skeleton_is_the_same_whatever_stands_beside_a_confusion(spark):
    beside = ["", *"abcdehilmnoruvw"]
    pairs = [(a + t + b, a + r + b) for t, r in CONFUSIONS for a in beside for b in beside]
    rows = spark.createDataFrame(pairs, "t string, r string")
    assert rows.where(skeleton(F.col("t")) != skeleton(F.col("r"))).count() == 0
    assert all(r.s == skeleton_of(r.t) for r in rows.select("t", skeleton(F.col("t")).alias("s")).collect())


WRAPPED = "Der Konzern erhöhte die Verpflichtungen nach der\nEingliederurig erworbener Gesellschaften im Quartal 1 2025. Weitere\nErläuterungen enthält der Anhang."


def test_pages_whose_lines_break_before_capitals(spark):
    data = [(i, "other.pdf", 1, "Die Eingliederung erworbener Gesellschaften.", "x", "y", 1) for i in range(100, 160)]
    data += [(1, None, None, WRAPPED, "x", "y", 1), (2, None, None, "Environmental indicators of the group\nThe Eingliederurig of businesses was reported by the group in 2024.\nThe rest.", "x", "y", 1)]
    data += [(3, None, 7, "Die Eingliederurig erworbener Gesellschaften.\nWeitere Angaben fehlen.\nPage 7", "x", "y", 1), (4, None, 7, "Environmental indicators\n- The Eingliederurig of businesses.\n- The rest.", "x", "y", 1)]
    rows = spark.createDataFrame(data, SCHEMA)
    assert {(r.ref_id, r.line_no) for r in noisy_lines(rows).where("kind = 'misread'").collect()} == {(1, 2), (2, 2), (3, 1), (4, 2)}  # a misread word tells a page by itself
    got = {r.ref_id: r.text for r in paragraphs(rows).collect()}
    assert {k: got[k] for k in (1, 3)} == {1: WRAPPED.replace("urig", "ung").replace("\n", " "), 3: "Die Eingliederung erworbener Gesellschaften. Weitere Angaben fehlen."}
    assert all("Eingliederung" in got[k] and "urig" not in got[k] for k in (2, 4))


def test_misread_quarters_of_letters_alone(spark):
    rows = spark.createDataFrame([(1, None, None, "the pension scheme reported for Ql\nand the revenue for QZ.", "x", "y", 1)], SCHEMA)
    assert {(r.line_no, r.kind) for r in noisy_lines(rows).collect()} == {(1, "misread"), (2, "misread")}


def test_words_are_replaced_by_their_place(spark):
    data = [(i, None, None, "It may be that the marker said so.", "x", "y", 1) for i in range(100, 400)]
    data += [(1, None, None, "It rnay be that the xrnayx marker said so and\nrnayor of 12.S or 1.2.", "x", "y", 1)]
    got = [r.text for r in paragraphs(spark.createDataFrame(data, SCHEMA)).collect()]
    assert got == ["It may be that the xrnayx marker said so and rnayor of 12.5 or 1.2."]


def test_neighbours_decide_between_forms(spark):
    right = ["the closed form of it"] * 300 + ["the new farm in it"] * 400
    data = [(i, None, None, t, "x", "y", 1) for i, t in enumerate(right, 100)]
    data += [(1, None, None, "this was the closed\nand closed f0rm of it\nand the new f0rm in it", "x", "y", 1)]
    got = {r.ref_id: r.text for r in paragraphs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {1: "this was the closed and closed form of it and the new form in it"}
    words = spark.createDataFrame([("cat", 900), ("cot", 2000), ("c0t", 1)], "word string, n bigint")
    assert {(r.word, r.form) for r in scanned.candidate_forms(words).collect()} >= {("c0t", "cot")}


def test_crowded_skeletons_give_the_same_forms(spark, monkeypatch):
    words = spark.createDataFrame([("liability", 400), ("liabihty", 2), ("1iability", 1), ("volume", 300), ("v0lume", 2), ("vo1iime", 1), ("rn", 900), ("but", 500), ("hut", 4000)], "word string, n bigint")
    few = {tuple(r) for r in scanned.candidate_forms(words).collect()}
    monkeypatch.setattr(scanned, "COMPARED", 0)
    assert few == {tuple(r) for r in scanned.candidate_forms(words).collect()} and len(few) >= 4


def test_readings_are_what_explains(spark):
    words = ["liabihty", "prograrnme", "vo1iime", "dcprcciation", "b0dy", "vvind"]
    forms = ["liability", "programme", "volume", "depreciation", "body", "wind", "bony", "wand"]
    for w in words:
        assert {f for f in forms if explained(w, f)} == {f for f in forms if f in readings(w)}


def test_one_line_pages_and_codes(spark):
    data = [(i, None, None, "The programme continued in the sector.", "x", "y", 1) for i in range(100, 200)]
    data += [(1, None, None, "The prograrnme continued by 12.S percent.", "x", "y", 1), (2, None, None, "Key aB9/prograrnme+Zz9Q= kept.", "x", "y", 1), (3, None, None, "Model S8 and 12.S remain.", "x", "y", 1)]
    rows = spark.createDataFrame(data, SCHEMA)
    assert {(r.ref_id, r.line_no, r.kind) for r in noisy_lines(rows).collect()} == {(1, 1, "misread")}
    assert {r.ref_id: r.text for r in paragraphs(rows).collect()} == {1: "The programme continued by 12.5 percent."}


def test_long_headers_and_wide_page_numbers(spark):
    title = "Consolidated statement of changes in equity and of the other comprehensive income of the group and its parts"
    data = [(i, None, i, f"{title} – {i}\nThe board met\nin the year.\npage{' ' * 30}{i}", "x", "y", 1) for i in range(10, 14)]
    got = {(r.ref_id, r.line_no, r.kind) for r in noisy_lines(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(i, 1, "header") for i in range(10, 14)} | {(i, 4, "page_number") for i in range(10, 14)}


def test_rare_tokens_meet_their_forms_in_one_pass_over_the_texts(spark):
    rows = spark.createDataFrame([(1, "Revenue of the hedqing plan in QZ 2O19"), (2, "a hedqing odd"), (3, None)], "ref_id bigint, text string")
    forms = spark.createDataFrame([("hedqing", "hedging", 40), ("hedqing", "hedsing", 30), ("qz", "oz", 9)], "word string, form string, n_form bigint")
    met = scanned._with_forms(scanned._rare_tokens(rows, {"a", "of", "the", "plan", "in", "odd"}), forms)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted((r.ref_id, r.token, r.form, r.n_form) for r in met.collect())
    assert got == [(1, "2O19", "2019", 0), (1, "QZ", "Q2", 0), (1, "hedqing", "hedging", 40), (1, "hedqing", "hedsing", 30), (2, "hedqing", "hedging", 40), (2, "hedqing", "hedsing", 30)]
