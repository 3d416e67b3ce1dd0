import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.functions.text import distinct_ignoring_case, lexical_score, shingles, uuid5
from tabulae.functions.values import numeric_value, observe, parse_period
from tabulae.operators import concepts as C
from tabulae.operators import outline as O
from tabulae.operators import profile as P
from tabulae.operators import quiz as Q
from tabulae.operators import representatives as R
from tabulae.operators import retrieval as S
from tabulae.operators import tables as T

COLUMNS = "array<struct<key:string,label:string,type:string,unit:string>>"
SCHEMA = f"table_id string, title string, page_start int, page_end int, columns {COLUMNS}, rows array<map<string,string>>, source_fragments array<int>, updated_at timestamp"


def table(spark, columns, rows):
    return spark.createDataFrame([("t", "Title", 1, 1, columns, rows, [1], None)], SCHEMA)


def test_time_series_profile(spark):
    columns = [("year", "Fiscal Year", "string", None), ("revenue", "Revenue (USD million)", "number", None)]
    rows = [{"year": f"FY{y}", "revenue": str(v)} for y, v in ((2020, 0), (2021, 0), (2022, 2), (2024, 2), (2025, 100))]
    seen = P.observed(P.cells(table(spark, columns, rows)))
    time = P.time_profile(seen).collect()[0]
    assert (time.first_period, time.last_period, time.missing) == ("FY2020", "FY2025", "FY2023")
    profiles = {r.key: r for r in P.column_profiles(seen).collect()}
    assert (profiles["year"].inferred, profiles["year"].role, profiles["revenue"].role) == ("fiscal_period", "time_period", "metric")
    numbers = P.numeric_profile(seen.where("o.number IS NOT NULL").select("col_no", F.col("o.number").alias("value")), ["col_no"]).collect()[0]
    assert (numbers.minimum, numbers.maximum, numbers.zeros, numbers.outliers, numbers.p95) == (0.0, 100.0, 2, 1, 80.4)
    assert P.table_profiles(table(spark, columns, rows)).collect()[0].suitable


def test_messy_table(spark):
    columns = [("category", "Category", "string", None), ("value", "Value", "number", None)]
    rows = [{"category": "Category", "value": "Value"}, {"category": "North", "value": "10"}, {"category": "North", "value": "10"}, {"category": "Total", "value": "20"}, {"category": "Note: unaudited", "value": None}]
    got = P.row_features(P.cells(table(spark, columns, rows))).collect()[0]
    assert (got.duplicates, got.headers, got.totals, got.footnotes) == (1, 1, 1, 1)


def test_wide_table(spark):
    columns = [("metric", "Metric", "string", None), *((f"y{y}", str(y), "number", None) for y in (2022, 2023, 2024))]
    rows = [{"metric": m, "y2022": "1", "y2023": "2", "y2024": "3"} for m in ("Revenue", "Profit")]
    assert P.table_profiles(table(spark, columns, rows)).collect()[0].orientation == "wide_time_series"


@pytest.mark.parametrize(("text", "label", "want"), [("FY24", "", "FY2024"), ("2019-20", "", "2019-20"), ("2021 Q3", "", "2021 Q3"), ("Q3-2021", "", "2021 Q3"), ("Mar 2020", "", "2020-03"), ("may", "", "month-05"), ("2023", "Year", "2023"), ("2023", "2023", "2023"), ("2023/02/28", "", "2023-02-28"), ("20240131", "x", "2024-01-31"), ("5-Jan-2020", "x", "2020-01-05")])
def test_periods(spark, text, label, want):
    got = spark.createDataFrame([(text, label, "x")], "t string, l string, text string").select(parse_period("t", "l").alias("p")).collect()[0]
    assert got.p.label == want


def test_observations(spark):
    cells = [("2023", "Revenue"), ("(1,204.5)", "x"), ("12 million", "x"), ("n/a", "x"), (None, "x"), ("yes", "x"), ("abc", None), ("5 %", "x"), ("30-02-2021", "x"), ("2021 q4", "x")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, raw string, label string").withColumn("o", F.lit(1)).drop("o")
    got = {r.i: r.o for r in observe(rows, "raw", "label").collect()}
    assert [got[i] and got[i].kind for i in range(10)] == ["integer", "number", "integer", None, None, "boolean", "string", "integer", "string", "quarter"]
    assert [got[i].number for i in (0, 1, 2, 7)] == [2023, -1204.5, 12, 5] and got[9].period.interval == 2021 * 4 + 3 and got[9].number is None


def test_numbers_in_columns(spark):
    got = spark.createDataFrame([("(1,204.5)",), ("€ 3.2 bn",), ("x",), (None,), ("12%",)], "v string").select(numeric_value("v").alias("n")).collect()
    assert [r.n for r in got] == [-1204.5, 3.2, None, None, 12.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("table_1", ["A", "a ", None, "B", " b"], "one two three two three")], "id string, names array<string>, t string")
    space = "6ba7b8119dad11d180b400c04fd430c8"
    got = df.select(uuid5(space, "id").alias("u"), distinct_ignoring_case("names").alias("n"), shingles("t").alias("s"), lexical_score(F.lit("net revenue"), F.lit("Revenue, net of tax")).alias("l")).collect()[0]
    assert got.u == str(uuid.uuid5(uuid.UUID(space), "table_1")) and got.n == ["A", "B"] and got.s == ["one two three", "two three two", "three two three"]
    assert got.l == pytest.approx(0.76 + 0.13 * 2 / 3)


@pytest.mark.parametrize(("phrase", "text", "want"), [("Customer A", "Customer 2024 2023 2022 A 19 percent", 0.82), ("Customer A", "The customer accepted a product.", 0.0), ("customers", "one customer", 1.0), ("EPS", "earnings per share", 0.95), ("R&D", "research and development costs", 0.95), ("", "x", 0.0), (None, None, 0.0)])
def test_phrases(spark, phrase, text, want):
    row = spark.createDataFrame([(phrase, text)], "phrase string, text string")
    assert row.select(C.strength(C.prepared("phrase"), C.prepared("text")).alias("s")).collect()[0].s == want
    if phrase:
        assert C.strengths_of(row, "text", [phrase]).collect()[0].strengths == [want]


def near(query, text, gap=6):
    """Greedy search from every start, word by word."""
    for i, t in enumerate(text):
        k = int(t == query[0])
        if k:
            for u in text[i + 1 : i + len(query) + gap]:
                k += k < len(query) and u == query[k]
            if k == len(query):
                return True
    return False


def test_phrases_against_brute_force(spark):
    import random

    made = random.Random(5)
    rows = [(i, " ".join(made.choices("abcd", k=made.randint(1, 3))), " ".join(made.choices("abcdefgh", k=made.randint(1, 14)))) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, p string, t string").withColumn("p", C.prepared("p")).withColumn("t", C.prepared("t")).select("i", C.strength(F.col("p"), F.col("t")).alias("s")).collect()
    for r in got:
        p, t = (rows[r.i][k].split() for k in (1, 2))
        want = 1.0 if any(t[i : i + len(p)] == p for i in range(len(t))) else 0.82 if len(p) > 1 and near(p, t) else 0.0
        assert r.s == want, rows[r.i]


def test_signals_and_scores(spark):
    asked = spark.createDataFrame([("r", "Net profit in FY 2024 in USD million", [("net profit", ["Net  Profit", "PAT", None]), (" ", None)], ["net profit", "margin"], ["Acme"], ["FY2023"], None, 1)], "run string, query string, concepts array<struct<canonical:string,variants:array<string>>>, metrics array<string>, entities array<string>, years array<string>, units array<string>, query_count int")
    s = C.signals(asked)
    row = s.collect()[0]
    assert row.concept_terms == [["net profit", "PAT"], ["margin"], ["Acme"]] and row.year_terms == ["2023", "2024"] and row.unit_terms == ["USD", "million"]
    rows = spark.createDataFrame([("r", "a", "profit after tax 2024 in USD", 0.03, 2, 1), ("r", "b", "other", None, 1, 1), ("q", "c", "x", 0.1, 1, 1)], "run string, id string, text string, rrf double, n_modes int, n_queries int")
    got = {r.id: r for r in C.scored(rows, s, "run", "text").collect()}
    assert set(got) == {"a", "b"} and got["a"].concept == round(0.95 / 3, 6) and (got["a"].year, got["a"].unit) == (0.5, 0.5)
    assert got["b"].relevance == 0.0 and got["a"].relevance == pytest.approx(0.45 * got["a"].rrf_part + 0.4 * got["a"].concept + 0.03 + 0.01 + 0.07 * 1.0, abs=2e-6)


def test_rank_fusion(spark):
    lists = [("dense", "q1", ["a", "b"]), ("sparse", "q1", ["b", "a"]), ("dense", "q2", ["a", "c"])]
    rows = [("r", m, q, p, 1.0 - k / 10) for m, q, ps in lists for k, p in enumerate(ps)]
    got = S.fuse_ranks(spark.createDataFrame(rows, "run string, mode string, query string, point string, score double"), ["run"], "point")
    assert [r.point for r in got.orderBy(F.desc("rrf"), "point").collect()] == ["a", "b", "c"]


def test_dense_search_edges(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [])], "id bigint, v array<double>")
    got = S.dense_search(vectors, vectors.where("id IN (1, 2, 3)"), "id", "v", 5).orderBy("place").collect()
    assert [(r.query_id, r["item"]) for r in got] == [(1, 1), (1, 4)]
    assert S.dense_search(vectors, vectors.where("id = 3"), "id", "v", 5).count() == 0


def test_page_ranges(spark):
    flagged = spark.createDataFrame([("d", p, 20) for p in range(4, 15)], "document_id string, page int, pages int")
    assert sorted((r.first_page, r.last_page) for r in O.page_ranges(flagged).collect()) == [(3, 9), (8, 14), (13, 15)]


def test_ancestors_with_cycle_and_orphan(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "c", "D"), ("x", "y", "X"), ("y", "x", "Y"), ("o", "zz", "O")], "node_id string, parent_id string, title string")
    chain = O.ancestors(nodes)
    paths = {r.node_id: r.path for r in O.paths(nodes, chain).collect()}
    assert paths["d"] == "A > B > C > D" and paths["o"] == "O" and len(paths) == 7


def test_quotas(spark):
    def shared(sizes, budget):
        df = spark.createDataFrame([("s", str(i), i, n) for i, n in enumerate(sizes)], "scope string, node_id string, pos int, n_items int")
        got = {r.node_id: r.quota for r in R.quotas(df, "scope", budget).collect()}
        return [got.get(str(i), 0) for i in range(len(sizes))]

    assert shared([8] * 40, 80) == [2] * 40
    assert shared([7, 5, 8], 7) == [2, 2, 3]
    assert sum(shared([3] * 10, 4)) == 4


@pytest.mark.parametrize("n", [1, 8, 9, 30, 400])
def test_representatives(n):
    matrix = np.random.default_rng(13).normal(size=(n, 12))
    got = R.representative_indices(matrix)
    assert got == sorted(set(got)) and got[0] == 0 and got[-1] == n - 1
    assert len(got) == (n if n <= 8 else min(n, 80, max(8, -(-n // 5))))


def test_quiz_scores(spark):
    df = spark.createDataFrame([(["A", "C"], ["A", "C"]), (["A"], ["A", "C"]), (["A", "B"], ["A", "C"]), (["B"], ["A"])], "s array<string>, c array<string>")
    assert [r[0] for r in df.select(Q.choice_score(F.col("s"), F.col("c"), F.lit(True))).collect()] == [1.0, 0.5, 0.0, 0.0]
    blanks = spark.createDataFrame([([" Deep  learning", "x"], [["deep learning", "dl"], ["y"]])], "g array<string>, a array<array<string>>")
    assert blanks.select(Q.blank_score(F.col("g"), F.col("a"))).collect()[0][0] == 0.5


def test_table_shapes(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]],)], "m array<array<string>>")
    assert df.select(T.rectangular(F.col("m"))).collect()[0][0] == [["a", "b"], ["c", ""]]
    parts = spark.createDataFrame([("d", "f1", 1, "Region Value", 2), ("d", "f2", 2, "Region Values", 2), ("d", "f3", 4, "Region Value", 2)], "document_id string, fragment_id string, page int, header string, n_columns int")
    assert {r.fragment_id: r.chain for r in T.continued_fragments(parts).collect()} == {"f1": "f1", "f2": "f1", "f3": "f3"}


def test_numbered(spark):
    from tabulae.session import numbered

    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1000, None if i % 5 else i) for i in range(1000)] + [(None, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, k int, x int").repartition(6)
    got = numbered(df, ["g"], [F.desc("k")], "place", "n").collect()
    want = {}
    for g, k, _ in rows:
        want.setdefault(g, []).append(k)
    assert len(got) == len(rows)
    for r in got:
        assert r.n == len(want[r.g]) and sorted(want[r.g], reverse=True)[r.place - 1] == r.k
    assert numbered(df.limit(0), ["g"], [F.desc("k")], "place").count() == 0


def test_ancestors_of_deep_trees_and_cycles(spark):
    from tabulae.operators.outline import ancestors

    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(140)] + [(200, 201), (201, 202), (202, 200), (300, 300)], "node_id int, parent_id int")
    got = {(r.node_id, r.ancestor_id): r.distance for r in ancestors(deep).collect()}
    want = {(i, j): i - j for i in range(140) for j in range(i + 1)} | {(200 + i, 200 + (i + d) % 3): d for i in range(3) for d in range(3)} | {(300, 300): 0}
    assert got == want


def test_matched_agrees_with_strength(spark):
    texts = ["Working-capital\nrequirements flies", "Net  profits rose", "profit, net", "The net of all other costs and later profit", "NCP and R&D", "net cápital Profits", "İstanbul ΟΔΟΣ ties buses boss bias", "a_b Class A shares", "class a share", "base64" + "s" * 3000, " _ -- ", "", None, "Straße 😀😀😀😀s policies net working capital profit"]
    terms = ["net profit", "working capital requirement", "R&D", "research and development", "new capital products", "Class A", "İSTANBUL", "οδος", "policy", "fly", "tie", "bus", "bia", "😀", "---", "A B", "NP", "net working capital profits", "cápital"]
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run string, id int, text string")
    none = F.array().cast("array<string>")
    asked = spark.createDataFrame([("r", [[a, b] for a, b in zip(terms, terms[1:])] + [[t] for t in terms] + [[]])], "run string, concept_terms array<array<string>>").withColumns({"year_terms": none, "unit_terms": none})
    got = {r.id: r.m for r in C.with_terms(rows, asked, "run").select("id", C.matched(F.col("_concepts"), F.col("_starts"), F.col("text")).alias("m")).collect()}
    full = C.with_signals(rows, asked, "run").withColumn("t", C.prepared("text"))
    assert got == {r.id: [int(s > 0) for s in r.s] for r in full.select("id", C.concept_strengths(F.col("_concepts"), F.col("t")).alias("s")).collect()}
    assert all(x == y for x, y in rows.select(C.joined_roots("text"), C.prepared("text")["joined"]).collect())
    assert all(sum(got[i]) for i in (0, 1, 4, 5, 6, 7, 13)) and not sum(got[2] + got[9] + got[10] + got[11] + got[12])


def test_concept_df_matches_each_candidate_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["agg_concept_df"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "exists(" in line]
    assert plan.count("(coalesce(text#") < 10


def test_spread_of_agreement_without_joining_candidates(spark):
    import __spark_entry__ as entry

    rows = spark.createDataFrame([("r", 1, 1), ("r", 1, 1), ("r", 2, 3), ("r", None, 1), ("s", None, None)], "run string, m int, q int")
    got = {r.run: (r.n_candidates, r.n_levels, r.most) for r in C.agreement_spread(rows, "run", F.col("m"), F.col("q"), F.lit(3)).collect()}
    whole = C.consensus(rows, "run", F.col("m"), F.col("q"), F.lit(3)).groupBy("run").agg(F.count("*"), F.count_distinct("raw"), F.max("raw")).collect()
    assert got == {r[0]: tuple(r[1:]) for r in whole} and got["r"] == (4, 2, 1.0)
    plan = entry.queries()["mt_context_build"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 2 and plan.count("(coalesce(text#") < 10
