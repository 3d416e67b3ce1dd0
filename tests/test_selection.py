import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.functions import text as X
from tabulae.operators import assessment as A
from tabulae.operators import concepts
from tabulae.operators import context as C
from tabulae.operators import hydration as H
from tabulae.operators import representatives as R
from tabulae.operators import retrieval as S
from tabulae.operators import tables as T
from tabulae.sources import formats
from tabulae.streaming.windows import drain, memory_triggers


def test_select_texts_is_greedy(spark):
    same = "one two three four five six seven"
    rows = [("r", "a", "d", 1, same, 0.9), ("r", "b", "d", 2, same, 0.8), ("r", "c", "e", 2, same, 0.7), ("r", "d", "d", 1, "x y z", 0.65), ("r", "e", "d", 1, "p q r", 0.6), ("r", "f", "d", None, None, 0.55), ("r", "g", "d", None, "", 0.1)]
    df = spark.createDataFrame(rows, "run string, chunk_id string, document_id string, page_number int, text string, score double")
    got = [r.chunk_id for r in S.select_texts(df, "run", 6).orderBy("pick").collect()]
    assert got == ["a", "c", "d", "f"]


def test_select_tables(spark):
    rows = [("r", "t1", "d", "Cash flow", ["a", "b"], 1, 2, 0.9), ("r", "t2", "d", "Cash flow", ["a", "b"], 2, 3, 0.8), ("r", "t3", "d", "Cash flow", ["a", "b"], 9, 9, 0.7), ("r", "t4", "e", None, None, None, None, 0.6), ("r", "t1", "d", "Cash flow", ["a"], 5, 5, 0.6)]
    df = spark.createDataFrame(rows, "run string, table_id string, document_id string, title string, keys array<string>, page_start int, page_end int, score double")
    assert [r.table_id for r in S.select_tables(df, "run", 5).orderBy("pick").collect()] == ["t1", "t3", "t4"]


def test_relative_best_rescues_the_first(spark):
    df = spark.createDataFrame([("r", "a", 0.0), ("r", "b", None), ("s", "c", 0.5), ("s", "d", 0.3), ("s", "e", 0.1)], "run string, id string, score double")
    assert sorted(r.id for r in S.relative_best(df, "run", "id", "score").collect()) == ["a", "c", "d"]


def test_consensus(spark):
    df = spark.createDataFrame([("r", 2, 3), ("r", 1, 1), ("r", 1, 1), ("s", 2, 2)], "run string, m int, q int")
    got = sorted((r.run, r.m, round(r.consensus, 6)) for r in concepts.consensus(df, "run", F.col("m"), F.col("q"), F.lit(3)).collect())
    assert got == [("r", 1, 0.0), ("r", 1, 0.0), ("r", 2, 1.0), ("s", 2, 0.0)]


def test_title_scores(spark):
    titles = spark.createDataFrame([("1. Statement of cash flows",), ("Segment results",), ("Schedule of borrowings",), ("",), (None,)], "title string")
    asked = spark.createDataFrame([(1, "2.1 Segment results"), (2, "borrowings"), (3, "nothing alike")], "query_id bigint, query string")
    got = {(r.query_id, r.place): (r.title, r.score) for r in S.title_scores(titles, asked).collect()}
    assert got[1, 1] == ("Segment results", 1.0) and got[2, 1][0] == "Schedule of borrowings" and not any(q == 3 for q, _ in got)


def test_scope_representatives(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i % 2, i, rng.normal(size=6).tolist()) for i in range(120)], "label int, vec_id bigint, v array<double>")
    got = R.scope_representatives(df, "label", "vec_id", "v", 10, block=40).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 10, 1: 10}
    assert R.diverse(df, "label", "vec_id", "v", 5, block=40).count() == 2 * 3 * 5


def test_layout(spark):
    words = spark.createDataFrame([("p", "a", 10.0, 10.0), ("p", "b", 60.0, 12.0), ("p", "c", 11.0, 30.0), ("p", "d", 61.0, 31.0), ("p", "e", None, 1.0)], "page_id string, word_id string, x double, y double")
    rows = T.visual_rows(words)
    assert {r.word_id: r.row_no for r in rows.collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    found = T.column_anchors(words.join(rows, ["page_id", "word_id"])).orderBy("anchor").collect()
    assert [(r.anchor, r.n_rows) for r in found] == [(10.5, 2), (60.5, 2)]


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0]), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0]), (None, [0.0, 0.0, 1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(T.box_overlap(F.col("a"), F.col("b"))).collect()] == [0.25, 0.0, 0.0]


def test_assessment(spark):
    columns = spark.createDataFrame([("d", "t1", "revenue", "Revenue", "number"), ("d", "t1", "period", "Period", "string"), ("d", "t2", "period", "Period", "string"), ("d", "t2", "rev", "Total revenue growth", "number"), ("e", "t3", "x", "Revenue", "string")], "document_id string, table_id string, key string, label string, declared string")
    asked = [("r1", "metric", "Revenue", True), ("r2", "dimension", "Period", True), ("r3", "metric", "Dividends", False)]
    matches = A.requirement_columns(columns, asked)
    assert {(r.requirement_id, r.table_id) for r in matches.where("match = 'match'").collect()} == {("r1", "t1"), ("r2", "t1"), ("r2", "t2")}
    covered = A.coverage(matches, spark.createDataFrame(asked, "requirement_id string, kind string, name string, required boolean"))
    assert {r.requirement_id: r.status for r in covered.collect()} == {"r1": "supported", "r2": "supported", "r3": "missing"}
    assert A.readiness(covered).collect()[0].decision == "ready"
    joins = {r.document_id: (r.shared, r.joinable) for r in A.joinable(columns).collect()}
    assert joins == {"d": ("period", True), "e": ("revenue", False)}


def test_replace_and_upsert(spark):
    old = spark.createDataFrame([("a", "d1", 1), ("b", "d1", 1), ("c", "d2", 1)], "k string, g string, at int")
    new = spark.createDataFrame([("a", "d1", 9), ("x", "d1", 9)], "k string, g string, at int")
    got = {r.k: (r.g, r["at"], r.change) for r in H.replaced(old, new, "k", "g", "at").collect()}
    assert got == {"a": ("d1", 1, "updated"), "b": ("d1", 1, "removed"), "c": ("d2", 1, "kept"), "x": ("d1", 9, "inserted")}
    assert H.upserted(old, new, ["k"]).count() == 4


def test_context_windows(spark):
    text = "x" * 1900
    got = C.windows_of_text(spark.createDataFrame([(1, text), (2, " "), (3, None), (4, "short")], "id bigint, t string"), "id", "t").orderBy("id", "chunk_no").collect()
    assert [(r.id, r.start_index, len(r.chunk)) for r in got] == [(1, 0, 800), (1, 700, 800), (1, 1400, 500), (4, 0, 5)]


@pytest.mark.parametrize(("label", "want"), [("1.2 Overview of Cash Flows", "cash flows"), ("Chapter 3: Results", "3 results"), (None, "")])
def test_heading(spark, label, want):
    assert spark.createDataFrame([(label,)], "s string").select(X.heading("s")).collect()[0][0] == want


def test_records_and_texts(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"point_id": "a", "payload": {"doc_id": "d", "page_number": 3}}\nbroken\n')
    rows = {r.point_id: r for r in formats.read_records(spark, str(tmp_path / "t.json"), "sparse_records").collect()}
    assert rows["a"].payload.page_number == 3 and rows[None]._corrupt == "broken"
    (tmp_path / "x.txt").write_text("grün")
    assert [r.text for r in formats.read_texts(spark, str(tmp_path / "x.txt")).collect()] == ["grün"]
    parts = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    formats.write_partitions(parts, str(tmp_path / "out"), ["p"])
    formats.write_partitions(parts.where("p = 'b'").withColumn("v", F.lit(7)), str(tmp_path / "out"), ["p"])
    assert {r.p: r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 1, "b": 7}


def test_memory_triggers(spark, tmp_path):
    spark.createDataFrame([(1,)] * 13 + [(2,)] * 5, "user_id bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint").parquet(str(tmp_path / "in"))
    assert sorted((r.user_id, r.done) for r in drain(memory_triggers(stream)).collect()) == [(1, 6), (1, 12)]


def test_choices_go_by_node(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i % 5, i, rng.normal(size=4).tolist()) for i in range(2500)], "label int, vec_id bigint, v array<double>")
    for most in (4_000, 150):
        monkeypatch.setattr(R, "MOST", most)
        for got, want in ((R.representatives(df, "label", "vec_id", "v"), 80), (R.node_diverse(df, "label", "vec_id", "v", 10), 10), (R.scope_representatives(df, "label", "vec_id", "v", 12), 12)):
            found = {}
            for r in got.collect():
                found.setdefault(r.label, []).append(r.vec_id)
            assert {k: (len(v), min(v), max(v)) for k, v in found.items()} == {n: (want, n, 2495 + n) for n in range(5)}
