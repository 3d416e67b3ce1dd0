import random

from tabulae.llm import topn
from tabulae.llm.topn import top_items

SCHEMA = "document_id string, chunk_id string, relevance_score double, page_number int, score string, grp int"


def brute(rows, n):
    best = {}
    for d, c, s, p, *_ in rows:
        if d and c is not None and s is not None and s == s:
            k = (-s, p if p is not None else float("inf"))
            best[d, c] = min(best.get((d, c), k), k)
    out = []
    for d in {d for d, _ in best}:
        for i, (_, c) in enumerate(sorted((k, c) for (e, c), k in best.items() if e == d)[:n], 1):
            out.append((d, i, c))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", "", None]), rng.choice([f"c{i}" for i in range(40)] + [None]), rng.choice([0.1, 0.5, 0.5, 0.9, -1.0, 0.0, -0.0, float("nan"), None]), rng.choice([1, 2, None]), "x", 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = lambda: sorted(tuple(r) for r in top_items(df, "document_id", "chunk_id", "relevance_score", "page_number").collect())
    assert got() == brute(rows, 5)
    monkeypatch.setattr(topn, "HELD", 3)
    assert got() == brute(rows, 5)


def test_empty_and_few(spark):
    assert top_items(spark.createDataFrame([], SCHEMA), "document_id", "chunk_id", "relevance_score", "page_number").count() == 0
    one = spark.createDataFrame([("d", "c", 1.0, None, "x", 1)] * 4, SCHEMA)
    assert [tuple(r) for r in top_items(one, "document_id", "chunk_id", "relevance_score", "page_number").collect()] == [("d", 1, "c")]
