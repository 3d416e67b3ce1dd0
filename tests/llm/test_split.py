import random
import re

import numpy as np
import pytest

from tabulae.llm.split import boundaries, code_points, greedy_cuts, split_items, successors

LIMITS = [("c", 40, 10), ("d", 20, 0), ("odd", 5, 9), ("none", None, 3)]


def run(spark, texts, collection="c"):
    items = spark.createDataFrame([("t", str(i), collection, t, 3 if i % 2 else None, "x") for i, t in enumerate(texts)], "rec_table string, rec_key string, collection string, text string, page_number int, max_chars string")
    limits = spark.createDataFrame(LIMITS, "collection string, max_chars int, overlap_chars int")
    out = {}
    for r in split_items(items, limits).orderBy("rec_key", "piece_no").collect():
        out.setdefault(int(r.rec_key), []).append(r)
    return out


def words(rng, n):
    return "".join(rng.choice(["a", "bc", "déf", "ghij", "🏭"]) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "\f"]) for _ in range(n))


def test_pieces_keep_the_rules(spark):
    rng = random.Random(5)
    texts = [words(rng, n) for n in (3, 10, 40, 200, 2000)] + ["x" * 500, "x" * 40, "x" * 41, "a " * 15 + "y" * 130 + " b" * 40, " " * 200, "", None]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        if t is None or len(t) <= 40:
            assert i not in got
            continue
        ps = got[i]
        assert ps[0].start_char == 0 and ps[-1].end_char == len(t)
        assert [p.piece_no for p in ps] == list(range(1, ps[0].n_pieces + 1))
        for p in ps:
            assert p.text == t[p.start_char : p.end_char] and 0 < len(p.text) <= 40
            assert p.page_number == (None if i % 2 == 0 else 3 + t[: p.start_char + len(p.text) - len(p.text.lstrip(" \t\n\r\f"))].count("\f"))
            if p.cut_kind in ("word", "sentence", "paragraph"):
                assert t[p.end_char - 1] in " \t\n\r\f"
        assert all(a.end_char - b.start_char == 10 for a, b in zip(ps, ps[1:]))
        assert ps[0].longest_stretch == max(map(len, re.split("[ \t\n\r\f]", t)))
    assert {p.cut_kind for p in got[5]} == {"forced", "end"}


def test_cuts_equal_a_walk():
    rng = random.Random(9)
    for n in (30, 300, 3000):
        chars = code_points(words(rng, n))
        at, rank, _ = boundaries(chars)
        nodes, _, to = successors(at, rank, len(chars), 60, 15)
        walk, k = [0], 0
        while k != len(nodes) - 1:
            assert to[k] > k
            k = to[k]
            walk.append(k)
        assert greedy_cuts(to, np.array([0])).tolist() == walk


def test_odd_limits(spark):
    assert all(len(p.text) <= 5 for p in run(spark, ["ab cd ef gh ij kl"], "odd")[0])
    assert run(spark, ["x" * 99], "none") == {} and run(spark, ["x" * 99], "unknown") == {}
    assert run(spark, []) == {}
    assert [p.text for p in run(spark, ["one two three four five six"], "d")[0]] == ["one two three four ", "five six"]


def test_repeated_rows(spark):
    items = spark.createDataFrame([("t", "1", "d", "one two three four five six", 1)] * 3, "rec_table string, rec_key string, collection string, text string, page_number int")
    assert split_items(items, spark.createDataFrame(LIMITS, "collection string, max_chars int, overlap_chars int"), with_text=False).count() == 2


@pytest.mark.parametrize("text", ["a", " a", "a ", " ", "a b", "\fa\n\nb "])
def test_boundaries(text):
    at, rank, longest = boundaries(code_points(text))
    assert at.tolist() == [i for i in range(1, len(text)) if text[i] not in " \t\n\r\f" and text[i - 1] in " \t\n\r\f"]
    assert len(rank) == len(at) and longest == max(map(len, re.split("[ \t\n\r\f]", text)))
