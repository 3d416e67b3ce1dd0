import random

import pytest

from pyspark.sql import functions as F

from tabulae.llm.mixture import mix, plan_mixture, schedule_inverse, segments, shares

SIZES = "doc_id bigint, source string, n_tokens bigint, tokens string, h int"
TARGETS = "source string, target_share double, max_repeats int, note string"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "small", "other", None]), rng.choice([0, 5, 50, 500, None]), "x", 1) for i in range(2000)]
    targets = [("big", 0.5, 1, "n"), ("mid", 0.3, 3, "n"), ("small", 0.15, 2, "n"), ("absent", 0.05, 4, "n")]
    return rows, targets, spark.createDataFrame(rows, SIZES), spark.createDataFrame(targets, TARGETS)


def test_plan(data):
    rows, targets, sizes, goal = data
    have = {s: sum(n or 0 for _, q, n, *_ in rows if q == s) for s, *_ in targets}
    total = sum(have.values())
    for r in plan_mixture(sizes, goal).collect():
        share, repeats = next((a, b) for s, a, b, _ in targets if s == r.source)
        assert r.short == (have[r.source] * repeats < share * total) and r.planned == pytest.approx(min(share * total, have[r.source] * repeats))


@pytest.mark.parametrize("bits", [1, 12])
def test_mix(data, bits):
    rows, targets, sizes, goal = data
    got = mix(sizes, goal, bits=bits).collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position <= 1 for r in got)
    plan = {r.source: r for r in plan_mixture(sizes, goal).collect()}
    used, copies = {}, {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.copy_no <= plan[r.source].max_repeats
    assert len(copies) == len({(r.doc_id) for r in got}) and len({(r.doc_id, r.copy_no) for r in got}) == len(got)
    for s, p in plan.items():
        assert p.planned <= used.get(s, 0) < p.planned + 501 or p.planned == 0
    # every weight schedule sums to one, so each tenth of the run holds about a tenth of the tokens
    whole = sum(used.values())
    early = sum(r.n_tokens for r in got if r.position < 0.5)
    assert 0.35 < early / whole < 0.65


def test_same_order_at_any_prefix_length(data):
    *_, sizes, goal = data
    key = lambda r: (r.source, r.doc_id, r.copy_no, round(r.position, 12))
    assert list(map(key, mix(sizes, goal, bits=2).collect())) == list(map(key, mix(sizes, goal, bits=9).collect()))


def test_shares_and_empty(spark, data):
    *_, sizes, goal = data
    rows = {r.source: r for r in shares(sizes, goal).collect()}
    assert sum(r.actual_share for r in rows.values()) == pytest.approx(1) and rows["absent"].short and rows["absent"].used_tokens == 0
    none = spark.createDataFrame([], SIZES)
    assert mix(none, goal).count() == 0 and plan_mixture(none, spark.createDataFrame([], TARGETS)).count() == 0
    assert not any(r.short for r in plan_mixture(none, goal).collect())


def test_curriculum_shapes_shares_over_time(spark):
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(4000)], "doc_id bigint, source string, n_tokens bigint")
    goal = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.5, 1, "")], TARGETS)
    curve = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 0.5), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 0.5, 0.5), ("b", 1.0, 1.0), ("b", 2.0, 9.0), (None, 0.5, 9.0), ("b", 0.5, None)], "source string, t double, weight double")
    got = mix(sizes, goal, curve).collect()
    for low, high, want in ((0.0, 0.1, 0.95), (0.2, 0.3, 0.75), (0.45, 0.55, 0.5), (0.9, 1.0, 0.05)):
        inside = [r.source for r in got if low <= r.position < high]
        assert abs(inside.count("a") / len(inside) - want) < 0.03
    rows = {r.source: r for r in shares(sizes, goal, curve).collect()}
    assert rows["a"].actual_share == rows["b"].actual_share == 0.5 and not rows["a"].short


def test_steps_gaps_and_zeros_of_schedules(spark):
    curve = spark.createDataFrame([("s", 0.2, 0.0), ("s", 0.4, 2.0), ("s", 0.6, 0.0), ("z", 0.1, 0.0), ("z", 0.9, -1.0)], "source string, t double, weight double")
    parts = spark.createDataFrame([(s, p / 10) for s in "sz" for p in range(11)], "source string, part double")
    rows = parts.join(segments(curve), "source").select("source", "part", schedule_inverse(F.col("part"), F.col("segments")).alias("t")).collect()
    got = {(r.source, round(r.part, 1)): r.t for r in rows}
    assert got["s", 0.5] == pytest.approx(0.4) and got["s", 0.0] == pytest.approx(0.2) and got["s", 1.0] == pytest.approx(0.6)
    assert got["s", 0.2] == pytest.approx(0.2 + (0.2 * 0.4 / 5) ** 0.5) and all(got["z", p / 10] == pytest.approx(p / 10) for p in range(11))
