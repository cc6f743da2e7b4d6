import random

import pytest
from interpreter import interpret

from braidlog.plans.catalog import COMPILED, SIMULABLE, STATISTICS
from braidlog.plans.features import endogenous_features

NUMERIC = [s for s in STATISTICS if s != "sender_receivers_set"]


def made(seed, n, actors, times):
    draw = random.Random(seed)
    rows = [(f"a{draw.randrange(actors)}", f"a{draw.randrange(actors)}", float(draw.randrange(times))) for _ in range(n)]
    rows = [(s, r, t, i) for i, (s, r, t) in enumerate(rows)]
    return sorted(rows, key=lambda x: (x[2], x[3])), draw


def frame(spark, rows):
    return spark.createDataFrame(rows, "sender string, receiver string, time double, rid long")


def same(got, rows, want, stats):
    by = {r["rid"]: r for r in got.collect()}
    assert len(by) == len(rows)
    for row, w in zip(rows, want):
        for s in stats:
            v = by[row[3]][s]
            assert (v is None) == (w[s] is None) and (v is None or abs(v - w[s]) < 1e-9), (row, s, v, w[s])


def test_catalogue():
    assert (len(STATISTICS), len(SIMULABLE), len(COMPILED)) == (75, 73, 66)


def test_row_order_against_interpreter(spark):
    rows, _ = made(1, 220, 6, 60)
    same(endogenous_features(frame(spark, rows), NUMERIC, 7.0), rows, interpret(rows, NUMERIC, 7.0), NUMERIC)


def test_strict_order_against_interpreter(spark):
    rows, draw = made(2, 220, 6, 40)
    kept = [draw.random() < 0.7 for _ in rows]
    history = [x[:3] for x, k in zip(rows, kept) if k]
    events = [x[:3] in set(history) for x in rows]
    log = frame(spark, rows)
    past = spark.createDataFrame(history, "sender string, receiver string, time double")
    same(endogenous_features(log, NUMERIC, 5.0, history=past), rows, interpret(rows, NUMERIC, 5.0, events), NUMERIC)


def test_long_span_decay_neither_overflows_nor_vanishes(spark):
    rows = [("a", "b", 0.0, 0), ("b", "a", 10.0, 1), ("b", "a", 1e6, 2), ("a", "b", 1e6 + 3, 3)]
    got = {r["rid"]: r["reciprocity_exp_decay"] for r in endogenous_features(frame(spark, rows), ["reciprocity_exp_decay"], 1.0).collect()}
    assert got[1] == pytest.approx(2.0**-10) and got[3] == pytest.approx(2.0**-3) and got[0] == 0


def test_sets_are_strict_and_ordered(spark):
    rows = [("a", "x", 1.0, 0), ("a", "y", 2.0, 1), ("b", "x", 3.0, 2), ("a", "x", 3.5, 3), ("a", "z", 4.0, 4), ("a", "w", 4.0, 5)]
    got = {r["rid"]: r["sender_receivers_set"] for r in endogenous_features(frame(spark, rows), ["sender_receivers_set"]).collect()}
    assert got == {0: [], 1: ["x"], 2: [], 3: ["x", "y"], 4: ["x", "y"], 5: ["x", "y"]}


def test_warm_start(spark):
    log = frame(spark, [("A", "C", 3.0, 0), ("B", "C", 3.0, 1), ("C", "A", 4.0, 2), ("C", "A", 4.0, 3)])
    before = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 2.0)], "sender string, receiver string, time double")
    got = endogenous_features(log, ["transitivity_binary_interrupted"], prior_log=before).collect()
    assert {r["rid"]: r["transitivity_binary_interrupted"] for r in got} == {0: 1, 1: 0, 2: 0, 3: 0}


def test_mask_hides_rows_that_are_no_events(spark):
    log = frame(spark, [("a", "b", 1.0, 0), ("a", "b", 2.0, 1), ("b", "a", 3.0, 2), ("a", "b", 4.0, 3)])
    past = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0)], "sender string, receiver string, time double")
    got = {r["rid"]: r["reciprocity_count"] for r in endogenous_features(log, ["reciprocity_count"], history=past).collect()}
    assert got[2] == 2 and got[3] == 0


def test_errors(spark):
    log = frame(spark, [("a", "b", 1.0, 0)])
    for bad in ({"stats": ["no_such"]}, {"stats": []}, {"stats": ["recency", "recency"]}, {"stats": ["cyclic_exp_decay"]}, {"stats": ["cyclic_exp_decay"], "half_life": -1.0}):
        with pytest.raises(ValueError):
            endogenous_features(log, **bad)
    with pytest.raises(ValueError):
        endogenous_features(log.drop("time"))
    assert endogenous_features(log.limit(0)).count() == 0


def test_decay_over_many_stretches(spark):
    """A short half-life makes 10,000 stretches of one dyad; each sees a few of them, and their sums are right down to the least normal doubles."""
    rows = [("a", "b", 400.0 * k + (k % 3), k) for k in range(10_000)] + [("b", "a", 400.0 * k + 150.0, 10_000 + k) for k in range(0, 10_000, 7)]
    got = endogenous_features(frame(spark, rows), ["reciprocity_exp_decay"], 1.0).select("rid", "reciprocity_exp_decay").toPandas().set_index("rid")["reciprocity_exp_decay"]
    back = sorted(r[2] for r in rows if r[0] == "b")
    for s, r, t, rid in rows[:10_000:501]:
        want = sum(2.0 ** -(t - x) for x in back if x < t and t - x < 2000)
        assert got[rid] == pytest.approx(want, rel=1e-9, abs=1e-300), rid


def test_untimed_ties(spark):
    """Ties without a time count before everything and have no time of forming."""
    log = spark.createDataFrame([("a", "b", 1.0, 0), ("k", "b", 2.0, 1), ("a", "b", 3.0, 2), ("a", "k", 4.0, 3), ("a", "b", 5.0, 4), ("a", "b", 5.0, 5)], "sender string, receiver string, time double, rid long")
    ties = spark.createDataFrame([("a", "k"), ("a", "k"), ("m", "b"), ("a", "m"), ("a", None)], "sender string, receiver string")
    stats = ["transitivity_count", "transitivity_binary", "transitivity_time_recent", "transitivity_exp_decay", "transitivity_count_ordered", "transitivity_count_interrupted", "sender_outdegree", "recency", "sender_receivers_set"]
    got = {r["rid"]: r for r in endogenous_features(log, stats, 1.0, untimed=ties).collect()}
    assert [got[k]["transitivity_count"] for k in (0, 2, 4, 5)] == [1.0, 2.0, 2.0, 2.0]
    assert [got[k]["transitivity_binary"] for k in (0, 1, 2)] == [1, 0, 1]
    assert [got[k]["transitivity_time_recent"] for k in (0, 2, 4)] == [None, None, 1.0]
    assert [got[k]["transitivity_exp_decay"] for k in (0, 2, 4)] == [0.0, 0.0, pytest.approx(0.5)]
    assert [got[k]["transitivity_count_ordered"] for k in (2, 4)] == [0.0, 0.0]
    assert [got[k]["transitivity_count_interrupted"] for k in (2, 4)] == [0.0, 1.0]
    assert [got[k]["sender_outdegree"] for k in (0, 5)] == [0.0, 3.0] and got[0]["recency"] is None
    assert got[0]["sender_receivers_set"] == ["k", "m"] and got[5]["sender_receivers_set"] == ["k", "m", "b"] and got[1]["sender_receivers_set"] == []
    with pytest.raises(ValueError):
        endogenous_features(log, stats, 1.0, untimed=ties.drop("receiver"))
