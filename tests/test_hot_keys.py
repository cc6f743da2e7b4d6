"""Actors that hold much of a log: segments of a key, triangles instead of a hub's pairs."""

import random

import pytest
from interpreter import interpret
from pyspark.sql import functions as F
from test_features import frame, made, same

from braidlog.plans import segments
from braidlog.plans.catalog import LEGS
from braidlog.plans.features import endogenous_features
from braidlog.plans.paths import heavy_vertices, ordered, two_paths
from braidlog.plans.segments import dealt


@pytest.fixture
def small_segments(monkeypatch):
    monkeypatch.setattr(segments, "MOST", 12)
    monkeypatch.setattr(segments, "SAMPLED", 2)
    monkeypatch.setattr(segments, "SHARE", 50)


def hot(seed):
    rows, draw = made(seed, 260, 7, 70)
    rows = [("a0" if draw.random() < 0.5 else s, "a1" if draw.random() < 0.4 else r, t, i) for s, r, t, i in rows]
    return rows, draw


def test_segments_cut_only_hot_keys_and_keep_the_order(spark, small_segments):
    rows, _ = hot(3)
    parts = dealt(frame(spark, rows), ["sender"], ["time", "rid"])
    got = {}
    for r in parts.rows.collect():
        got.setdefault(r["sender"], []).append((r["time"], r["rid"], r["__seg"]))
    sizes = {k: len({x[2] for x in v}) for k, v in got.items()}
    assert parts.cut and sizes["a0"] > 3 and min(sizes.values()) >= 1 and sum(map(len, got.values())) == len(rows)
    for v in got.values():
        assert [x[2] for x in sorted(v)] == sorted(x[2] for x in v)
    assert not dealt(frame(spark, rows), ["sender"], ["time"], most=1000).cut
    assert not dealt(frame(spark, []), ["sender"], ["time"]).cut


def test_a_key_of_equal_rows_stays_whole(spark, small_segments):
    rows = [(None, "x", 1.0, 5)] * 80 + [("b", "x", float(k), k) for k in range(30)]
    parts = dealt(spark.createDataFrame(rows, "sender string, receiver string, time double, rid long"), ["sender"], ["time", "rid"])
    assert parts.rows.count() == 110
    assert parts.rows.filter("sender IS NULL").select("__seg").distinct().count() == 1


@pytest.mark.parametrize("strict", [False, True])
def test_dealt_actors_against_interpreter(spark, small_segments, strict):
    rows, draw = hot(4)
    stats = ["sender_outdegree", "receiver_indegree"]
    if not strict:
        return same(endogenous_features(frame(spark, rows), stats), rows, interpret(rows, stats), stats)
    kept = [draw.random() < 0.7 for _ in rows]
    past = {x[:3] for x, k in zip(rows, kept) if k}
    events = [x[:3] in past for x in rows]
    history = spark.createDataFrame(sorted(past), "sender string, receiver string, time double")
    same(endogenous_features(frame(spark, rows), stats, history=history), rows, interpret(rows, stats, None, events), stats)


def test_dealt_sets_begin_with_those_of_earlier_segments(spark, small_segments):
    rows, _ = hot(5)
    got = {r["rid"]: r["sender_receivers_set"] for r in endogenous_features(frame(spark, rows), ["sender_receivers_set"]).collect()}
    assert len(got) == len(rows)
    for s, _, t, i in rows:
        first = {}
        for x in rows:
            if x[0] == s:
                first.setdefault(x[1], (x[2], x[3]))
        assert got[i] == [r for r, at in sorted(first.items(), key=lambda x: x[1]) if at[0] < t]


@pytest.mark.parametrize("family", list(LEGS))
def test_two_paths_of_hubs(spark, family):
    draw = random.Random(6)
    pairs = {("h0", f"v{k}") for k in range(300)} | {(f"v{k}", "h1") for k in range(0, 300, 3)} | {("h0", "h1"), ("h1", "h0"), ("h1", "h1"), ("v1", "v1")}
    pairs |= {(f"v{draw.randrange(300)}", f"v{draw.randrange(300)}") for _ in range(400)} | {(f"v{draw.randrange(300)}", "h0") for _ in range(90)}
    table = [(s, r, (float(k), k) if draw.random() < 0.9 else None, draw.random() < 0.8) for k, (s, r) in enumerate(sorted(pairs))]
    edges = spark.createDataFrame(table, "__s string, __r string, o struct<__t:double,__rid:bigint>, asked boolean")
    assert {r["vertex"] for r in heavy_vertices(edges).collect()} == {"h0", "h1"}
    one, two = LEGS[family]
    fired = {(s, r): o for s, r, o, _ in table if o}
    want = set()
    for s, r, _, asked in table:
        for k in {x for p in pairs for x in p} if asked else ():
            at = {"s": s, "r": r, "k": k}
            a, b = (fired.get((at[leg[0]], at[leg[1]])) for leg in (one, two))
            if a and b and k not in (s, r):
                want.add((s, r, k, a[1], b[1]))
    got = [(x["s"], x["r"], x["k"], x["a_o"]["__rid"], x["b_o"]["__rid"]) for x in two_paths(edges, one, two).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hub_brings_no_edges_together_in_pairs(spark):
    """A star of 3,000 edges: what meets at a pivot is linear in the edges, not their square."""
    star = spark.range(3000).select(F.lit("hub").alias("__s"), F.concat(F.lit("v"), F.col("id")).alias("__r"), F.struct(F.col("id").cast("double").alias("__t"), F.col("id").alias("__rid")).alias("o"), F.lit(True).alias("asked"))
    placed = ordered(star, heavy_vertices(star))
    assert placed.filter("__ks < __kr").count() == 0
    assert two_paths(star, *LEGS["transitivity"]).count() == 0
