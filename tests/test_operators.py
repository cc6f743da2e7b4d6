import math

import random

import pytest
from pyspark.sql import functions as F

from braidlog.functions.quantiles import exact_quantile, value_at
from braidlog.functions.temporal import as_of, as_of_small, days_since_first, interval_join
from braidlog.operators.hyper import as_dyadic_log, as_hyperedge_log, hyperedge_activity, hyperedge_features, hyperedge_log, hyperedge_sizes, hyperedge_subrep, is_hyperedge_log
from braidlog.operators.log import attach_static_covariates, standardize_event_log, transform_recency
from braidlog.operators.reshape import derive_stratum, widen_case_control
from braidlog.operators.sampling import sample_non_events
from braidlog.sources.logs import dataset, read_delimited_log, read_edges_log, register_dataset, write_log

LOG = "sender string, receiver string, time double, rid long"


def frame(spark, rows, schema=LOG):
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_standardize(spark):
    raw = frame(spark, [("a", "b", 2.0, 1), ("b", "b", 1.0, 2), ("b", "b", 1.0, 3), ("b", "a", 3.0, 4), ("a", None, 1.0, 5)], "s string, r string, t double, score int")
    got = standardize_event_log(raw, "s", "r", "t", drop_loops=True, remove_duplicates=True, order_col="score")
    assert rows(got, "time") == [("a", "b", 2.0, 1), ("b", "a", 3.0, 4)]
    first = standardize_event_log(raw, "s", "r", "t", remove_duplicates=True, order_col="score").filter("sender = receiver")
    assert [r["score"] for r in first.collect()] == [2]
    for bad in ({"drop_nas": False}, {"strictly_increasing_time": True}):
        with pytest.raises(ValueError):
            standardize_event_log(raw, "s", "r", "t", **bad)
    with pytest.raises(ValueError):
        standardize_event_log(raw)
    assert standardize_event_log(raw.limit(0), "s", "r", "t", keep_extra=False).columns == ["sender", "receiver", "time"]


def test_covariates(spark):
    log = frame(spark, [("a", "c", 1.0, 0), ("b", "a", 2.0, 1), ("c", "b", 3.0, 2)])
    act = frame(spark, [("a", 1), ("b", 2), ("c", 3)], "actor string, act int")
    pop = frame(spark, [("a", 4), ("b", 5), ("c", 6)], "actor string, pop int")
    got = attach_static_covariates(log, act, pop)
    assert [(r["sender_act"], r["receiver_pop"]) for r in got.orderBy("rid").collect()] == [(1, 6), (2, 4), (3, 5)]
    with pytest.raises(ValueError):
        attach_static_covariates(log, act.union(act))
    with pytest.raises(ValueError):
        attach_static_covariates(log, act.filter("actor <> 'a'"), allow_missing=False)
    with pytest.raises(ValueError):
        attach_static_covariates(log, act.select("actor"))


def test_recency_kernel(spark):
    values = frame(spark, [(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (None,)], "d double")
    got = {r["d"]: r["d_weight"] for r in transform_recency(values, "d").collect()}
    assert got[0.0] == 1 and got[2.0] == pytest.approx(math.exp(-0.5)) and got[None] is None
    assert {r["d"]: r["w"] for r in transform_recency(values, "d", "w", half_life=4.0).collect()}[4.0] == pytest.approx(math.exp(-1))
    reference = frame(spark, [(1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (None,)], "x double")
    assert {r["d"]: r["w"] for r in transform_recency(values, "d", "w", reference=reference).collect()}[3.0] == pytest.approx(math.exp(-3 / 6))
    for bad in (frame(spark, [(-1.0,)], "d double"), frame(spark, [(0.0,)], "d double")):
        with pytest.raises(ValueError):
            transform_recency(bad, "d")


def test_widen_and_strata(spark):
    table = frame(spark, [(x, i, v) for i, (x, v) in enumerate([(1, 2.0), (0, 0.0), (0, 1.0)] * 5)], "IS_OBSERVED int, rid long, x double")
    got = widen_case_control(table, check=True)
    assert got.count() == 5 and got.filter("x_ev = 2 AND x_nv = 0 AND d_x = 2").count() == 5
    assert widen_case_control(table, control_index=2).filter("x_nv = 1").count() == 5
    assert widen_case_control(table, control_index=3).count() == 0
    with pytest.raises(ValueError):
        widen_case_control(table, control_index=3, check=True)
    blank = frame(spark, [("s1", 1, 0), ("", 0, 1), (None, 0, 2), ("s2", 1, 3), ("", 0, 4)], "g string, event int, rid long")
    assert [r["__stratum"] for r in derive_stratum(blank, stratum="g").orderBy("rid").collect()] == ["s1", "s1", "s1", "s2", "s2"]


def test_as_of(spark):
    asked = frame(spark, [(0.0,), (1.0,), (2.5,), (9.0,)], "time double")
    known = frame(spark, [(1.0, 10.0), (2.0, 20.0), (5.0, 50.0)], "at double, v double")
    want = {0.0: 10.0, 1.0: 10.0, 2.5: 20.0, 9.0: 50.0}
    for f in (as_of, as_of_small):
        assert dict(rows(f(asked, known, "time", "at", ["v"]), "time")) == want
        assert dict(rows(f(asked, known, "time", "at", ["v"], compat=True), "time")) == {**want, 9.0: 20.0}
    draw = random.Random(5)
    asked = frame(spark, [(draw.choice([-3.0, -1.0, 0.5]) + k % 90,) for k in range(400)], "time double").distinct()
    known = frame(spark, [(float(t), float(t) / 7) for t in draw.sample(range(2, 80), 30)], "at double, v double")
    table = sorted((r["at"], r["v"]) for r in known.collect())
    want = {t: next((v for at, v in reversed(table) if at <= t), table[0][1]) for (t,) in rows(asked, "time")}
    for found in (as_of(asked, known, "time", "at", ["v"]), as_of_small(asked, known, "time", "at", ["v"], most=1)):
        assert dict(rows(found, "time")) == want
    early = dict(rows(as_of(asked, known, "time", "at", ["v"], first_before=False), "time"))
    assert early == {t: v if t >= table[0][0] else None for t, v in want.items()}
    assert dict(rows(as_of(asked, known.limit(0), "time", "at", ["v"]), "time")) == dict.fromkeys(want)
    assert [r["time"] for r in days_since_first(frame(spark, [(86_400.0,), (259_200.0,)], "time double")).orderBy("time").collect()] == [0.0, 2.0]


def test_as_of_within_keys(spark):
    """Keys of one range, a key over all ranges, a null key, equal times, and a key without values."""
    draw = random.Random(6)
    keys = ["hot"] * 12 + ["a", "b", None]
    known = [(draw.choice(keys), float(draw.randrange(60)), 0.0) for _ in range(300)]
    known = [(k, t, t / 3) for k, t, _ in {(k, t, 0.0) for k, t, _ in known}]
    asked = [(draw.choice([*keys, "none"]), draw.randrange(-4, 130) / 2, n) for n in range(900)] + [("hot", 30.0, 1000 + n) for n in range(200)]
    for first_before in (True, False):
        got = as_of(frame(spark, asked, "g string, time double, n int"), frame(spark, known, "g string, at double, v double"), "time", "at", ["v"], by=["g"], first_before=first_before)
        got = {r["n"]: r["v"] for r in got.collect()}
        for g, t, n in asked:
            own = sorted((at, v) for k, at, v in known if k == g)
            want = next((v for at, v in reversed(own) if at <= t), own[0][1] if own and first_before else None)
            assert got[n] == want, (g, t, n)
    plan = as_of(frame(spark, asked, "g string, time double, n int"), frame(spark, known, "g string, at double, v double"), "time", "at", ["v"], by=["g"])
    tables = plan.groupBy(F.spark_partition_id()).count().collect()
    assert plan.count() == len(asked) and max(r["count"] for r in tables) <= len(asked) * 0.6


def test_interval_join(spark):
    draw, inf = random.Random(7), float("inf")
    spans = [(g, a, a + draw.choice([0.0, 1e-9, 0.5, 1, 3, 50, 1e6]), n) for n in range(150) for g, a in [(draw.choice("ab"), float(draw.randrange(-20, 60)))]]
    spans += [("a", 5.0, None, 900), ("b", -inf, 3.0, 901), ("a", None, 9.0, 902), ("b", -inf, inf, 903), ("a", 9.0, 4.0, 904), ("a", 7.0, 8.0, 905), ("a", 7.0, 8.0, 905)]
    asked = [(draw.choice("abc"), draw.randrange(-60, 200) / 2, n) for n in range(300)] + [("a", None, 1000), ("a", 1e12, 1001), ("b", -inf, 1002), ("b", 7.0, 1003), ("b", 7.0, 1003)]
    one, two = frame(spark, asked, "g string, time double, n int"), frame(spark, spans, "g string, since double, until double, m int")
    holds = lambda t, a, b: t is not None and a is not None and a <= t and (b is None or t < b)
    for by in (["g"], []):
        got = interval_join(one, two if by else two.drop("g"), "time", "since", "until", by=by)
        want = sorted((n, m) for g, t, n in asked for h, a, b, m in spans if holds(t, a, b) and (not by or g == h))
        assert sorted((r["n"], r["m"]) for r in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert interval_join(one, two.limit(0), "time", "since", "until", by=["g"]).count() == 0
    with pytest.raises(ValueError):
        interval_join(one, two, "time", "since", "until")


def test_exact_quantiles(spark):
    import statistics

    draw = random.Random(8)
    shapes = {
        "even": [float(k) for k in range(1001)], "skewed": [draw.paretovariate(0.2) for _ in range(1000)], "tied": [draw.choice([1.0, 2.0]) for _ in range(900)],
        "wide": [draw.choice([-1, 1]) * 10.0 ** draw.randrange(-300, 300) for _ in range(700)], "one": [4.0],
    }
    for name, values in shapes.items():
        df = frame(spark, [(v,) for v in values] + [(None,)], "v double")
        assert exact_quantile(df, "v", 0.5, little=20) == statistics.median(values), name
        assert (exact_quantile(df, "v", 0.0, little=20), exact_quantile(df, "v", 1.0, little=20)) == (min(values), max(values))
    some = frame(spark, [(v,) for v in shapes["tied"]], "x double").repartition(3)
    assert [value_at(some, k, 900, 5) for k in (0, 450, 899)] == [sorted(shapes["tied"])[k] for k in (0, 450, 899)]
    assert exact_quantile(df.limit(0), "v", 0.5) is None
    with pytest.raises(ValueError):
        exact_quantile(df, "v", 1.5)


def test_dyadic_covariates_and_distance(spark):
    from braidlog.operators.log import attach_distance, attach_dyadic_covariates

    log = frame(spark, [("a", "b", 1.0, 0), ("b", "a", 2.0, 1), ("a", "c", 3.0, 2)], "sender string, receiver string, time double, rid long")
    table = frame(spark, [("a", "b", 0.5), ("b", "a", 0.25)], "sender string, receiver string, w double")
    assert rows(attach_dyadic_covariates(log, table).select("rid", "w"), "rid") == [(0, 0.5), (1, 0.25), (2, None)]
    assert rows(attach_dyadic_covariates(log, table, 0.0).select("rid", "w"), "rid")[2] == (2, 0.0)
    for bad in (table.union(table), table.drop("w"), table.withColumnRenamed("w", "time")):
        with pytest.raises(ValueError):
            attach_dyadic_covariates(log, bad)
    places = frame(spark, [("a", 0.0, 0.0), ("b", 0.0, 90.0)], "actor string, lat double, lon double")
    got = dict(rows(attach_distance(log, places).select("rid", "distance"), "rid"))
    assert got[0] == pytest.approx(6371 * 3.141592653589793 / 2) == got[1] and got[2] is None
    assert dict(rows(attach_distance(log, places, log1p=True).select("rid", "distance"), "rid"))[0] == pytest.approx(9.21, abs=0.01)


def test_hyperedges(spark):
    hyper = hyperedge_log(frame(spark, [(list("ab"), ["X"], 1.0, 0), (list("abc"), ["X", "Y"], 2.0, 1), (list("ac"), ["Y"], 3.0, 2), (list("bcd"), ["X", "Y", "Z"], 4.0, 3)], "I array<string>, J array<string>, time double, rid long"), order_col="rid")
    count = lambda I, J, t: hyperedge_activity(hyper, list(I), J, t).first()[0]
    assert [count("a", [], 5), count("ab", ["X"], 5), count("a", [], 1), count("a", [], 2)] == [3, 2, 0, 1]
    assert hyperedge_subrep(hyper, list("ab"), ["X"], 5, 1, 1).first()[0] == pytest.approx(2.5)
    assert is_hyperedge_log(hyper) and not is_hyperedge_log(hyper.drop("J"))
    assert rows(hyperedge_sizes(hyper).select("rid", "size_I", "size_J"), "rid") == [(0, 2, 1), (1, 3, 2), (2, 2, 1), (3, 3, 3)]
    with pytest.raises(ValueError):
        hyperedge_subrep(hyper, ["a"], [], 5, 0, 0)
    with pytest.raises(ValueError):
        as_dyadic_log(hyper)
    with pytest.raises(ValueError):
        hyperedge_log(frame(spark, [([], ["X"], 1.0)], "I array<string>, J array<string>, time double"))
    log = as_hyperedge_log(frame(spark, [("a", "b", 1.0, 0), ("b", "a", 2.0, 1), ("a", "b", 3.0, 2), ("a", "c", 4.0, 3)]))
    got = hyperedge_features(log, ["reciprocity_count", "subrep_1_1", "activity", "subrep_2_1"])
    assert rows(got.select("rid", "reciprocity_count", "subrep_1_1", "activity", "subrep_2_1"), "rid") == [(0, 0.0, 0.0, 0.0, None), (1, 1.0, 0.0, 0.0, None), (2, 1.0, 1.0, 1.0, None), (3, 0.0, 0.0, 0.0, None)]
    assert as_dyadic_log(log).count() == 4


def test_sampling(spark):
    events = [("a1", "a2", 5.0, 0), ("a2", "a3", 5.0, 1), ("a3", "a4", 5.0, 2), ("a4", "a5", 8.0, 3), ("a5", "a6", 8.0, 4), ("a6", "a7", 9.0, 5)]
    log = frame(spark, events).withColumn("w", F.lit(1))
    gone = frame(spark, [("a1", "a3"), ("a2", "a1")], "x string, y string")
    cc = sample_non_events(log, 3, mode="one", risk="remove", exclude_pairs=gone, seed=3)
    assert cc.groupBy("stratum").count().filter("count <> 4").isEmpty() and cc.filter("event = 0 AND w IS NOT NULL").isEmpty()
    fired = {(s, r): (t, k) for k, (s, r, t, _) in enumerate(events)}
    for r in cc.filter("event = 0").collect():
        pair = (r["sender"], r["receiver"])
        assert pair[0] != pair[1] and pair not in {("a1", "a3"), ("a2", "a1")}
        assert pair not in fired or (fired[pair][0] > r["time"])
    assert cc.exceptAll(sample_non_events(log, 3, mode="one", risk="remove", exclude_pairs=gone, seed=3)).isEmpty()
    cited = frame(spark, [("p1", "seed", 1.0, 0), ("p2", "p1", 2.0, 1), ("p3", "p1", 2.0, 2), ("p4", "p3", 3.0, 3)])
    debut = {"p1": 1.0, "p2": 2.0, "p3": 2.0, "p4": 3.0}
    own = {k + 1: e for k, e in enumerate([("p1", "seed"), ("p2", "p1"), ("p3", "p1"), ("p4", "p3")])}
    for r in sample_non_events(cited, 4, "citation", "two", seed=1).filter("event = 0").collect():
        s, x = own[r["stratum"]]
        assert debut[r["sender"]] == r["time"] or r["sender"] == s
        assert debut.get(r["receiver"], 99) < r["time"] or r["receiver"] == x
    seen = sample_non_events(frame(spark, events), 2, "appearance", "one", seed=2)
    for r in seen.filter("event = 0 AND stratum > 2").collect():
        earlier = {a for e in events[: r["stratum"] - 1] for a in e[:2]}
        assert {r["sender"], r["receiver"]} <= earlier
    alone = frame(spark, [("a", "b", 1.0, 0)])
    assert sample_non_events(alone, 1, mode="two", max_attempts=20).count() == 1
    with pytest.raises(ValueError):
        sample_non_events(alone, 1, mode="two", max_attempts=20, strict=True)
    with pytest.raises(ValueError):
        sample_non_events(alone, 0)


def test_draws_are_even(spark):
    log = frame(spark, [(f"a{k % 4}", f"a{(k + 1) % 4}", float(k), k) for k in range(400)])
    n = {(r["sender"], r["receiver"]): r["count"] for r in sample_non_events(log, 5, mode="one", seed=9).filter("event = 0").groupBy("sender", "receiver").count().collect()}
    assert len(n) == 12 and max(n.values()) < 1.9 * min(n.values())
    assert sum(n.values()) == 2000


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("from\tto\tminute\nx\ty\t2\ny\tz\t1\n")
    got = read_delimited_log(spark, str(tmp_path / "a.tsv"), columns={"from": "sender", "to": "receiver", "minute": "time"}, order_by="time")
    assert rows(got.select("rid", "sender", "time"), "rid") == [(0, "y", 1.0), (1, "x", 2.0)]
    (tmp_path / "b.edges").write_text("% note\n1 2 1 100\n 2 3 1 200\n\n")
    assert rows(read_edges_log(spark, str(tmp_path / "b.edges")), "time") == [("1", "2", "1", "100"), ("2", "3", "1", "200")]
    write_log(got, str(tmp_path / "log"))
    register_dataset("mine", str(tmp_path / "log"))
    assert dataset(spark, "mine").count() == 2
    with pytest.raises(KeyError):
        dataset(spark, "none")


def test_every_event_with_a_valid_pair_has_controls(spark):
    log = [(f"a{(k * k + k // 5) % 5}", f"a{(3 * k + k // 7) % 5}", float(k // 2 if k < 40 else 60 - k), k) for k in range(60)]
    debut, since = {}, [{}, {}, {}]
    for k, (s, r, t, _) in enumerate(log, 1):
        debut[s] = min(t, debut.get(s, t))
        for role, actors in enumerate(((s,), (r,), (s, r))):
            for a in actors:
                since[role].setdefault(a, k)
    first = {}
    for k, (s, r, _, _) in enumerate(log, 1):
        first.setdefault((s, r), k)
    gone = {("a0", "a1"), ("a3", "a2")}

    def pools(scope, mode, k):
        s, r, t, _ = log[k - 1]
        if scope == "citation":
            a, b = {x for x in debut if debut[x] == t} | {s}, {x for x in debut if debut[x] < t} | {r}
            return (a | b, a | b) if mode == "one" else (a, b)
        out = []
        for role in (2, 2) if mode == "one" else (0, 1):
            pool = {x for x, n in since[role].items() if scope == "all" or n < k}
            out.append(pool if len(pool) >= (2 if mode == "one" else 1) else set(since[role]))
        return out

    runs = [("all", "two", "remove", True), ("appearance", "one", "remove", False), ("citation", "one", "remove", False)]
    for scope, mode, risk, loops in runs:
        got = {}
        cc = sample_non_events(frame(spark, log), 12, scope, mode, risk, frame(spark, sorted(gone), "x string, y string"), allow_loops=loops, seed=3, max_attempts=1)
        for r in cc.filter("event = 0").collect():
            got.setdefault(r["stratum"], []).append((r["sender"], r["receiver"]))
        for k, (s, r, t, _) in enumerate(log, 1):
            a, b = pools(scope, mode, k)
            now = {e[:2] for e in log if e[2] == t}
            may = {(x, y) for x in a for y in b if (loops or x != y) and (x, y) != (s, r) and (x, y) not in gone}
            if risk == "remove":
                may = {p for p in may if first.get(p, 99) >= k and p not in now}
            assert len(got.get(k, [])) == (12 if may else 0) and set(got.get(k, [])) <= may, (scope, mode, risk, k)


def test_listed_draws_are_even(spark):
    pairs = [(f"a{x}", f"a{y}") for x in range(5) for y in range(5) if x != y]
    log = frame(spark, [(s, r, float(k), k) for k, (s, r) in enumerate(pairs[:17] + [pairs[0]] * 40)])
    got = sample_non_events(log, 30, mode="one", risk="remove", seed=2, max_attempts=1).filter("event = 0 AND stratum > 17")
    n = {(r["sender"], r["receiver"]): r["count"] for r in got.groupBy("sender", "receiver").count().collect()}
    assert set(n) == set(pairs[17:]) and sum(n.values()) == 1200 and max(n.values()) < 1.25 * min(n.values())
