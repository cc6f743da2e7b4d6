import math

import numpy as np
import pytest

from braidlog.models.simulate import (
    Simulation, simulate_actor_covariates, simulate_directed_hyperedge_events, simulate_directed_hyperevents_tvnl, simulate_hyperedge_events, simulate_relational_events, trajectory,
)
from braidlog.operators.hyper import hyperedge_features
from braidlog.plans.catalog import SIMULABLE
from braidlog.plans.features import endogenous_features

ACTORS = tuple(f"a{k}" for k in range(6))


def test_trajectory_agrees_with_features_of_its_log(spark):
    """All 73 statistics, with the simulator's own values of what was never seen."""
    sim = Simulation(90, ACTORS, ACTORS, endogenous_stats=SIMULABLE, endogenous_effects={"reciprocity_count": 0.2}, half_life=0.5)
    rows = trajectory(sim, 3)
    log = spark.createDataFrame(rows[["sender", "receiver", "time", "stratum"]].rename(columns={"stratum": "rid"}))
    got = endogenous_features(log, SIMULABLE, 0.5).toPandas().sort_values("rid").reset_index(drop=True)
    for s in SIMULABLE:
        want = got[s].astype(float)
        want = want.fillna(rows["time"]) if s == "recency" else want.fillna(0.0)
        assert np.allclose(rows[s].astype(float), want, atol=1e-9), s


def test_methods_shapes_and_limits(spark):
    for extra in ({}, {"method": "tau_leap", "tau": 0.05}):
        for risk in ("standard", "remove"):
            rows = trajectory(Simulation(40, ACTORS, ACTORS, n_controls=2, risk=risk, **extra), 1)
            events = rows[rows.event == 1]
            assert len(events) <= 40 and events.time.is_monotonic_increasing and (rows.sender != rows.receiver).all()
            assert (rows.groupby("stratum").size() <= 3).all()
            if risk == "remove":
                assert not events.duplicated(["sender", "receiver"]).any() and len(events) <= 30
    assert len(trajectory(Simulation(0, ACTORS, ACTORS), 1)) == 0
    assert trajectory(Simulation(500, ACTORS, ACTORS, horizon=0.5), 2).time.max() <= 0.5


def test_global_rate_follows_its_intervals():
    sim = Simulation(3000, ACTORS, ACTORS, global_breaks=(0.0, 10.0), global_values={"g": (0.0, 2.0)}, global_effects={"g": 1.0}, horizon=20.0)
    rows = trajectory(sim, 5)
    early, late = (rows.time < 10).sum(), (rows.time >= 10).sum()
    assert late / early == pytest.approx(math.exp(2), rel=0.25)


def test_replicates_and_wide(spark):
    sim = Simulation(20, ACTORS, ACTORS, n_controls=1, endogenous_stats=("reciprocity_count",))
    rows = simulate_relational_events(spark, sim, replicates=3, seed=1)
    assert rows.groupBy("replicate").count().count() == 3 and rows.count() == 3 * 20 * 2
    wide = simulate_relational_events(spark, sim, replicates=2, seed=1, wide=True)
    assert wide.count() == 40 and "d_reciprocity_count" in wide.columns
    assert simulate_relational_events(spark, sim, 2, 1).exceptAll(simulate_relational_events(spark, sim, 2, 1)).count() == 0


def test_errors():
    for bad in ({"baseline_rate": 0}, {"endogenous_stats": ("reciprocity",)}, {"endogenous_stats": ("cyclic_exp_decay",)}, {"method": "tau_leap"}, {"global_breaks": (1.0, 1.0)}, {"sender_effects": {"x": 1.0}}):
        with pytest.raises(ValueError):
            Simulation(10, ACTORS, ACTORS, **bad)


def test_actor_covariates(spark):
    static = simulate_actor_covariates(spark, ACTORS, ["x", "y"], sd=2.0, seed=3)
    assert static.columns == ["actor", "x", "y"] and static.count() == 6
    moving = simulate_actor_covariates(spark, ACTORS, ["x"], time_points=[0.0, 1.0, 2.0], rho=0.5, seed=3)
    assert moving.count() == 18 and moving.columns == ["actor", "time", "covariate", "value"]


def test_hyperedges(spark):
    rows = simulate_hyperedge_events(spark, 25, ACTORS[:4], 3, effects={"subrep_1": 0.1}, stats=["activity", "size"], seed=2)
    assert rows.count() == 25 and rows.filter("size(J) > 0 OR size(I) > 3").isEmpty()
    again = hyperedge_features(rows.select("rid", "I", "J", "time"), ["activity", "subrep_1"]).withColumnsRenamed({"activity": "a", "subrep_1": "b"})
    assert rows.join(again.select("rid", "a", "b"), "rid").filter("abs(activity - a) > 1e-9 OR abs(subrep_1 - b) > 1e-9").isEmpty()
    both = simulate_directed_hyperedge_events(spark, 15, ACTORS[:3], ACTORS[3:], (1, 2), (1, 2), stats=["size_I", "size_J", "subrep_1_1"], seed=2)
    assert both.count() == 15 and both.filter("size(J) = 0").isEmpty()
    cc = simulate_directed_hyperevents_tvnl(spark, {"a": 0.1, "b": 0.5}, {"c": 1.0, "d": -1.0}, math.sin, lambda v: v / 2, n_controls=2, max_group_senders=2)
    assert cc.filter("event = 0").count() == 2 * cc.filter("event = 1").count()
