import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlog.functions.splines import Basis
from braidlog.models.compare import (
    Sampling, cauchy_combination, compare_models, compare_models_global, compare_models_smooth, gof_auxiliary, gof_global, gof_multivariate, gof_univariate, ks_p_value, martingale_residuals, prepare_linear,
)
from braidlog.models.nn import NetControl, Net, fit_net, segments, stratum_loss
from braidlog.models.rem import nn_uncertainty, parse_terms, predict_net, rem


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(0)
    n = 1500
    x, z, t = rng.normal(size=(n, 2)), rng.uniform(-2, 2, size=(n, 2)), rng.uniform(0, 10, n)
    win = rng.random(n) < 1 / (1 + np.exp(-(0.8 * (x[:, 0] - x[:, 1]) + np.sin(2 * z[:, 0]) - np.sin(2 * z[:, 1]))))
    side = np.where(win[:, None], [0, 1], [1, 0])
    pick = lambda a, k: a[np.arange(n), side[:, k]]
    rows = [tuple(float(v) for v in r) for r in zip(pick(x, 0), pick(x, 1), pick(z, 0), pick(z, 1), t)]
    return spark.createDataFrame(rows, "x_ev double, x_nv double, z_ev double, z_nv double, time double").withColumn("d_x", F.col("x_ev") - F.col("x_nv")).cache()


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(400):
        x = rng.normal(size=4)
        case = int(rng.choice(4, p=np.exp(0.7 * x) / np.exp(0.7 * x).sum()))
        rows += [(g, int(k == case), float(x[k]), g * 4 + k) for k in range(4)]
    return spark.createDataFrame(rows, "stratum long, event int, x double, rid long").cache()


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(2)
    rows, last = [], ("a0", "a1")
    for k in range(160):
        s, r = (last[1], last[0]) if rng.random() < 0.4 else tuple(f"a{x}" for x in rng.choice(7, 2, replace=False))
        last = (s, r)
        rows.append((s, r, float(k + rng.random() * 0.5), k))
    return spark.createDataFrame(rows, "sender string, receiver string, time double, rid long").cache()


def brute_clogit(X, y, g, beta):
    out = 0.0
    for s in np.unique(g):
        eta = X[g == s] @ beta
        out += eta[y[g == s] == 1][0] - np.log(np.exp(eta).sum())
    return out


def test_bases():
    b = Basis(0.0, 2.0, 7)
    x = np.linspace(0, 2, 41)
    assert np.allclose(b(x).sum(1), 1) and (b(x) >= 0).all() and b(x).shape == (41, 7)
    c = Basis(0.0, 1.0, 6, cyclic=True)
    assert np.allclose(c(np.array([0.1])), c(np.array([1.1]))) and np.allclose(c.penalty().sum(1), 0)


def test_clogit_is_the_maximum(long):
    fit = rem("x", long, "clogit", stratum="stratum")
    rows = long.toPandas()
    X, y, g = rows[["x"]].to_numpy(), rows["event"].to_numpy(), rows["stratum"].to_numpy()
    at = [brute_clogit(X, y, g, fit.beta + d) for d in (-1e-3, 0, 1e-3)]
    assert fit.converged and fit.log_lik == pytest.approx(at[1]) and at[1] >= max(at)
    assert fit.coef()["x"] == pytest.approx(0.7, abs=0.25) and fit.null_log_lik == pytest.approx(-400 * np.log(4))
    assert fit.summary()[0]["std_error"] > 0 and fit.aic == pytest.approx(-2 * fit.log_lik + 2)


def test_smooth_terms_recover_shapes(wide):
    fit = rem("x + nl(z)", wide, "gam", k=10)
    assert fit.coef()["x"] == pytest.approx(0.8, abs=0.2) and 3 < fit.edf < 11
    block, beta = fit.blocks[1], fit.coef()["nl(z)"]
    at = np.linspace(-1.8, 1.8, 30)
    curve = block.make([at, np.zeros(30)]) @ beta
    assert np.corrcoef(curve, np.sin(2 * at))[0, 1] > 0.95
    flat = rem("tv(x)", wide, "gam", k=6)
    assert np.std(flat.blocks[0].make([np.ones(20), np.linspace(0.5, 9.5, 20)]) @ flat.beta) < 0.3
    with pytest.raises(ValueError):
        rem("nl(x) + re(z)", wide, "clogit")
    with pytest.raises(ValueError):
        parse_terms("x + x")
    with pytest.raises(ValueError):
        parse_terms("sq(x)")


def test_network(spark, long):
    rng = np.random.default_rng(3)
    strata = np.repeat(np.arange(6), 3)
    X, case = rng.normal(size=(18, 2)), np.tile([1, 0, 0], 6)
    net = Net(2, NetControl(hidden=(4,), activation="tanh", l2=0.01), rng)
    eta, kept = net.forward(X)
    g = net.gradients(kept, stratum_loss(eta, case, segments(strata))[1])
    for p, gi in zip(net.W + net.b, g):
        for at in np.ndindex(p.shape):
            p[at] += 1e-6
            up = net.loss(X, case, segments(strata))
            p[at] -= 2e-6
            down = net.loss(X, case, segments(strata))
            p[at] += 1e-6
            assert gi[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    X = rng.normal(size=(1600, 2))
    strata = np.repeat(np.arange(400), 4)
    case = np.zeros(1600, int)
    eta = 3 * X[:, 0] * X[:, 1]
    for k in range(400):
        case[4 * k + np.argmax(eta[4 * k : 4 * k + 4] + rng.gumbel(size=4))] = 1
    fit = fit_net(X, case, strata, ["a", "b"], NetControl(epochs=200, seed=1, hidden=(16, 8)))
    assert fit.concordance > 0.6 and fit.parameters > 0 and fit.coef() is None
    small = rem("x", long, "nn", stratum="stratum", nn=NetControl(architecture="additive_spline", epochs=60, seed=1))
    assert small.log_lik > -400 * np.log(4) and predict_net(small, long).filter("eta IS NULL").isEmpty()
    bands = nn_uncertainty(spark, X[:400], case[:400], strata[:400], ["a", "b"], NetControl(epochs=20, seed=1), B=6, grid=5)
    assert (bands["bands"]["a"]["low"] <= bands["bands"]["a"]["high"]).all()
    with pytest.raises(ValueError):
        NetControl(hidden=(0,))


def test_comparison(log):
    table, fits = compare_models(log, {"one": ["reciprocity_count"], "two": ["reciprocity_count", "sender_outdegree"]}, Sampling(seed=4))
    assert table.columns == ["model", "n_terms", "n_obs", "log_lik", "AIC", "delta_AIC"]
    got = {r["model"]: r for r in table.collect()}
    assert min(r["delta_AIC"] for r in got.values()) == 0 and got["two"]["log_lik"] >= got["one"]["log_lik"] - 1e-9
    assert got["one"]["AIC"] == pytest.approx(-2 * got["one"]["log_lik"] + 2)
    clean, _ = compare_models(log, {"one": ["reciprocity_count"]}, Sampling(seed=4, history="events", n_controls=2))
    assert clean.first()["n_obs"] == 160
    smooth, _ = compare_models_smooth(log, {"a": {"sender_outdegree": "nl"}, "b": {"reciprocity_count": "linear"}}, Sampling(seed=4), k=5)
    assert smooth.count() == 2
    world, _ = compare_models_global(log, {"g": {"reciprocity_count": "linear", "time": "global_time"}}, sampling=Sampling(seed=4), k=5)
    assert world.count() == 1
    with pytest.raises(ValueError):
        compare_models(log, {})


def test_random_effects_use_all_controls(spark):
    from braidlog.models.rem import fit_effects

    rng = np.random.default_rng(5)
    effect, rows = {f"s{k}": 1.5 * (k - 2) / 2 for k in range(5)}, []
    for g in range(300):
        x, s, r = rng.normal(size=4), rng.choice(5, 4), rng.choice(3, 4)
        case = int(np.argmax(0.7 * x + [effect[f"s{k}"] for k in s] + rng.gumbel(size=4)))
        rows += [(g, int(k == case), float(x[k]), f"s{s[k]}", f"r{r[k]}") for k in range(4)]
    data = spark.createDataFrame(rows, "stratum long, event int, x double, sender string, receiver string")
    fit = fit_effects(data, ["x"], ["sender", "receiver"])
    X = np.array([[r[2], *(r[3] == f"s{k}" for k in range(5)), *(r[4] == f"r{k}" for k in range(3))] for r in rows], float)
    y, g = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    assert fit.n == 300 and fit.log_lik == pytest.approx(brute_clogit(X, y, g, fit.beta))
    ridge = np.repeat([0, *fit.smoothing], [1, 5, 3])
    goal = lambda b: brute_clogit(X, y, g, b) - 0.5 * (ridge * b**2).sum()
    slope = [(goal(fit.beta + d) - goal(fit.beta - d)) / 2e-4 for d in 1e-4 * np.eye(9)]
    assert fit.converged and np.abs(slope).max() < 0.1
    assert np.corrcoef(fit.coef()["re(sender)"], list(effect.values()))[0, 1] > 0.95 and fit.coef()["x"] == pytest.approx(0.7, abs=0.25)


def test_comparison_with_random_effects(log):
    models, s = {"one": ["reciprocity_count"]}, Sampling(seed=4, n_controls=3)
    plain = compare_models(log, models, s)[0].first()["log_lik"]
    table, fits = compare_models(log, models, s, ["sender", "receiver"], 0.5)
    row = table.first()
    # Of all four rows of a stratum; the first control alone would begin at 160 log 2.
    assert row["n_obs"] == 160 and -160 * np.log(4) <= plain <= row["log_lik"] + 0.01 and row["log_lik"] < -160 * np.log(2)
    assert len(fits["one"].smoothing) == 2 and row["AIC"] == pytest.approx(-2 * row["log_lik"] + 2 * fits["one"].edf)
    with pytest.raises(ValueError):
        compare_models(log, models, s, "actor")


def test_goodness_of_fit(log):
    stats, s = ["reciprocity_count", "sender_outdegree"], Sampling(seed=4)
    rest = martingale_residuals(log, stats, s)
    assert rest.groupBy("stratum").agg(F.sum("residual").alias("x")).filter("abs(x) > 1e-9").isEmpty() and rest.count() == 320
    ready = prepare_linear(log, ["reciprocity_count"], s)
    one = gof_univariate(log, ["reciprocity_count"], "reciprocity_count", s, ready)
    end = one["process"].orderBy(F.desc("u")).first()
    assert abs(end["W"]) < 1e-9 and end["u"] == 1
    assert gof_global(log, ["reciprocity_count"], s)["p_value"] == pytest.approx(one["p_value"], abs=1e-9)
    assert 0 <= gof_multivariate(log, stats, "sender_outdegree", n_sim=60, sampling=s)["p_value"] <= 1
    assert 0 < gof_auxiliary(log, ["reciprocity_count"], "sender_outdegree", 60, s)["p_value"] <= 1


def test_several_controls(log):
    """Residuals are those of the fit to all controls; what takes differences refuses more than one."""
    stats, s = ["reciprocity_count"], Sampling(seed=4, n_controls=3)
    rest = martingale_residuals(log, stats, s)
    assert rest.count() == 640 and rest.groupBy("stratum").agg(F.sum("residual").alias("x")).filter("abs(x) > 1e-9").isEmpty()
    for call in (lambda: prepare_linear(log, stats, s), lambda: gof_auxiliary(log, stats, "sender_outdegree", 60, s), lambda: compare_models_smooth(log, {"a": {"reciprocity_count": "nl"}}, s), lambda: compare_models_global(log, {"a": {"reciprocity_count": "linear"}}, None, s)):
        with pytest.raises(ValueError, match="one control"):
            call()


def test_network_is_evaluated_over_all_strata(long):
    """A fit that learns from 50 strata reports on all 400, as its own scores have it."""
    fit = rem("x", long, "nn", stratum="stratum", nn=NetControl(epochs=10, seed=1, strata=50))
    rows = sorted((r["stratum"], r["event"], r["x"]) for r in long.collect())
    eta = fit.predict(np.array([[r[2]] for r in rows])).reshape(-1, 4)
    case = np.array([r[1] for r in rows]).reshape(-1, 4) == 1
    want = (eta[case] - np.log(np.exp(eta).sum(1))).sum()
    assert fit.n == 400 and fit.log_lik == pytest.approx(want, rel=1e-9) and fit.concordance == pytest.approx((eta[case] >= eta.max(1)).mean())


def test_processes_by_ranges(spark, log):
    """Goodness of fit whose order is dealt by ranges, against the whole order at once."""
    from braidlog.models.compare import bridge_suprema, case_control_features, residual_process
    from braidlog.models.likelihood import difference_step, newton
    from braidlog.operators.reshape import widen_case_control

    s = Sampling(seed=3)
    stats = ["reciprocity_count", "sender_outdegree"]
    wide = widen_case_control(case_control_features(log, stats, s), "event", "stratum", stats)
    fit = newton(lambda b: difference_step(wide, ["d_reciprocity_count"], b), stats[:1])
    rows = sorted((int(r["stratum"]), r["d_reciprocity_count"], r["d_sender_outdegree"]) for r in wide.collect())
    x, h = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    r = 1 - 1 / (1 + np.exp(-x * fit.beta[0]))
    got = gof_auxiliary(log, stats[:1], stats[1], 200, s)
    assert got["statistic"] == pytest.approx(np.abs(np.cumsum(h * r)).max() / np.sqrt(len(r)), rel=1e-9)
    w, rng = r * (1 - r), np.random.default_rng(0)
    drift = np.cumsum(h * w * x) / (w * x * x).sum()
    tops = [np.abs(np.cumsum(h * r * e) - drift * (x * r * e).sum()).max() / np.sqrt(len(r)) for e in rng.standard_normal((2000, len(r)))]
    assert abs(got["p_value"] - np.mean(np.array(tops) >= got["statistic"])) < 0.12
    with_p = wide.withColumns({"__order": wide["stratum"].cast("long"), "__p": F.lit(1.0) - 1 / (1 + F.exp(F.col("d_reciprocity_count") * float(fit.beta[0])))})
    process = residual_process(with_p, ["d_sender_outdegree"]).orderBy("__order").collect()
    want = np.cumsum(h * r) - np.arange(1, len(r) + 1) / len(r) * (h * r).sum()
    assert [p["w_d_sender_outdegree"] for p in process] == pytest.approx(want, abs=1e-8)
    for block in (7, 1 << 16):  # blocks change the draws, not the law: suprema of a one-dimensional bridge
        top = np.sqrt([t["top"] for t in bridge_suprema(spark, 400, 1, 600, block=block).collect()])
        assert abs((top > 1.2238).mean() - 0.1) < 0.05
    assert ks_p_value(0) == 1 and ks_p_value(1.36) == pytest.approx(0.049, abs=0.002)
    assert cauchy_combination([0.03])[1] == pytest.approx(0.03)
