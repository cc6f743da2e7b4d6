"""Comparing specifications by AIC on one shared case-control sample, residuals and goodness of fit."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlog.functions.temporal import as_of_small
from braidlog.functions.splines import Basis
from braidlog.models.likelihood import LinearFit, difference_step, newton, stratified_step
from braidlog.models.rem import Term, fit_effects, fit_smooth, predict_linear
from braidlog.operators.log import fill_missing
from braidlog.operators.reshape import widen_case_control
from braidlog.operators.sampling import sample_non_events
from braidlog.plans.features import endogenous_features
from braidlog.plans.numbered import numbered
from braidlog.storage import written

TABLE = "model string, n_terms int, n_obs long, log_lik double, AIC double, delta_AIC double"


@dataclass(frozen=True)
class Sampling:
    """How the shared sample is drawn. history "rows": sampled controls count as history, as published comparisons have it; "events": only real events do."""

    n_controls: int = 1
    scope: str = "all"
    mode: str = "one"
    half_life: float | None = None
    seed: int = 0
    history: str = "rows"


def case_control_features(log: DataFrame, stats: Sequence[str], sampling: Sampling) -> DataFrame:
    """The sample with these statistics, nulls as 0, as a table: fits read it many times."""
    if sampling.history not in ("rows", "events"):
        raise ValueError("history must be rows or events")
    sample = written(sample_non_events(log, sampling.n_controls, sampling.scope, sampling.mode, seed=sampling.seed), "sample")
    past = log.select("sender", "receiver", "time") if sampling.history == "events" else None
    out = endogenous_features(sample, list(stats), sampling.half_life, history=past)
    return written(fill_missing(out, list(stats)), "features")


def _checked(models: Mapping[str, object]) -> None:
    if not models or any(not name for name in models):
        raise ValueError("models need names")


def _table(spark, fits: dict[str, tuple[int, int, float, float]], failed: Sequence[str] = ()) -> DataFrame:
    best = float(min((f[3] for f in fits.values()), default=0.0))
    rows = sorted(((m, int(f[0]), int(f[1]), float(f[2]), float(f[3]), float(f[3]) - best) for m, f in fits.items()), key=lambda r: r[4])
    return spark.createDataFrame(rows + [(m, None, None, None, None, None) for m in failed], TABLE)


def compare_models(log: DataFrame, models: Mapping[str, Sequence[str]], sampling: Sampling = Sampling(), random_effects: str | Sequence[str] | None = None, frailty_variance: float = 1.0) -> tuple[DataFrame, dict[str, LinearFit]]:
    """The AIC table and fits of specifications that are lists of statistics.

    With one control the likelihood is that of differences, with more that of strata; both are conditional
    logits. random_effects: sender, receiver or both; the effects of their levels are added with a ridge, in
    the likelihood of strata with all their controls. frailty_variance: where their variance begins, which
    REML then estimates.
    """
    _checked(models)
    axes = [random_effects] if isinstance(random_effects, str) else list(random_effects or ())
    if len(set(axes)) < len(axes) or not set(axes) <= {"sender", "receiver"} or frailty_variance <= 0:
        raise ValueError("random_effects or frailty_variance")
    stats = list(dict.fromkeys(s for m in models.values() for s in m))
    data = case_control_features(log, stats, sampling)
    wide = written(widen_case_control(data, "event", "stratum", stats), "wide") if sampling.n_controls == 1 and not axes else None
    fits: dict[str, LinearFit] = {}
    table = {}
    for name, spec in models.items():
        if axes:
            fit = fit_effects(data, list(spec), axes, frailty_variance)
            fits[name], table[name] = fit, (len(spec), fit.n, fit.log_lik, fit.aic)
            continue
        if wide is not None:
            fit = newton(lambda b, spec=spec: difference_step(wide, [f"d_{s}" for s in spec], b), list(spec))
        else:
            fit = newton(lambda b, spec=spec: stratified_step(data, list(spec), b), list(spec))
        fits[name], table[name] = fit, (len(spec), fit.n, fit.log_lik, fit.aic)
    return _table(log.sparkSession, table), fits


def compare_models_smooth(log: DataFrame, models: Mapping[str, Mapping[str, str]], sampling: Sampling = Sampling(), k: int = 8) -> tuple[DataFrame, dict[str, object]]:
    """The same for specifications that give each statistic an effect: linear, tv, nl or tvnl. One control. A fit that fails is a row of nulls."""
    _checked(models)
    _one_control(sampling)
    stats = list(dict.fromkeys(s for m in models.values() for s in m))
    data = case_control_features(log, stats, sampling)
    wide = widen_case_control(data, "event", "stratum", [*stats, "time"]).withColumnRenamed("time_ev", "time")
    wide = written(wide, "wide")
    fits, table, failed = {}, {}, []
    for name, spec in models.items():
        try:
            fit = fit_smooth(wide, [Term(kind, s) for s, kind in spec.items()], "time", k)
        except np.linalg.LinAlgError:
            failed.append(name)
            continue
        fits[name], table[name] = fit, (len(spec), fit.n, fit.log_lik, fit.aic)
    return _table(log.sparkSession, table, failed), fits


def compare_models_global(log: DataFrame, models: Mapping[str, Mapping[str, str]], global_covariates: DataFrame | None = None, sampling: Sampling = Sampling(), shift_scale: float = 1.0, k: int = 8, k_cyclic: int = 10, period: float = 1.0, compat: bool = True) -> tuple[DataFrame, dict[str, object]]:
    """Adds effects of what all dyads share: global_smooth and global_cyclic of a covariate, global_time.

    A control is looked at an exponential time before its event, shift_scale mean gaps long on average
    and drawn by a hash, so a shared value differs within a stratum. Covariates are the last ones known
    then (compat: the last row of the table is never used). One control.
    """
    _checked(models)
    _one_control(sampling)
    shared = ("global_smooth", "global_cyclic", "global_time")
    stats = list(dict.fromkeys(s for m in models.values() for s, kind in m.items() if kind not in shared))
    values = list(dict.fromkeys(s for m in models.values() for s, kind in m.items() if kind in ("global_smooth", "global_cyclic") and s != "time"))
    span = log.agg((F.max("time") - F.min("time")).alias("span"), F.count(F.lit(1)).alias("n")).first()
    gap = shift_scale * float(span["span"]) / max(1, span["n"] - 1)
    data = case_control_features(log, stats, sampling) if stats else written(sample_non_events(log, sampling.n_controls, sampling.scope, sampling.mode, seed=sampling.seed), "sample")
    u = (F.pmod(F.xxhash64(F.lit(sampling.seed), F.lit("shift"), "stratum"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    data = data.withColumn("looked", F.when(F.col("event") == 1, F.col("time")).otherwise(F.col("time") + F.log(u) * gap))
    if values:
        if global_covariates is None:
            raise ValueError("global covariates are missing")
        data = as_of_small(data, global_covariates, "looked", "time", values, compat=compat)
    wide = widen_case_control(data, "event", "stratum", [*stats, *values, "looked"])
    wide = written(wide.withColumn("time", F.col("looked_ev")), "wide")
    fits, table, failed = {}, {}, []
    for name, spec in models.items():
        terms = [Term("nl", "looked" if kind == "global_time" or s == "time" else s) if kind in shared else Term(kind, s) for s, kind in spec.items()]
        cyclic = {("looked" if s == "time" else s): period for s, kind in spec.items() if kind == "global_cyclic"}
        try:
            fit = fit_smooth(wide, terms, "time", k_cyclic if cyclic else k, cyclic)
        except np.linalg.LinAlgError:
            failed.append(name)
            continue
        fits[name], table[name] = fit, (len(spec), fit.n, fit.log_lik, fit.aic)
    return _table(log.sparkSession, table, failed), fits


@dataclass
class Prepared:
    """A linear fit on one control for each event: differences as a table, with the fitted probability of the case."""

    stats: list[str]
    fit: LinearFit
    wide: DataFrame
    data: DataFrame


def _one_control(sampling: Sampling) -> None:
    """Differences of a case and its control say nothing of further controls, so these aren't left out without a word."""
    if sampling.n_controls != 1:
        raise ValueError("this needs a sample with one control; compare_models, martingale_residuals and rem take more")


def prepare_linear(log: DataFrame, stats: Sequence[str], sampling: Sampling = Sampling()) -> Prepared:
    _one_control(sampling)
    data = case_control_features(log, stats, sampling)
    wide = written(widen_case_control(data, "event", "stratum", list(stats)), "wide")
    fit = newton(lambda b: difference_step(wide, [f"d_{s}" for s in stats], b), list(stats))
    eta = F.lit(0.0)
    for s, b in zip(stats, fit.beta):
        eta = eta + F.col(f"d_{s}") * F.lit(float(b))
    wide = wide.withColumn("__p", 1 / (1 + F.exp(-eta))).withColumn("__order", F.col("stratum").cast("long"))
    return Prepared(list(stats), fit, wide, data)


def martingale_residuals(log: DataFrame, stats: Sequence[str], sampling: Sampling = Sampling()) -> DataFrame:
    """stratum, role, sender, receiver, time, eta, fitted_prob, residual: 1 - p of a case, -p of a control, which sum to 0 in a stratum."""
    data = case_control_features(log, stats, sampling)
    rows = predict_linear(newton(lambda b: stratified_step(data, list(stats), b), list(stats)), data)
    top = F.max("eta").over(Window.partitionBy("stratum"))
    rows = rows.withColumn("__w", F.exp(F.col("eta") - top))
    p = F.col("__w") / F.sum("__w").over(Window.partitionBy("stratum"))
    rows = rows.withColumn("fitted_prob", p).withColumn("role", F.when(F.col("event") == 1, "case").otherwise("control"))
    return rows.select("stratum", "role", "sender", "receiver", "time", "eta", "fitted_prob", (F.col("event") - F.col("fitted_prob")).alias("residual"))


def residual_process(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """u and, for each column, the cumulative score process less a ramp to its end, in the order of strata.

    wide has __p, the fitted probability of each case, and __order, one for each row.
    """
    return _process(wide.select("__order", *[((1 - F.col("__p")) * F.col(c)).alias(f"g_{c}") for c in columns]), columns)


def _process(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """__order, u, g_ and w_ of each column: running totals by ranges of the order, less a ramp to the end. scored: __order and g_."""
    scored = numbered(scored, ["__order"], {f"before_{c}": F.col(f"g_{c}").cast("double") for c in columns})
    whole = scored.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"g_{c}").alias(f"s_{c}") for c in columns]).first()
    u = (F.col("__rank") + 1) / F.lit(max(1, whole["n"]))
    ramp = {c: F.lit(float(whole[f"s_{c}"] or 0.0)) * F.col("u") for c in columns}
    out = scored.withColumn("u", u)
    return out.select("__order", "u", *[f"g_{c}" for c in columns], *[(F.col(f"before_{c}") + F.col(f"g_{c}") - ramp[c]).alias(f"w_{c}") for c in columns])


def ks_p_value(t: float) -> float:
    """Of the supremum of a Brownian bridge."""
    if not math.isfinite(t) or t <= 0:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))))


def gof_univariate(log: DataFrame, stats: Sequence[str], covariate: str, sampling: Sampling = Sampling(), ready: Prepared | None = None) -> dict:
    """statistic, p_value and the process of one covariate of the model."""
    if covariate not in stats:
        raise ValueError(f"{covariate} isn't in the model")
    ready = ready or prepare_linear(log, stats, sampling)
    c = f"d_{covariate}"
    process = residual_process(ready.wide, [c])
    row = process.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(f"g_{c}") ** 2).alias("J"), F.max(F.abs(f"w_{c}")).alias("top")).first()
    statistic = row["top"] / math.sqrt(row["n"]) / math.sqrt(row["J"] + 1e-8)
    scale = 1 / math.sqrt(row["n"]) / math.sqrt(row["J"] + 1e-8)
    return {"statistic": statistic, "p_value": ks_p_value(statistic), "covariate": covariate, "process": process.select("u", (F.col(f"w_{c}") * scale).alias("W"))}


def cauchy_combination(p_values: Sequence[float]) -> tuple[float, float]:
    """Statistic and p-value of the combined p-values, each kept off 0 and 1."""
    p = np.clip(np.asarray(p_values, float), 1e-15, 1 - 1e-15)
    t = float(np.mean(np.tan(np.pi * (0.5 - p))))
    return t, 0.5 - math.atan(t) / math.pi


def gof_global(log: DataFrame, stats: Sequence[str], sampling: Sampling = Sampling()) -> dict:
    ready = prepare_linear(log, stats, sampling)
    parts = [gof_univariate(log, stats, s, sampling, ready) for s in stats]
    t, p = cauchy_combination([x["p_value"] for x in parts])
    return {"statistic": t, "p_value": p, "components": [{k: x[k] for k in ("covariate", "statistic", "p_value")} for x in parts]}


def bridge_suprema(spark: SparkSession, n: int, q: int, n_sim: int, seed: int = 0, block: int = 1 << 16) -> DataFrame:
    """sim, top: the greatest squared norm of each of n_sim q-dimensional Brownian bridges on n points, each made by a task in blocks.

    A bridge is a walk less a ramp to the walk's end, which is known after going through the same draws once before.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sim in batch.column(0).to_pylist():
                walk = lambda sim=sim: ((at, np.random.default_rng((seed, sim, at)).standard_normal((min(block, n - at), q))) for at in range(0, n, block))
                end = sum((x.sum(0) for _, x in walk()), np.zeros(q))
                top, come = 0.0, np.zeros(q)
                for at, x in walk():
                    path = come + np.cumsum(x, 0)
                    come = path[-1]
                    left = path - np.arange(at + 1, at + len(x) + 1)[:, None] / n * end
                    top = max(top, float((left**2).sum(1).max()) / n)
                yield pa.RecordBatch.from_pydict({"sim": [sim], "top": [top]})

    parts = max(1, min(n_sim, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, n_sim, 1, parts).mapInArrow(made, "sim long, top double")


def gof_multivariate(log: DataFrame, stats: Sequence[str], covariate: str, k_basis: int = 5, n_sim: int = 1000, sampling: Sampling = Sampling()) -> dict:
    """The process of a curve's basis columns, against Brownian bridges on as many points. W: a table of u and the process's columns."""
    if covariate not in stats or k_basis < 4 or n_sim < 50:
        raise ValueError("covariate, k_basis or n_sim")
    ready = prepare_linear(log, stats, sampling)
    others = [Term("linear", s) for s in stats if s != covariate]
    fit = fit_smooth(ready.wide.drop("__p"), [Term("nl", covariate), *others], k=k_basis)
    q, beta = fit.blocks[0].size - 1, fit.beta  # the columns sum to one at each end
    edges = ready.wide.agg(F.min(F.least(f"{covariate}_ev", f"{covariate}_nv")).alias("lo"), F.max(F.greatest(f"{covariate}_ev", f"{covariate}_nv")).alias("hi")).first()
    basis = Basis(float(edges["lo"]), float(edges["hi"]), k_basis)
    names = [str(k) for k in range(q)]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            H = basis(held[1]) - basis(held[2])
            eta = np.concatenate([H, *(x[:, None] for x in held[3:])], 1) @ beta
            G = H[:, :q] * (1 - 1 / (1 + np.exp(-eta)))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(g) for g in G.T)], names=["__order", *(f"g_{c}" for c in names)])

    picked = ready.wide.select("__order", *[F.col(c).cast("double") for c in (f"{covariate}_ev", f"{covariate}_nv", *[f"d_{s}" for s in stats if s != covariate])])
    process = _process(picked.mapInArrow(scores, ", ".join(["__order long", *(f"g_{c} double" for c in names)])), names)
    pairs = [(a, b) for a in range(q) for b in range(a, q)]
    sums = process.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"g_{a}") * F.col(f"g_{b}")).alias(f"j{a}_{b}") for a, b in pairs]).first()
    n, J = sums["n"], np.zeros((q, q))
    for a, b in pairs:
        J[a, b] = J[b, a] = sums[f"j{a}_{b}"] / n
    spread, axes = np.linalg.eigh(J + 1e-8 * np.eye(q))
    root = axes / np.sqrt(np.maximum(spread, 1e-8)) @ axes.T / math.sqrt(n)
    columns = [sum((F.col(f"w_{a}") * float(root[a, b]) for a in range(q)), F.lit(0.0)) for b in range(q)]
    W = process.select("__order", "u", *[c.alias(f"W{b}") for b, c in enumerate(columns)])
    statistic = float(W.agg(F.max(sum((F.col(f"W{b}") ** 2 for b in range(q)), F.lit(0.0)))).first()[0])
    p = bridge_suprema(log.sparkSession, n, q, n_sim, sampling.seed).agg(F.avg((F.col("top") >= statistic).cast("double"))).first()[0]
    return {"statistic": statistic, "p_value": float(p), "W": W, "covariate": covariate, "n_sim": n_sim}


def gof_auxiliary(log: DataFrame, stats: Sequence[str], auxiliary: str, n_sim: int = 1000, sampling: Sampling = Sampling()) -> dict:
    """A statistic outside the model: its residual process against signs drawn anew, the model's own score taken out.

    The order is dealt by ranges. A range's sums for every simulation come first; with those of the ranges
    before it, it then follows each simulated path by itself. The driver gets sums: ranges by simulations.
    """
    if auxiliary in stats:
        raise ValueError(f"{auxiliary} is in the model")
    _one_control(sampling)
    data = case_control_features(log, [*stats, auxiliary], sampling)
    wide = written(widen_case_control(data, "event", "stratum", [*stats, auxiliary]), "wide")
    fit = newton(lambda b: difference_step(wide, [f"d_{s}" for s in stats], b), list(stats))
    columns, p, seed, beta = [f"d_{s}" for s in [*stats, auxiliary]], len(stats), sampling.seed + 17, fit.beta
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = wide.select(F.col("stratum").cast("long").alias("o"), *[F.col(c).cast("double") for c in columns])
    rows = written(rows.repartitionByRange(parts, "o").withColumn("part", F.spark_partition_id()), "ranges")

    def read(table: pa.Table) -> tuple[np.ndarray, ...]:
        table = table.sort_by("o")
        D = np.stack([table[c].to_numpy() for c in columns], 1)
        X, h = D[:, :-1], D[:, -1]
        fitted = 1 / (1 + np.exp(-(X @ beta)))
        return X, h, 1 - fitted, fitted * (1 - fitted)

    def signs(part: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
        for sim in range(n_sim):
            yield sim, np.random.default_rng((seed, part, sim)).standard_normal(n)

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        X, h, r, w = read(table)
        drawn = [np.append((h * r * e).sum(), (X * (r * e)[:, None]).sum(0)) for _, e in signs(key[0].as_py(), len(h))]
        own = np.concatenate([[len(h), (h * r).sum()], ((h * w)[:, None] * X).sum(0), ((X * w[:, None]).T @ X).ravel()])
        return pa.table({"part": [key[0].as_py()], "own": [own.tolist()], "drawn": [np.concatenate(drawn).tolist()]}, schema=pa.schema([("part", pa.int32()), ("own", pa.list_(pa.float64())), ("drawn", pa.list_(pa.float64()))]))

    found = sorted(rows.groupBy("part").applyInArrow(sums, "part int, own array<double>, drawn array<double>").collect(), key=lambda x: x["part"])
    if not found:
        return {"statistic": 0.0, "p_value": 1.0, "auxiliary": auxiliary, "n_sim": n_sim}
    own, drawn = np.array([x["own"] for x in found]), np.array([x["drawn"] for x in found]).reshape(len(found), n_sim, p + 1)
    n = int(own[:, 0].sum())
    inverse = np.linalg.pinv(own[:, 2 + p :].sum(0).reshape(p, p))
    # Per range: what the process, the simulated processes and their drift have come to before it; per simulation: the model's score.
    earlier = lambda x: np.cumsum(x, 0) - x
    starts = {x["part"]: (a, b, c) for x, a, b, c in zip(found, earlier(own[:, 1]), earlier(own[:, 2 : 2 + p]), earlier(drawn[:, :, 0]))}
    score = drawn[:, :, 1:].sum(0) @ inverse

    def tops(key: tuple, table: pa.Table) -> pa.Table:
        X, h, r, w = read(table)
        came, drifted, walked = starts[key[0].as_py()]
        drift = drifted + np.cumsum((h * w)[:, None] * X, 0)
        top = [np.abs(came + np.cumsum(h * r)).max()]
        for sim, e in signs(key[0].as_py(), len(h)):
            top.append(np.abs(walked[sim] + np.cumsum(h * r * e) - drift @ score[sim]).max())
        return pa.table({"sim": pa.array(range(-1, n_sim), pa.int32()), "top": pa.array(top, pa.float64())})

    top = rows.groupBy("part").applyInArrow(tops, "sim int, top double").groupBy("sim").agg((F.max("top") / math.sqrt(n)).alias("top"))
    observed = top.filter("sim < 0").first()["top"]
    more = top.filter((F.col("sim") >= 0) & (F.col("top") >= observed)).count()
    return {"statistic": float(observed), "p_value": (1 + more) / (1 + n_sim), "auxiliary": auxiliary, "n_sim": n_sim}
