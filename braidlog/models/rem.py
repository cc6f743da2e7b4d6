"""Relational event models: terms, conditional logit, penalised additive fits, networks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.splines import Basis
from braidlog.models.likelihood import LinearFit, difference_step, newton, stratified_step
from braidlog.models.nn import NetControl, NetFit, fit_net
from braidlog.operators.reshape import case_column, derive_stratum, widen_case_control
from braidlog.storage import written


@dataclass(frozen=True)
class Term:
    """kind: linear, tv (effect over time), nl (curve of the value), tvnl (both) or re (an effect for each level)."""

    kind: str
    name: str

    def __str__(self) -> str:
        return self.name if self.kind == "linear" else f"{self.kind}({self.name})"


def parse_terms(formula: str | Sequence[str]) -> list[Term]:
    """"x + tv(y) + nl(z)", or the terms of such a formula."""
    parts = formula.split("+") if isinstance(formula, str) else list(formula)
    out = []
    for part in map(str.strip, parts):
        found = re.fullmatch(r"(tvnl|tv|nl|re)\(\s*([\w.]+)\s*\)", part)
        if not found and not re.fullmatch(r"[\w.]+", part):
            raise ValueError(f"not a term: {part!r}")
        out.append(Term(*found.groups()) if found else Term("linear", part))
    if not out or len({str(t) for t in out}) < len(out):
        raise ValueError("a formula needs terms, each once")
    return out


@dataclass
class Block:
    """Columns of the design for a term, with its penalties (none: unpenalised). make: arrays of the used columns -> columns."""

    term: Term
    size: int
    columns: list[str]
    make: object
    penalties: list[np.ndarray]


@dataclass
class SmoothFit:
    """Coefficients of all blocks; smoothing: one value for each penalty; edf; log_lik."""

    terms: list[Term]
    blocks: list[Block]
    beta: np.ndarray
    covariance: np.ndarray
    smoothing: list[float]
    edf: float
    log_lik: float
    n: int
    converged: bool

    @property
    def aic(self) -> float:
        return -2 * self.log_lik + 2 * self.edf

    def coef(self) -> dict[str, float | np.ndarray]:
        out, at = {}, 0
        for b in self.blocks:
            value = self.beta[at : at + b.size]
            out[str(b.term)] = float(value[0]) if b.size == 1 else value
            at += b.size
        return out

    def summary(self) -> list[dict]:
        out, at = [], 0
        for b in self.blocks:
            se = math.sqrt(max(self.covariance[at, at], 0)) if b.size == 1 else None
            out.append({"term": str(b.term), "columns": b.size, "estimate": float(self.beta[at]) if b.size == 1 else None, "std_error": se})
            at += b.size
        return out


def _pair(df: DataFrame, name: str) -> tuple[str, str]:
    if {f"{name}_ev", f"{name}_nv"} <= set(df.columns):
        return f"{name}_ev", f"{name}_nv"
    raise ValueError(f"a curve of {name} needs {name}_ev and {name}_nv")


def _blocks(wide: DataFrame, terms: list[Term], time: str, k: int, cyclic: dict[str, float] | None = None) -> list[Block]:
    ranges: dict[str, tuple[float, float]] = {}
    used = [c for t in terms if t.kind in ("tv", "nl", "tvnl") for c in ([time] if t.kind != "nl" else []) + (list(_pair(wide, t.name)) if t.kind != "tv" else [])]
    if used:
        row = wide.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(dict.fromkeys(used)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        ranges = {c: (float(row[f"lo{i}"]), float(row[f"hi{i}"])) for i, c in enumerate(dict.fromkeys(used))}
    out = []
    for t in terms:
        if t.kind in ("linear", "tv"):
            if f"d_{t.name}" in wide.columns:
                columns, diff = [f"d_{t.name}"], lambda a: a[0]
            elif t.name in wide.columns:
                columns, diff = [t.name], lambda a: a[0]
            else:
                columns, diff = list(_pair(wide, t.name)), lambda a: a[0] - a[1]
        if t.kind == "linear":
            out.append(Block(t, 1, columns, lambda a, diff=diff: diff(a)[:, None], []))
        elif t.kind == "tv":
            basis = Basis(*ranges[time], k)
            out.append(Block(t, k, [*columns, time], lambda a, diff=diff, basis=basis: basis(a[-1]) * diff(a)[:, None], [basis.penalty()]))
        elif t.kind == "nl":
            pair = _pair(wide, t.name)
            lo, hi = min(ranges[c][0] for c in pair), max(ranges[c][1] for c in pair)
            basis = Basis(0.0, cyclic[t.name], k, cyclic=True) if cyclic and t.name in cyclic else Basis(lo, hi, k)
            # A constant cancels in the difference; a small ridge settles it.
            out.append(Block(t, k, list(pair), lambda a, basis=basis: basis(a[0]) - basis(a[1]), [basis.penalty()]))
        elif t.kind == "tvnl":
            pair = _pair(wide, t.name)
            lo, hi = min(ranges[c][0] for c in pair), max(ranges[c][1] for c in pair)
            over, along, m = Basis(*ranges[time], max(5, k // 2 + 2)), Basis(lo, hi, max(5, k // 2 + 2)), max(5, k // 2 + 2)
            make = lambda a, over=over, along=along, m=m: (over(a[2])[:, :, None] * (along(a[0]) - along(a[1]))[:, None, :]).reshape(-1, m * m)
            out.append(Block(t, m * m, [*pair, time], make, [np.kron(over.penalty(), np.eye(m)), np.kron(np.eye(m), along.penalty())]))
        else:
            pair = _pair(wide, t.name)
            levels = [r[0] for r in wide.select(F.explode(F.array(*[F.col(c).cast("string") for c in pair])).alias("l")).filter("l IS NOT NULL").distinct().orderBy("l").collect()]
            place = {x: i for i, x in enumerate(levels)}
            if len(levels) > 5000:
                raise ValueError(f"re({t.name}) has {len(levels)} levels; the normal matrix is dense")

            def make(a, place=place, n=len(levels)):
                X = np.zeros((len(a[0]), n))
                for sign, col in ((1, a[0]), (-1, a[1])):
                    at = np.array([place.get(x, -1) for x in col])
                    np.add.at(X, (np.flatnonzero(at >= 0), at[at >= 0]), sign)
                return X

            out.append(Block(t, len(levels), list(pair), make, [np.eye(len(levels))]))
    return out


def _normal(wide: DataFrame, blocks: list[Block], beta: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """n, loss, gradient and curvature at beta: each partition sums its rows' parts, so what comes to the driver has the design's size."""
    columns = list(dict.fromkeys(c for b in blocks for c in b.columns))
    text = {c for b in blocks if b.term.kind == "re" for c in b.columns}
    q = len(beta)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, g, H = 0, 0.0, np.zeros(q), np.zeros((q, q))
        for batch in batches:
            held = {c: batch.column(i).to_pylist() if c in text else batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(columns)}
            X = np.concatenate([b.make([held[c] for c in b.columns]) for b in blocks], 1)
            eta = X @ beta
            p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
            n, loss = n + len(eta), loss + float(np.logaddexp(0, -eta).sum())
            g -= X.T @ (1 - p)
            H += (X * (p * (1 - p))[:, None]).T @ X
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "loss": [loss], "g": [g.tolist()], "h": [H.ravel().tolist()]})

    picked = wide.select(*[F.col(c).cast("string" if c in text else "double") for c in columns]).dropna()
    sums = picked.mapInArrow(part, "n long, loss double, g array<double>, h array<double>").collect()
    return sum(r["n"] for r in sums), sum(r["loss"] for r in sums), np.sum([r["g"] for r in sums], 0), np.sum([r["h"] for r in sums], 0).reshape(q, q)


def fit_smooth(wide: DataFrame, terms: list[Term], time: str = "time", k: int = 8, cyclic: dict[str, float] | None = None, rounds: int = 40) -> SmoothFit:
    """Penalised Newton steps with smoothing parameters by REML (the update of Fellner and Schall after each step).

    Differences of a case and its control, response one, no intercept. Penalties are of squared second
    differences of B-spline coefficients, and a ridge for effects of levels.
    """
    blocks = _blocks(wide, terms, time, k, cyclic)
    q = sum(b.size for b in blocks)
    whole: list[np.ndarray] = []
    at = 0
    for b in blocks:
        for P in b.penalties:
            S = np.zeros((q, q))
            S[at : at + b.size, at : at + b.size] = P
            whole.append(S)
        at += b.size
    beta, V, lam, edf, log_lik, n, converged = _penalised(lambda beta: _normal(wide, blocks, beta), whole, np.ones(len(whole)), q, rounds)
    return SmoothFit(terms, blocks, beta, V, lam, edf, log_lik, n, converged)


def _penalised(step, whole: list[np.ndarray], lam: np.ndarray, q: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float], float, float, int, bool]:
    """Coefficients, covariance, smoothing, edf, log_lik, n and whether the steps settled; step: beta -> n, loss, gradient, curvature. lam: where smoothing begins."""
    lam, beta = lam.copy(), np.zeros(q)
    small = 1e-6 * np.eye(q)
    total = lambda: sum((x * S for x, S in zip(lam, whole)), np.zeros((q, q))) + small
    n, loss, g, H = step(beta)
    converged = False
    for _ in range(rounds):
        S = total()
        move = np.linalg.solve(H + S, g + S @ beta)
        size, before = 1.0, loss + 0.5 * beta @ S @ beta
        while True:
            new = beta - size * move
            n, loss2, g2, H2 = step(new)
            if loss2 + 0.5 * new @ S @ new <= before + 1e-9 * abs(before) or size < 1e-3:
                break
            size /= 2
        change = before - (loss2 + 0.5 * new @ S @ new)
        beta, loss, g, H = new, loss2, g2, H2
        V, inverse = np.linalg.inv(H + S), np.linalg.pinv(S - small, rcond=1e-9)
        old = lam.copy()
        for j, P in enumerate(whole):
            up = max(float(np.trace(inverse @ P) - np.trace(V @ P)), 1e-8)
            lam[j] = float(np.clip(lam[j] * up / max(float(beta @ P @ beta), 1e-10), 1e-6, 1e7))
        if abs(change) < 1e-7 * (abs(loss) + 1e-7) and np.all(np.abs(np.log(lam / old)) < 0.05):
            converged = True
            break
    S = total()
    V = np.linalg.inv(H + S)
    return beta, V, lam.tolist(), float(np.trace(V @ H)), -loss, n, converged


def fit_effects(data: DataFrame, columns: Sequence[str], axes: Sequence[str], variance: float = 1.0, stratum: str = "stratum", case: str = "event", rounds: int = 40) -> SmoothFit:
    """The stratified conditional logit over all controls, with an effect for each level of each axis.

    The effects of an axis have a ridge, which is the inverse of their variance: it begins at `variance` and
    follows by REML, as in fit_smooth. Strata without exactly one case or without controls are left out.
    """
    levels = {a: [r[0] for r in data.select(F.col(a).cast("string").alias("l")).filter("l IS NOT NULL").distinct().orderBy("l").collect()] for a in axes}
    for a, names in levels.items():
        if len(names) > 5000:
            raise ValueError(f"re({a}) has {len(names)} levels; the normal matrix is dense")
    starts = np.cumsum([len(columns), *map(len, levels.values())])
    q, p = int(starts[-1]), len(columns)
    place = [{x: int(at) + i for i, x in enumerate(names)} for at, names in zip(starts, levels.values())]
    row = F.struct((F.col(case) == 1).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.array(*[F.col(a).cast("string") for a in axes]).alias("a"))
    strata = written(data.groupBy(stratum).agg(F.collect_list(row).alias("rows")).filter("aggregate(rows, 0, (n, r) -> n + r.y) = 1 AND size(rows) > 1").select("rows"), "strata")

    def sums(beta: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, g, H = 0, 0.0, np.zeros(q), np.zeros((q, q))
            most = max(1, (1 << 21) // q)  # rows of the design held at a time
            for batch in batches:
                held = batch.column(0).to_pylist()
                ends = np.cumsum([len(s) for s in held])
                at = 0
                while at < len(held):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                    flat = [r for s in held[at:to] for r in s]
                    first = np.append(0, np.cumsum([len(s) for s in held[at:to]]))[:-1]
                    of = np.repeat(np.arange(to - at), [len(s) for s in held[at:to]])
                    X = np.zeros((len(flat), q))
                    X[:, :p] = np.array([r["x"] for r in flat], float).reshape(len(flat), p)
                    for j, where in enumerate(place):
                        found = np.array([where.get(r["a"][j], -1) for r in flat])
                        X[np.flatnonzero(found >= 0), found[found >= 0]] = 1
                    y = np.array([r["y"] for r in flat]) == 1
                    eta = X @ beta
                    top = np.maximum.reduceat(eta, first)
                    w = np.exp(eta - top[of])
                    total = np.add.reduceat(w, first)
                    w /= total[of]
                    mean = np.add.reduceat(X * w[:, None], first, 0)
                    n, loss = n + to - at, loss + float((np.log(total) + top - eta[y]).sum())
                    g += mean.sum(0) - X[y].sum(0)
                    H += (X * w[:, None]).T @ X - mean.T @ mean
                    at = to
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "loss": [loss], "g": [g.tolist()], "h": [H.ravel().tolist()]})

        got = strata.mapInArrow(part, "n long, loss double, g array<double>, h array<double>").collect()
        return sum(r["n"] for r in got), sum(r["loss"] for r in got), np.sum([r["g"] for r in got], 0), np.sum([r["h"] for r in got], 0).reshape(q, q)

    blocks = [Block(Term("linear", c), 1, [c], None, []) for c in columns] + [Block(Term("re", a), len(names), [a], None, [np.eye(len(names))]) for a, names in levels.items()]
    whole = [np.diag(((np.arange(q) >= at) & (np.arange(q) < at + len(names))).astype(float)) for at, names in zip(starts, levels.values())]
    beta, V, lam, edf, log_lik, n, converged = _penalised(sums, whole, np.full(len(whole), 1 / variance), q, rounds)
    return SmoothFit([b.term for b in blocks], blocks, beta, V, lam, edf, log_lik, n, converged)


def collected_strata(data: DataFrame, columns: Sequence[str], stratum: str, case: str, most: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of at most `most` strata on the driver, by stratum: columns, case, stratum. A larger table gives a sample by a hash."""
    strata = data.select(stratum).distinct()
    n = strata.count()
    if n > most:
        chosen = strata.orderBy(F.xxhash64(F.lit(seed), F.col(stratum))).limit(most)
        data = data.join(chosen, stratum, "left_semi")
    rows = data.select(F.col(stratum).cast("string").alias("__s"), F.col(case).cast("int").alias("__y"), *[F.col(c).cast("double").alias(c) for c in columns]).orderBy("__s", F.desc("__y")).toArrow()
    X = np.stack([rows[c].to_numpy() for c in columns], 1)
    return np.nan_to_num(X), rows["__y"].to_numpy(), np.unique(rows["__s"].to_numpy(zero_copy_only=False), return_inverse=True)[1]


def rem(formula: str | Sequence[str], data: DataFrame, method: str = "gam", case: str | None = None, stratum: str | None = None, time: str = "time", k: int = 8, nn: NetControl | None = None, order_col: str = "rid"):
    """Fits a relational event model: a LinearFit ("clogit"), SmoothFit ("gam") or NetFit ("nn").

    data: long, with a case indicator and strata, or for "gam" also wide, with d_x or x_ev and x_nv
    columns. "clogit": terms are columns, any number of controls, Newton steps that are one aggregate
    each. "gam": curves and effects of levels too, on differences to the first control. "nn": columns
    only; it learns from at most nn.strata strata, drawn by a hash, and is evaluated over all.
    """
    terms = parse_terms(formula)
    if method not in ("gam", "clogit", "nn"):
        raise ValueError("method must be gam, clogit or nn")
    if method == "gam":
        wide = data
        indicator = next((c for c in ([case] if case else ["event", "IS_OBSERVED"]) if c in data.columns), None)
        if indicator and not data.filter(F.col(indicator) == 0).isEmpty():
            names = [t.name for t in terms]
            wide = widen_case_control(data, indicator, stratum, [n for n in dict.fromkeys([*names, *([time] if time in data.columns and any(t.kind in ("tv", "tvnl") for t in terms) else [])])], order_col=order_col)
            if time not in wide.columns and f"{time}_ev" in wide.columns:
                wide = wide.withColumnRenamed(f"{time}_ev", time)
        return fit_smooth(wide, terms, time, k)
    if any(t.kind != "linear" for t in terms):
        raise ValueError(f"{method} takes columns only")
    names = [t.name for t in terms]
    case = case_column(data, case)
    if missing := [c for c in names if c not in data.columns]:
        raise ValueError(f"no columns {', '.join(missing)}")
    if stratum is None:
        data, stratum = derive_stratum(data, case, None, order_col), "__stratum"
    if method == "clogit":
        return newton(lambda beta: stratified_step(data, names, beta, stratum, case), names)
    control = nn or NetControl()
    return _evaluated(fit_net(*collected_strata(data, names, stratum, case, control.strata, control.seed or 0), names, control), data, stratum, case)


def _evaluated(fit: NetFit, data: DataFrame, stratum: str, case: str) -> NetFit:
    """fit with n, concordance and log_lik of all strata, also where it learned from a sample of them. A case that ties with the best counts."""
    rows = predict_net(fit, data.fillna(0, fit.terms), "__eta").withColumn("__top", F.max("__eta").over(Window.partitionBy(stratum)))
    own = F.when(F.col(case) == 1, F.col("__eta"))
    per = rows.groupBy(stratum).agg(F.max(own).alias("own"), F.max("__top").alias("top"), F.count(own).alias("cases"), F.sum(own - F.col("__top")).alias("over"), F.log(F.sum(F.exp(F.col("__eta") - F.col("__top")))).alias("total"))
    got = per.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("over") - F.col("cases") * F.col("total")).alias("log_lik"), F.avg(F.coalesce((F.col("own") >= F.col("top")).cast("double"), F.lit(0.0))).alias("concordance")).first()
    fit.n, fit.log_lik, fit.concordance = got["n"], float(got["log_lik"] or 0.0), float(got["concordance"] or 0.0)
    return fit


def predict_linear(fit: LinearFit, data: DataFrame, out: str = "eta") -> DataFrame:
    """data with the linear predictor; as an expression, so it stays in the plan."""
    eta = F.lit(0.0)
    for t, b in zip(fit.terms, fit.beta):
        eta = eta + F.col(t).cast("double") * F.lit(float(b))
    return data.withColumn(out, eta)


def predict_net(fit: NetFit, data: DataFrame, out: str = "eta") -> DataFrame:
    @F.pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(fit.predict(columns.to_numpy(float)))

    return data.withColumn(out, score(F.struct(*[F.col(t).cast("double").alias(t) for t in fit.terms])))


def nn_uncertainty(spark, X: np.ndarray, case: np.ndarray, strata: np.ndarray, terms: list[str], control: NetControl, B: int = 200, grid: int = 50, level: float = 0.95, seed: int = 0) -> dict:
    """Bands of centred partial dependence and an interval of concordance, from B refits on strata drawn with replacement; each refit is a task."""
    whole = fit_net(X, case, strata, terms, control)
    starts = np.flatnonzero(np.append(True, strata[1:] != strata[:-1]))
    sizes = np.diff(np.append(starts, len(strata)))
    sent = spark.sparkContext.broadcast((X, case, starts, sizes))

    def refit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import dataclasses

        X, case, starts, sizes = sent.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                pick = np.random.default_rng([seed, b]).integers(0, len(starts), len(starts))
                at = np.repeat(starts[pick] - (np.cumsum(sizes[pick]) - sizes[pick]), sizes[pick]) + np.arange(sizes[pick].sum())
                fit = fit_net(X[at], case[at], np.repeat(np.arange(len(pick)), sizes[pick]), terms, dataclasses.replace(control, seed=b))
                fit.middle, fit.wide = (whole.middle, whole.wide) if not control.standardize else (fit.middle, fit.wide)
                curves = []
                for k, term in enumerate(terms):
                    rows = np.tile(whole.middle, (grid, 1))
                    rows[:, k] = np.linspace(whole.middle[k] - 2 * whole.wide[k], whole.middle[k] + 2 * whole.wide[k], grid)
                    score = fit.predict(rows)
                    curves.append((score - score.mean()).tolist())
                yield pa.RecordBatch.from_pydict({"b": [b], "concordance": [fit.concordance], "curves": pa.array([curves], pa.list_(pa.list_(pa.float64())))})

    rows = spark.range(0, B, 1, min(B, spark.sparkContext.defaultParallelism * 4)).mapInArrow(refit, "b long, concordance double, curves array<array<double>>").collect()
    low, high = (1 - level) / 2, (1 + level) / 2
    curves = np.array([r["curves"] for r in rows])
    agree = np.array([r["concordance"] for r in rows])
    return {
        "fit": whole, "concordance": tuple(np.quantile(agree, [low, high]).tolist()),
        "bands": {t: {"x": whole.partial_dependence(X, t, grid)[0], "mean": whole.partial_dependence(X, t, grid)[1], "low": np.quantile(curves[:, k], low, axis=0), "high": np.quantile(curves[:, k], high, axis=0)} for k, t in enumerate(terms)},
    }
