"""One step of the case-control likelihood as one aggregate, and Newton's method over such steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _linear(columns: Sequence[str], beta: Sequence[float]):
    out = F.lit(0.0)
    for c, b in zip(columns, beta):
        out = out + F.col(c).cast("double") * F.lit(float(b))
    return out


def difference_step(wide: DataFrame, columns: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """One row: n, loss, gradient, curvature (upper triangle by rows) of the negative log-likelihood of differences, log(1 + exp(-d'b))."""
    eta = _linear(columns, beta)
    p = 1 / (1 + F.exp(-eta))
    x = [F.col(c).cast("double") for c in columns]
    soft = F.greatest(-eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    gradient = F.array(*[F.coalesce(F.sum(-a * (1 - p)), F.lit(0.0)) for a in x])
    curvature = F.array(*[F.coalesce(F.sum(a * b * p * (1 - p)), F.lit(0.0)) for i, a in enumerate(x) for b in x[i:]])
    return wide.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(soft), F.lit(0.0)).alias("loss"), gradient.alias("gradient"), curvature.alias("curvature"))


def stratified_step(data: DataFrame, columns: Sequence[str], beta: Sequence[float], stratum: str = "stratum", case: str = "event") -> DataFrame:
    """The same for strata of one case and any number of controls: a softmax within each stratum.

    The stratum's sums of weights, weighted rows and weighted products come from one aggregate; a
    stratum's greatest linear predictor is taken out first.
    """
    x = [F.col(c).cast("double") for c in columns]
    top = F.max("__eta").over(Window.partitionBy(stratum))
    rows = data.withColumn("__eta", _linear(columns, beta)).withColumn("__w", F.exp(F.col("__eta") - top))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    per = rows.groupBy(stratum).agg(
        F.sum("__w").alias("__sum"), F.sum(F.when(F.col(case) == 1, F.log("__w"))).alias("__case"), F.count(F.when(F.col(case) == 1, 1)).alias("__cases"), F.count(F.lit(1)).alias("__size"),
        *[F.sum(F.col("__w") * a).alias(f"__m{i}") for i, a in enumerate(x)], *[F.sum(F.when(F.col(case) == 1, a)).alias(f"__c{i}") for i, a in enumerate(x)],
        *[F.sum(F.col("__w") * x[i] * x[j]).alias(f"__q{i}_{j}") for i, j in pairs],
    ).filter("__cases = 1 AND __size > 1")
    mean = lambda i: F.col(f"__m{i}") / F.col("__sum")
    return per.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.log("__sum") - F.col("__case")), F.lit(0.0)).alias("loss"),
        F.array(*[F.coalesce(F.sum(mean(i) - F.col(f"__c{i}")), F.lit(0.0)) for i in range(len(x))]).alias("gradient"),
        F.array(*[F.coalesce(F.sum(F.col(f"__q{i}_{j}") / F.col("__sum") - mean(i) * mean(j)), F.lit(0.0)) for i, j in pairs]).alias("curvature"),
    )


@dataclass
class LinearFit:
    """terms and their coefficients; covariance; log_lik at them; n strata; whether the steps settled."""

    terms: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_lik: float
    n: int
    converged: bool
    null_log_lik: float = field(default=0.0)

    @property
    def aic(self) -> float:
        return -2 * self.log_lik + 2 * len(self.terms)

    def coef(self) -> dict[str, float]:
        return dict(zip(self.terms, self.beta.tolist()))

    def summary(self) -> list[dict]:
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        return [{"term": t, "estimate": float(b), "std_error": float(s), "z": float(b / s) if s else float("nan")} for t, b, s in zip(self.terms, self.beta, se)]


def newton(step, terms: Sequence[str], ridge: np.ndarray | None = None, rounds: int = 25, tolerance: float = 1e-9) -> LinearFit:
    """Minimises step(beta) -> one-row table of n, loss, gradient, curvature; each round is one job.

    A step that doesn't lower the loss is halved. Where the data separate cases from controls the
    coefficients grow without end: the rounds are bounded, and converged says so.
    """
    p = len(terms)
    ridge = np.zeros((p, p)) if ridge is None else ridge

    def at(beta: np.ndarray):
        row = step(beta.tolist()).first()
        H = np.zeros((p, p))
        H[np.triu_indices(p)] = row["curvature"]
        H = H + np.triu(H, 1).T
        return row["n"], row["loss"] + 0.5 * beta @ ridge @ beta, np.array(row["gradient"]) + ridge @ beta, H + ridge

    beta = np.zeros(p)
    n, loss, g, H = at(beta)
    null, converged = -loss, False
    for _ in range(rounds):
        move = np.linalg.lstsq(H + 1e-12 * np.eye(p), g, rcond=None)[0]
        size = 1.0
        while size > 1e-4:
            _, new, g2, H2 = at(beta - size * move)
            if new <= loss + 1e-12 * abs(loss):
                break
            size /= 2
        change = loss - new
        beta, loss, g, H = beta - size * move, new, g2, H2
        if abs(change) <= tolerance * (abs(loss) + tolerance):
            converged = True
            break
    return LinearFit(list(terms), beta, np.linalg.pinv(H), -(loss - 0.5 * beta @ ridge @ beta), n, converged, null)
