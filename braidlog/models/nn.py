"""A small network as the score of a conditional-likelihood model: softmax over each stratum, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from braidlog.functions.splines import Basis


@dataclass(frozen=True)
class NetControl:
    """Settings of the fit. strata: that the driver takes at most; a sample of a larger table is drawn by a hash."""

    hidden: tuple[int, ...] = (16, 8)
    activation: str = "relu"
    architecture: str = "mlp"
    spline_df: int = 8
    batch_strata: int | None = None
    epochs: int = 300
    lr: float = 1e-2
    l2: float = 1e-4
    validation: float = 0.2
    patience: int = 25
    standardize: bool = True
    seed: int | None = None
    strata: int = 200_000

    def __post_init__(self):
        if self.activation not in ("relu", "tanh") or self.architecture not in ("mlp", "additive_spline"):
            raise ValueError("activation or architecture")
        if any(h < 1 for h in self.hidden) or self.epochs < 1 or self.lr <= 0 or self.l2 < 0 or not 0 <= self.validation < 1 or self.patience < 1 or self.spline_df < 4:
            raise ValueError("settings out of range")


def nn_control(**settings) -> NetControl:
    return NetControl(**settings)


def segments(strata: np.ndarray) -> np.ndarray:
    """Where each stratum begins; rows of a stratum lie together."""
    return np.flatnonzero(np.append(True, strata[1:] != strata[:-1]))


def stratum_loss(eta: np.ndarray, case: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of strata, and its slope in each row's score."""
    sizes = np.diff(np.append(starts, len(eta)))
    of = np.repeat(np.arange(len(starts)), sizes)
    w = np.exp(eta - np.maximum.reduceat(eta, starts)[of])
    p = w / np.add.reduceat(w, starts)[of]
    return float(-np.log(np.maximum(p[case == 1], 1e-300)).sum() / len(starts)), (p - case) / len(starts)


class Net:
    """Layers of weights and biases; the last has no bias, since it cancels in a stratum."""

    def __init__(self, inputs: int, control: NetControl, rng: np.random.Generator):
        self.control = control
        sizes = [inputs, *(control.hidden if control.architecture == "mlp" else ()), 1]
        self.W = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        if control.architecture == "additive_spline":
            self.W[0] *= 0.01

    def forward(self, X: np.ndarray) -> tuple[np.ndarray, list]:
        kept = [(X, None)]
        for k, (W, b) in enumerate(zip(self.W, self.b)):
            z = kept[-1][0] @ W + b
            last = k == len(self.W) - 1
            kept.append((z if last else np.maximum(z, 0) if self.control.activation == "relu" else np.tanh(z), z))
        return kept[-1][0][:, 0], kept

    def gradients(self, kept: list, slope: np.ndarray) -> list[np.ndarray]:
        """Of W then b, with the penalty on weights only."""
        d, gW, gb = slope[:, None], [], []
        for k in range(len(self.W) - 1, -1, -1):
            gW.append(kept[k][0].T @ d + 2 * self.control.l2 * self.W[k])
            gb.append(d.sum(0))
            if k:
                d = d @ self.W[k].T
                d = d * (kept[k][1] > 0) if self.control.activation == "relu" else d * (1 - kept[k][0] ** 2)
        return gW[::-1] + gb[::-1]

    def loss(self, X, case, starts) -> float:
        return stratum_loss(self.forward(X)[0], case, starts)[0] + self.control.l2 * sum((W**2).sum() for W in self.W)


@dataclass
class NetFit:
    """The fitted network with what turns columns into its inputs. concordance: share of strata whose case scores highest."""

    terms: list[str]
    net: Net
    control: NetControl
    middle: np.ndarray
    wide: np.ndarray
    bases: list[Basis] | None
    history: list[tuple[int, float, float]]
    concordance: float
    log_lik: float
    n: int
    columns: dict = field(default_factory=dict)

    @property
    def parameters(self) -> int:
        return sum(W.size for W in self.net.W) + sum(b.size for b in self.net.b)

    def coef(self) -> None:
        return None

    def inputs(self, X: np.ndarray) -> np.ndarray:
        X = (X - self.middle) / self.wide
        return np.concatenate([b(X[:, k]) for k, b in enumerate(self.bases)], 1) if self.bases else X

    def predict(self, X: np.ndarray) -> np.ndarray:
        return self.net.forward(self.inputs(X))[0]

    def partial_dependence(self, X: np.ndarray, term: str, grid: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """Centred mean score over a grid of two standard deviations around the term's mean, the others at their means."""
        k = self.terms.index(term)
        values = np.linspace(self.middle[k] - 2 * self.wide[k], self.middle[k] + 2 * self.wide[k], grid)
        rows = np.tile(self.middle, (grid, 1))
        rows[:, k] = values
        score = self.predict(rows)
        return values, score - score.mean()


def fit_net(X: np.ndarray, case: np.ndarray, strata: np.ndarray, terms: list[str], control: NetControl = NetControl()) -> NetFit:
    """Adam over strata, stopped early on held-out strata where there are ten or more. Rows of a stratum must lie together."""
    rng = np.random.default_rng(control.seed)
    starts = segments(strata)
    sizes = np.diff(np.append(starts, len(strata)))
    middle, wide = (X.mean(0), X.std(0, ddof=1)) if control.standardize and len(X) > 1 else (np.zeros(X.shape[1]), np.ones(X.shape[1]))
    wide = np.where(wide > 0, wide, 1.0)
    Z = (X - middle) / wide
    bases = [Basis(float(Z[:, k].min()), float(Z[:, k].max()), control.spline_df) for k in range(X.shape[1])] if control.architecture == "additive_spline" else None
    design = np.concatenate([b(Z[:, k]) for k, b in enumerate(bases)], 1) if bases else Z
    net = Net(design.shape[1], control, rng)
    n = len(starts)
    held = rng.permutation(n)[: int(round(control.validation * n))] if n >= 10 else np.empty(0, int)
    learn = np.setdiff1d(np.arange(n), held)

    def part(chosen: np.ndarray):
        at = np.repeat(starts[chosen] - (np.cumsum(sizes[chosen]) - sizes[chosen]), sizes[chosen]) + np.arange(sizes[chosen].sum())
        return design[at], case[at], np.cumsum(sizes[chosen]) - sizes[chosen]

    test = part(held) if len(held) else None
    params = net.W + net.b
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    best, kept, since, history = np.inf, [p.copy() for p in params], 0, []
    batch = control.batch_strata or len(learn)
    for epoch in range(control.epochs):
        order = rng.permutation(learn) if batch < len(learn) else learn
        for a in range(0, len(order), batch):
            A, y, s = part(order[a : a + batch])
            eta, cache = net.forward(A)
            g = net.gradients(cache, stratum_loss(eta, y, s)[1])
            t += 1
            for p, gi, mi, vi in zip(params, g, m, v):
                mi += 0.1 * (gi - mi)
                vi += 0.001 * (gi**2 - vi)
                p -= control.lr * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
        A, y, s = part(learn)
        trained = stratum_loss(net.forward(A)[0], y, s)[0]
        score = stratum_loss(net.forward(test[0])[0], test[1], test[2])[0] if test else trained
        history.append((epoch + 1, trained, score))
        if score < best - 1e-6:
            best, kept, since = score, [p.copy() for p in params], 0
        else:
            since += 1
            if test and since >= control.patience:
                break
    for p, k in zip(params, kept):
        p[...] = k
    eta = net.forward(design)[0]
    of = np.repeat(np.arange(n), sizes)
    place = np.lexsort((np.arange(len(eta)), -eta, of))
    first = place[np.searchsorted(of[place], np.arange(n))]
    return NetFit(terms, net, control, middle, wide, bases, history, float(case[first].mean()), -n * stratum_loss(eta, case, starts)[0], n)
