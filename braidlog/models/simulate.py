"""Simulated event logs: one trajectory in numpy, many as tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.plans.catalog import LEGS, SIMULABLE, STATISTICS


class Sums:
    """How many two-paths each dyad has, when the first and the last formed, and their decayed sum."""

    def __init__(self, actors: int):
        square = lambda v: np.full((actors, actors), v)
        self.count, self.first, self.last, self.decay = square(0.0), square(np.inf), square(-np.inf), square(0.0)

    def add(self, cell: tuple[np.ndarray, np.ndarray], t: float, where: np.ndarray | None) -> None:
        if where is not None:
            cell = cell[0][where], cell[1][where]
        self.count[cell] += 1
        self.decay[cell] += 1
        self.last[cell] = t
        self.first[cell] = np.minimum(self.first[cell], t)

    def clear(self, s: int, r: int) -> None:
        self.count[s, r], self.first[s, r], self.last[s, r], self.decay[s, r] = 0, np.inf, -np.inf, 0


class History:
    """What a trajectory's statistics are read from, for all pairs of actors at once. Times never seen are infinite inside and 0 in statistics."""

    def __init__(self, actors: int, stats: Sequence[str], half_life: float | None, start: float):
        self.n, self.start, self.rate = actors, start, math.log(2) / half_life if half_life else 0.0
        self.stats = [STATISTICS[s] for s in stats]
        square = lambda v: np.full((actors, actors), v)
        self.count, self.first, self.last, self.decay, self.at = square(0.0), square(np.inf), square(-np.inf), square(0.0), start
        # Events of a dyad since its reverse last fired.
        self.icount, self.ifirst, self.ilast, self.idecay = square(0.0), square(np.inf), square(-np.inf), square(0.0)
        self.ordered = {f: np.full((actors,) * 3, np.inf) for f in {s.family for s in self.stats if s.gate == "ordered"}}
        # Two-paths of dyads, by family; of an interrupted one, those since the dyad last fired. An event only touches the dyads that it closes.
        self.closed = {(s.family, s.gate): Sums(actors) for s in self.stats if s.family in LEGS and s.gate != "ordered"}

    def fire(self, s: int, r: int, t: float) -> None:
        self._advance(t)
        self.icount[r, s], self.ifirst[r, s], self.ilast[r, s], self.idecay[r, s] = 0, np.inf, -np.inf, 0
        new = not np.isfinite(self.first[s, r])
        for count, first, last, decay in ((self.count, self.first, self.last, self.decay), (self.icount, self.ifirst, self.ilast, self.idecay)):
            count[s, r] += 1
            decay[s, r] += 1
            last[s, r] = t
            if not np.isfinite(first[s, r]):
                first[s, r] = t
        for (family, gate), sums in self.closed.items():
            if new and s != r:
                for cell in self._closes(family, s, r):
                    sums.add(cell, t, self.last[cell] < t if gate else None)
            if gate:
                sums.clear(s, r)
        for family, O in self.ordered.items():  # O[s, k, r]: the second leg's first event after the first leg began
            if family == "transitivity":
                begun, cell = self.first[:, s] < t, (slice(None), s, r)
            elif family == "cyclic":  # legs r -> k, k -> s: this event is k -> s
                begun, cell = self.first[:, s] < t, (r, s, slice(None))
            elif family == "sending_balance":  # legs s -> k, r -> k: this event is r -> k
                begun, cell = self.first[:, r] < t, (slice(None), r, s)
            else:  # legs k -> s, k -> r: this event is k -> r
                begun, cell = self.first[s, :] < t, (slice(None), s, r)
            line = O[cell]
            line[begun & ~np.isfinite(line)] = t

    def _advance(self, t: float) -> None:
        if self.rate and t > self.at:
            fade = math.exp(-self.rate * (t - self.at))
            self.decay *= fade
            self.idecay *= fade
            for sums in self.closed.values():
                sums.decay *= fade
        self.at = max(self.at, t)

    def _closes(self, family: str, x: int, y: int) -> list[tuple]:
        """The dyads (as rows and columns) for which the new edge x -> y is the later leg of a two-path."""
        near, far = (next(leg for leg in LEGS[family] if end in leg) for end in "sr")
        to_k, from_k = (self.first if near == ("s", "k") else self.first.T), (self.first if far == ("k", "r") else self.first.T)
        s, k = (x, y) if near == ("s", "k") else (y, x)
        other = np.isfinite(from_k[k])
        other[k] = False
        cells = [(np.full(int(other.sum()), s), np.flatnonzero(other))]
        k2, r = (x, y) if far == ("k", "r") else (y, x)
        other = np.isfinite(to_k[:, k2])
        other[k2] = False
        if k2 == k:
            other[s] = False  # both legs are the new edge: found above
        return [*cells, (np.flatnonzero(other), np.full(int(other.sum()), r))]

    def _inner(self, Z: np.ndarray) -> np.ndarray:
        Z = Z.copy()
        k = np.arange(self.n)
        Z[k, k, :] = np.inf
        Z[:, k, k] = np.inf
        return Z

    @staticmethod
    def _since(t: float, when: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(when), t - when, 0.0)

    def values(self, t: float) -> dict[str, np.ndarray]:
        """Of every statistic, for all senders and receivers."""
        self._advance(t)
        out = {}
        for s in self.stats:
            if s.name == "sender_outdegree":
                v = np.repeat(self.count.sum(1)[:, None], self.n, 1)
            elif s.name == "receiver_indegree":
                v = np.repeat(self.count.sum(0)[None, :], self.n, 0)
            elif s.name == "recency":
                v = np.where(np.isfinite(self.last), t - self.last, t - self.start)
            elif s.family == "reciprocity":
                count, first, last, decay = (self.icount, self.ifirst, self.ilast, self.idecay) if s.gate else (self.count, self.first, self.last, self.decay)
                v = {"binary": (count > 0).astype(float), "count": count, "exp_decay": decay, "time_recent": self._since(t, last), "time_first": self._since(t, first)}[s.measure].T
            else:
                if s.gate != "ordered":
                    sums = self.closed[s.family, s.gate]
                    out[s.name] = {"binary": (sums.count > 0).astype(float), "count": sums.count.copy(), "exp_decay": sums.decay.copy(), "time_recent": self._since(t, sums.last), "time_first": self._since(t, sums.first)}[s.measure]
                    continue
                Z = self._inner(self.ordered[s.family])
                seen = np.isfinite(Z) & (Z < t)
                if s.measure in ("binary", "count"):
                    v = seen.sum(1).astype(float)
                    v = (v > 0).astype(float) if s.measure == "binary" else v
                elif s.measure == "exp_decay":
                    v = np.where(seen, np.exp(-self.rate * (t - np.where(seen, Z, t))), 0.0).sum(1)
                elif s.measure == "time_recent":
                    v = self._since(t, np.where(seen, Z, -np.inf).max(1))
                else:
                    v = self._since(t, np.where(seen, Z, np.inf).min(1))
            out[s.name] = v
        return out


@dataclass(frozen=True)
class Simulation:
    """Settings of simulate_relational_events; effects name statistics or columns of covariates."""

    n_events: int
    senders: tuple[str, ...]
    receivers: tuple[str, ...]
    baseline_rate: float = 1.0
    start_time: float = 0.0
    horizon: float = math.inf
    logits: np.ndarray | None = None
    sender_covariates: Mapping[str, Sequence[float]] = field(default_factory=dict)
    receiver_covariates: Mapping[str, Sequence[float]] = field(default_factory=dict)
    sender_effects: Mapping[str, float] = field(default_factory=dict)
    receiver_effects: Mapping[str, float] = field(default_factory=dict)
    endogenous_effects: Mapping[str, float] = field(default_factory=dict)
    endogenous_stats: tuple[str, ...] = ()
    global_breaks: tuple[float, ...] = ()
    global_values: Mapping[str, Sequence[float]] = field(default_factory=dict)
    global_effects: Mapping[str, float] = field(default_factory=dict)
    allow_loops: bool = False
    n_controls: int = 0
    method: str = "gillespie"
    tau: float | None = None
    half_life: float | None = None
    risk: str = "standard"

    def __post_init__(self):
        stats = self.stats
        if self.n_events < 0 or not self.senders or not self.receivers or self.baseline_rate <= 0:
            raise ValueError("n_events, actors or baseline_rate")
        if bad := [s for s in stats if s not in SIMULABLE]:
            raise ValueError(f"statistics that can't be simulated: {', '.join(bad)}")
        if any("exp_decay" in s for s in stats) and not (self.half_life and self.half_life > 0):
            raise ValueError("decayed statistics need a positive half_life")
        if self.method not in ("gillespie", "tau_leap") or (self.method == "tau_leap" and not (self.tau and self.tau > 0)) or self.risk not in ("standard", "remove"):
            raise ValueError("method, tau or risk")
        if any(b <= a for a, b in zip(self.global_breaks, self.global_breaks[1:])):
            raise ValueError("global breaks must increase")
        for table, effects, actors in ((self.sender_covariates, self.sender_effects, self.senders), (self.receiver_covariates, self.receiver_effects, self.receivers)):
            if any(e not in table or len(table[e]) != len(actors) for e in effects):
                raise ValueError("an effect needs a covariate value for each actor")

    @property
    def stats(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.endogenous_stats, *self.endogenous_effects)))


def trajectory(sim: Simulation, seed: int) -> pd.DataFrame:
    """stratum, event, sender, receiver, time, statistics and global values of events and their controls."""
    rng = np.random.default_rng(seed)
    actors = list(dict.fromkeys((*sim.senders, *sim.receivers)))
    place = {a: k for k, a in enumerate(actors)}
    S, R = (np.array([place[a] for a in x]) for x in (sim.senders, sim.receivers))
    static = np.zeros((len(S), len(R))) if sim.logits is None else np.array(sim.logits, float)
    static = static + sum((np.asarray(sim.sender_covariates[c], float) * b for c, b in sim.sender_effects.items()), np.zeros(len(S)))[:, None]
    static = static + sum((np.asarray(sim.receiver_covariates[c], float) * b for c, b in sim.receiver_effects.items()), np.zeros(len(R)))[None, :]
    static[~np.isfinite(static)] = -np.inf
    if not sim.allow_loops:
        static[S[:, None] == R[None, :]] = -np.inf
    history = History(len(actors), sim.stats, sim.half_life, sim.start_time)
    breaks = np.asarray(sim.global_breaks, float)
    where = lambda t: max(0, int(np.searchsorted(breaks, t, "right")) - 1)
    shared = lambda t: {g: float(v[where(t)]) for g, v in sim.global_values.items()} if len(breaks) else {}
    lift = lambda t: math.exp(sum(b * shared(t)[g] for g, b in sim.global_effects.items())) if sim.global_effects else 1.0
    whole = np.array_equal(S, np.arange(len(actors))) and np.array_equal(R, S)
    rows: list[dict] = []
    t, made = sim.start_time, 0

    def read(at: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
        values = history.values(at)
        if not whole:
            values = {k: v[np.ix_(S, R)] for k, v in values.items()}
        return values, sim.baseline_rate * np.exp(static + sum((b * values[k] for k, b in sim.endogenous_effects.items()), 0.0))

    def record(at: float, i: int, j: int, values: dict[str, np.ndarray], rates: np.ndarray) -> None:
        pairs = [(1, i, j)]
        if sim.n_controls:
            open_ = np.flatnonzero(rates.ravel() > 0)
            open_ = open_[open_ != i * len(R) + j]
            pick = rng.choice(open_, min(sim.n_controls, len(open_)), replace=False) if len(open_) else []
            pairs += [(0, int(x) // len(R), int(x) % len(R)) for x in pick]
        for event, a, b in pairs:
            rows.append({"stratum": made, "event": event, "sender": sim.senders[a], "receiver": sim.receivers[b], "time": at, **{k: float(v[a, b]) for k, v in values.items()}, **shared(at)})

    while made < sim.n_events:
        values, rates = read(t)
        total = rates.sum()
        if not total > 0:
            break
        if sim.method == "gillespie":
            while True:  # a wait that crosses a break is drawn anew from there
                wait = rng.exponential(1 / (total * lift(t)))
                later = breaks[breaks > t]
                if len(later) and sim.global_effects and t + wait > later[0]:
                    t = float(later[0])
                    if t > sim.horizon:
                        break
                    continue
                t += wait
                break
            if t > sim.horizon:
                break
            heaped = np.cumsum(rates)
            at = min(int(np.searchsorted(heaped, rng.random() * heaped[-1], "right")), rates.size - 1)
            fired = [(t, at // len(R), at % len(R))]
            if sim.stats:
                values, rates = read(t)
        else:
            mean = rates * lift(t) * sim.tau
            drawn = (rng.random(mean.shape) < -np.expm1(-mean)).astype(int) if sim.risk == "remove" else rng.poisson(mean)
            cells = np.repeat(np.arange(drawn.size), drawn.ravel())
            need = sim.n_events - made  # what a leap draws beyond the last event isn't followed
            when = np.sort(t + sim.tau * rng.random(len(cells)))[:need]
            fired = [(x, int(c) // len(R), int(c) % len(R)) for x, c in zip(when.tolist(), rng.permutation(cells)[:need].tolist()) if x <= sim.horizon]
            t += sim.tau
            if t > sim.horizon and not fired:
                break
        for at, i, j in fired:
            made += 1
            record(at, i, j, values, rates)
        for at, i, j in fired:
            history.fire(S[i], R[j], at)
            if sim.risk == "remove":
                static[i, j] = -np.inf
    columns = ["stratum", "event", "sender", "receiver", "time", *sim.stats, *sim.global_values]
    return pd.DataFrame(rows, columns=columns)


def simulate_relational_events(spark: SparkSession, sim: Simulation, replicates: int = 1, seed: int = 0, wide: bool = False) -> DataFrame:
    """The rows of replicates of a simulation, one task each and told apart by replicate; wide: one row per event with its first control."""
    kinds = {"stratum": "long", "event": "int", "sender": "string", "receiver": "string"}
    columns = ["stratum", "event", "sender", "receiver", "time", *sim.stats, *sim.global_values]
    schema = "replicate long, " + ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns)
    if wide and sim.n_controls < 1:
        sim = replace(sim, n_controls=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"].tolist():
                yield trajectory(sim, seed * 1_000_003 + k).assign(replicate=k)[["replicate", *columns]]

    out = spark.range(0, replicates, 1, replicates).mapInPandas(run, schema)
    if not wide:
        return out
    from braidlog.operators.reshape import widen_case_control

    rows = out.withColumns({"cell": F.concat_ws("/", "replicate", "stratum"), "rid": 1 - F.col("event")})
    return widen_case_control(rows.drop("stratum", "replicate"), "event", "cell", [*sim.stats, *sim.global_values, "time"], order_col="rid")


def simulate_actor_covariates(spark: SparkSession, actors: Sequence[str], names: Sequence[str], time_points: Sequence[float] | None = None, sd: float = 1.0, rho: float = 0.0, seed: int = 0) -> DataFrame:
    """actor and a column for each name; or, with time points, actor, time, covariate, value of stationary AR(1) series."""
    if not -1 < rho < 1 or sd < 0:
        raise ValueError("rho must be within -1 and 1, sd 0 or more")
    table = spark.createDataFrame([(a,) for a in actors], "actor string")
    points = list(time_points) if time_points is not None else None
    schema = "actor string, " + (", ".join(f"`{n}` double" for n in names) if points is None else "time double, covariate string, value double")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for a in batch["actor"]:
                series = {n: np.random.default_rng(xxhash.xxh64_intdigest(f"{a}/{n}", seed)).standard_normal(len(points or [0])) * sd for n in names}
                if points is None:
                    rows.append({"actor": a, **{n: float(v[0]) for n, v in series.items()}})
                    continue
                for n, e in series.items():
                    x = e[0] / math.sqrt(1 - rho**2)
                    for k, p in enumerate(points):
                        x = rho * x + e[k] if k else x
                        rows.append({"actor": a, "time": float(p), "covariate": n, "value": float(x)})
            yield pd.DataFrame(rows, columns=["actor", *names] if points is None else ["actor", "time", "covariate", "value"])

    return table.mapInPandas(draw, schema)


def _subsets(items: Sequence[str], least: int, most: int) -> list[tuple[str, ...]]:
    return [c for n in range(least, most + 1) for c in combinations(items, n)]


def _hyper_stat(name: str, I: np.ndarray, J: np.ndarray, past: list[int]) -> np.ndarray:  # noqa: E741
    """A statistic of every candidate, from bit rows of their members and the candidates that fired. NaN: undefined."""
    import re

    sizes, others = I.sum(1), J.sum(1)
    if name in ("size", "size_I"):
        return sizes.astype(float)
    if name == "size_J":
        return others.astype(float)
    a, b = (I @ I[past].T, J @ J[past].T) if past else (np.zeros((len(I), 0)), np.zeros((len(I), 0)))
    if name == "activity":
        return ((a == sizes[:, None]) & (b == others[:, None])).sum(1).astype(float)
    found = re.fullmatch(r"subrep_([1-9]\d*)(?:_(\d+))?", name)
    if not found:
        raise ValueError(f"unknown statistic {name}")
    rho, l = int(found[1]), int(found[2] or 0)  # noqa: E741
    choose = lambda n, k: np.prod([(n - i) / (i + 1) for i in range(k)], 0) if k else np.ones_like(n, float)
    all_ = choose(sizes.astype(float), rho) * choose(others.astype(float), l)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((sizes >= rho) & (others >= l), (choose(a, rho) * choose(b, l)).sum(1) / all_, np.nan)


def hyper_trajectory(n_events: int, first: list[tuple], second: list[tuple], effects: Mapping[str, float], stats: Sequence[str], baseline: float, start: float, seed: int) -> pd.DataFrame:
    """rid, I, J, time and statistics; candidates are pairs of the two lists; an undefined statistic makes a rate of 0."""
    rng = np.random.default_rng(seed)
    cells = [(i, j) for i in first for j in second]
    bits = lambda sets: np.array([[m in s for m in members] for s in sets for members in [sorted({x for c in sets for x in c})]], float).reshape(len(sets), -1)
    I, J = bits([c[0] for c in cells]), bits([c[1] for c in cells])  # noqa: E741
    names, t, past, rows = list(dict.fromkeys((*stats, *effects))), start, [], []
    for k in range(n_events):
        values = {s: _hyper_stat(s, I, J, past) for s in names}
        eta = sum((b * values[s] for s, b in effects.items()), np.zeros(len(cells)))
        rates = np.where(np.isfinite(eta), baseline * np.exp(eta), 0.0)
        if not rates.sum() > 0:
            break
        t += rng.exponential(1 / rates.sum())
        pick = int(rng.choice(len(cells), p=rates / rates.sum()))
        rows.append({"rid": k, "I": list(cells[pick][0]), "J": list(cells[pick][1]), "time": t, **{s: float(v[pick]) for s, v in values.items()}})
        past.append(pick)
    return pd.DataFrame(rows, columns=["rid", "I", "J", "time", *names])


def _hyper_frame(spark: SparkSession, rows: pd.DataFrame) -> DataFrame:
    names = list(rows.columns[4:])
    schema = "rid long, I array<string>, J array<string>, time double" + "".join(f", `{n}` double" for n in names)
    return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], schema)


def simulate_hyperedge_events(spark: SparkSession, n_events: int, actors: Sequence[str], max_size: int, baseline_rate: float = 1.0, effects: Mapping[str, float] = {}, stats: Sequence[str] = (), start_time: float = 0.0, min_size: int = 1, seed: int = 0) -> DataFrame:
    """Undirected hyperedges: J is empty. Statistics: size, activity, subrep_<rho>."""
    return _hyper_frame(spark, hyper_trajectory(n_events, _subsets(actors, min_size, max_size), [()], effects, stats, baseline_rate, start_time, seed))


def simulate_directed_hyperedge_events(
    spark: SparkSession, n_events: int, senders: Sequence[str], receivers: Sequence[str], sizes_I: tuple[int, int] = (1, 1), sizes_J: tuple[int, int] = (1, 1),
    baseline_rate: float = 1.0, effects: Mapping[str, float] = {}, stats: Sequence[str] = (), start_time: float = 0.0, seed: int = 0,
) -> DataFrame:
    """Directed hyperedges. Statistics: size_I, size_J, activity, subrep_<rho>_<l>."""
    return _hyper_frame(spark, hyper_trajectory(n_events, _subsets(senders, *sizes_I), _subsets(receivers, *sizes_J), effects, stats, baseline_rate, start_time, seed))


def simulate_directed_hyperevents_tvnl(
    spark: SparkSession, sender_attr: Mapping[str, float], receiver_attr: Mapping[str, float], time_varying: Callable[[float], float], nonlinear: Callable[[float], float],
    horizon: float = 2.0, dt: float = 0.01, n_controls: int = 1, max_group_senders: int = 1, max_group_receivers: int = 1, seed: int = 0, most_pairs: int = 100_000,
) -> DataFrame:
    """event_id, event_time, event, sender_group, receiver_group, cov_sender, cov_receiver of a grid-thinned process.

    The rate of a pair of groups is exp(time_varying(t) * mean of senders + nonlinear(mean of receivers)); in
    each step of dt a pair fires at most once. Controls are other pairs, drawn alike.
    """
    one, two = _subsets(sorted(sender_attr), 1, max_group_senders), _subsets(sorted(receiver_attr), 1, max_group_receivers)
    if len(one) * len(two) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of groups")
    rng = np.random.default_rng(seed)
    x, y = (np.array([np.mean([attr[m] for m in g]) for g in groups]) for attr, groups in ((sender_attr, one), (receiver_attr, two)))
    curve, rows, made = np.array([nonlinear(v) for v in y]), [], 0
    label = lambda g: "{" + ",".join(g) + "}"
    for step in range(int(round(horizon / dt))):
        t = step * dt
        p = -np.expm1(-np.exp(time_varying(t) * x[:, None] + curve[None, :]) * dt)
        for cell in np.flatnonzero(rng.random(p.shape).ravel() < p.ravel()):
            made += 1
            others = rng.choice(p.size - 1, min(n_controls, p.size - 1), replace=False)
            for event, at in [(1, cell), *((0, o + (o >= cell)) for o in others)]:
                i, j = divmod(int(at), len(two))
                rows.append((made, float(t), event, label(one[i]), label(two[j]), float(x[i]), float(y[j])))
    return spark.createDataFrame(rows, "event_id int, event_time double, event int, sender_group string, receiver_group string, cov_sender double, cov_receiver double")
