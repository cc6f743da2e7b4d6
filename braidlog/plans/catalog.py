"""The closed list of history statistics, by family and variant."""

from __future__ import annotations

from dataclasses import dataclass

#: First and second leg of a two-path over k, as (from, to) of s, k, r, for each triadic family.
LEGS: dict[str, tuple[tuple[str, str], tuple[str, str]]] = {
    "transitivity": (("s", "k"), ("k", "r")),
    "cyclic": (("r", "k"), ("k", "s")),
    "sending_balance": (("s", "k"), ("r", "k")),
    "receiving_balance": (("k", "s"), ("k", "r")),
}
MEASURES = ("binary", "count", "exp_decay", "time_recent", "time_first")
GATES = ("", "ordered", "interrupted")


@dataclass(frozen=True)
class Statistic:
    """measure: of MEASURES, or the statistic's own name where it stands alone. gate: of GATES."""

    name: str
    family: str
    measure: str
    gate: str = ""

    @property
    def decays(self) -> bool:
        return self.measure == "exp_decay"


def _all() -> dict[str, Statistic]:
    single = [Statistic(n, "actor", n) for n in ("sender_outdegree", "receiver_indegree", "recency", "sender_receivers_set")]
    single.append(Statistic("reciprocity", "reciprocity", "binary"))
    for family in ("reciprocity", *LEGS):
        for gate in GATES:
            if family == "reciprocity" and gate == "ordered":
                continue
            single += [Statistic("_".join(filter(None, (family, m, gate))), family, m, gate) for m in MEASURES]
    return {s.name: s for s in single}


STATISTICS = _all()
#: Statistics that a simulated trajectory can be driven by: all but the alias and the list.
SIMULABLE = tuple(n for n in STATISTICS if n not in ("reciprocity", "sender_receivers_set"))
#: Statistics whose sequential engine is compiled elsewhere; here they run in the same plans as all others.
COMPILED = tuple(n for n, s in STATISTICS.items() if n not in ("sender_receivers_set",) and not (s.family == "reciprocity" and (s.gate == "interrupted" or s.measure in ("exp_decay", "time_recent", "time_first"))))


def bound(stats: list[str] | tuple[str, ...], half_life: float | None) -> list[Statistic]:
    """The statistics of these names; unknown or repeated names and a missing half-life are errors."""
    if not stats:
        raise ValueError("no statistics")
    if unknown := [s for s in stats if s not in STATISTICS]:
        raise ValueError(f"unknown statistics: {', '.join(unknown)}")
    if len(set(stats)) < len(stats):
        raise ValueError("a statistic is named twice")
    found = [STATISTICS[s] for s in stats]
    if any(s.decays for s in found) and not (half_life is not None and half_life > 0):
        raise ValueError("half_life must be a positive number for decayed statistics")
    return found


def supported_stats() -> list[str]:
    """Names of the statistics that compiled sequential engines offer."""
    return list(COMPILED)
