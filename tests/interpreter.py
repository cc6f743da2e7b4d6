"""A literal sequential reading of the statistics' definitions, for small logs."""

import math


def interpret(rows, stats, half_life=None, events=None):
    """rows: (sender, receiver, time, rid) sorted by (time, rid). events: None (row order), or booleans (strict)."""
    legs = {"transitivity": ("sk", "kr"), "cyclic": ("rk", "ks"), "sending_balance": ("sk", "rk"), "receiving_balance": ("ks", "kr")}
    rate = math.log(2) / half_life if half_life else 0
    out = []
    for i, (s, r, t, o) in enumerate(rows):
        if events is None:
            seen = rows[:i]
        else:
            seen = [x for x, e in zip(rows, events) if e and x[2] < t]
        of = lambda a, b: [x for x in seen if x[0] == a and x[1] == b]
        own, back = of(s, r), of(r, s)
        got = {}
        for name in stats:
            if name == "sender_outdegree":
                v = float(sum(x[0] == s for x in seen))
            elif name == "receiver_indegree":
                v = float(sum(x[1] == r for x in seen))
            elif name == "recency":
                v = t - max(x[2] for x in own) if own else None
            else:
                family = next(f for f in ("reciprocity", *legs) if name.startswith(f))
                rest = name[len(family) + 1 :]
                gate = next((g for g in ("ordered", "interrupted") if rest.endswith(g)), "")
                measure = rest.removesuffix("_" + gate) if gate else rest or "binary"
                if family == "reciprocity":
                    marks = back
                    if gate:
                        if s == r:
                            marks = back[-1:]
                        elif own:
                            last = max((x[2], x[3]) for x in own)
                            marks = [x for x in back if (x[2], x[3]) > last]
                    times = [x[2] for x in marks]
                else:
                    names = {"s": s, "r": r}
                    times = []
                    for k in {x for e in seen for x in e[:2]} - {s, r}:
                        names["k"] = k
                        a, b = ([x[2] for x in of(names[l[0]], names[l[1]])] for l in legs[family])
                        if not a or not b:
                            continue
                        if gate == "ordered":
                            later = [x for x in b if x > min(a)]
                            if later:
                                times.append(min(later))
                        else:
                            f = max(min(a), min(b))
                            if gate != "interrupted" or not own or f > max(x[2] for x in own):
                                times.append(f)
                v = {
                    "binary": int(bool(times)), "count": float(len(times)), "exp_decay": sum(math.exp(-rate * (t - x)) for x in times),
                    "time_recent": t - max(times) if times else None, "time_first": t - min(times) if times else None,
                }[measure]
            got[name] = v
        out.append(got)
    return out
