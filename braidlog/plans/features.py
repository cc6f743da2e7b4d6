"""History statistics of an event log's rows: visibility, actor and dyad families, two-path families."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.plans.catalog import LEGS, STATISTICS, Statistic, bound
from braidlog.plans.paths import two_paths
from braidlog.plans.records import mark, measured, prior, query, ranked, summarise
from braidlog.plans.segments import dealt
from braidlog.storage import written

KEY = ("sender", "receiver", "time")


def check_log(log: DataFrame, what: str = "event log") -> None:
    if missing := [c for c in KEY if c not in log.columns]:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")


def _prepared(log: DataFrame, history: DataFrame | None, prior_log: DataFrame | None, order_col: str) -> DataFrame:
    """The log as __s, __r, __t, __rid, __event, __prior, with all its columns in __row."""
    rows = log.select(
        F.col("sender").cast("string").alias("__s"), F.col("receiver").cast("string").alias("__r"), F.col("time").cast("double").alias("__t"),
        (F.col(order_col).cast("long") if order_col in log.columns else F.monotonically_increasing_id()).alias("__rid"),
        F.struct(*log.columns).alias("__row"),
    )
    if history is None:
        rows = rows.withColumn("__event", F.lit(True))
    else:
        check_log(history, "history log")
        known = history.select(*(F.col(c).cast(k).alias(f"__h{c}") for c, k in zip(KEY, ("string", "string", "double")))).distinct().withColumn("__known", F.lit(True))
        rows = rows.join(known, (F.col("__s") == F.col("__hsender")) & (F.col("__r") == F.col("__hreceiver")) & (F.col("__t") == F.col("__htime")), "left")
        rows = rows.withColumn("__event", F.col("__known").isNotNull()).drop("__hsender", "__hreceiver", "__htime", "__known")
    rows = rows.withColumn("__prior", F.lit(False))
    if prior_log is not None:
        check_log(prior_log, "prior log")
        before = prior_log.select(
            F.col("sender").cast("string").alias("__s"), F.col("receiver").cast("string").alias("__r"), F.col("time").cast("double").alias("__t"),
            (F.lit(-(1 << 62)) + F.monotonically_increasing_id()).alias("__rid"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.lit(True).alias("__event"), F.lit(True).alias("__prior"),
        )
        rows = rows.unionByName(before)
    return rows


def _always(rows: DataFrame, untimed: DataFrame) -> DataFrame:
    """Ties without a time as prior rows that come before all others."""
    if missing := [c for c in KEY[:2] if c not in untimed.columns]:
        raise ValueError(f"untimed ties lack columns: {', '.join(missing)}")
    ties = untimed.select(F.col("sender").cast("string").alias("__s"), F.col("receiver").cast("string").alias("__r")).dropna().distinct()
    return ties.withColumns({
        "__t": F.lit(-math.inf), "__rid": F.lit(-(1 << 62)), "__row": F.lit(None).cast(rows.schema["__row"].dataType), "__event": F.lit(True), "__prior": F.lit(True),
    })


def _degrees(rows: DataFrame, strict: bool, wanted: set[str]) -> list[DataFrame]:
    """Events of the actor before each row. An actor of many rows is dealt by ranges of time, which begin with the events before them."""
    out = []
    for name, key in (("sender_outdegree", "__s"), ("receiver_indegree", "__r")):
        if name in wanted:
            parts = dealt(rows, [key], ["__t"] if strict else ["__t", "__rid"])
            seen, own = parts.rows, [key]
            if parts.cut:
                begun = parts.begun({"n": F.count(F.when(F.col("__event"), 1))}, lambda segments: [{"__begun": sum(r["n"] for r in segments[:k])} for k in range(len(segments))])
                seen, own = parts.with_begun(begun), [key, "__seg"]
            seen = ranked(seen.withColumns({"__time": F.col("__t"), "__no": F.col("__rid"), "__kind": F.lit(0)}), strict, *own)
            count = F.count(F.when(F.col("__event"), 1)).over(prior(strict, *own))
            out.append(seen.select("__rid", (count + F.coalesce(F.col("__begun"), F.lit(0)) if parts.cut else count).cast("double").alias(name)))
    return out


def _reached(rows: DataFrame) -> DataFrame:
    """Receivers that the sender reached strictly before, in the order in which it first reached them.

    A row's set is what its segment of the sender's time adds before it; for a sender of several segments
    it follows the set that the segments before have reached, which is held once for each.
    """
    first = rows.filter("__event").groupBy("__s", "__r").agg(F.min(F.struct("__t", "__rid")).alias("o"))
    records = query(rows, __s=F.col("__s"), __to=F.lit(None).cast("string")).unionByName(mark(first, "o.__t", "o.__rid", __s=F.col("__s"), __to=F.col("__r")))
    parts = dealt(records, ["__s"], ["__time"])
    own = ["__s", "__seg"] if parts.cut else ["__s"]
    seen = F.collect_list(F.when(F.col("__kind") == 1, F.struct("__time", "__no", "__to"))).over(prior(True, *own))
    out = ranked(parts.rows, True, *own).withColumn("__seen", F.array_sort(seen)).filter("__kind = 0")
    if parts.cut:
        marks = parts.rows.filter("__kind = 1 OR __seg > 0")
        later = marks.filter("__seg > 0").select(F.col("__s").alias("__of"), F.col("__seg").alias("__at")).distinct()
        base = later.join(marks.filter("__kind = 1"), (F.col("__of") == F.col("__s")) & (F.col("__seg") < F.col("__at")))
        base = base.groupBy("__of", "__at").agg(F.array_sort(F.collect_list(F.struct("__time", "__no", "__to"))).alias("__base"))
        out = out.join(base, (F.col("__s") == F.col("__of")) & (F.col("__seg") == F.col("__at")), "left")
        out = out.withColumn("__seen", F.when(F.col("__base").isNotNull(), F.concat("__base", "__seen")).otherwise(F.col("__seen")))
    return out.select(F.col("__id").alias("__rid"), F.transform("__seen", lambda x: x["__to"]).alias("sender_receivers_set"))


def _dyad(rows: DataFrame, strict: bool, stats: list[Statistic], half_life: float | None) -> DataFrame:
    """Recency and reciprocity. All windows are over the unordered pair or finer, so one shuffle serves them.

    The interrupted window is an island: reverse events that the same number of own events precede in
    write order. A row sees those of the island that its visible own events open. After an event of a
    loop, the island is that event.
    """
    pair = rows.withColumns({
        "__lo": F.least("__s", "__r"), "__hi": F.greatest("__s", "__r"), "__up": F.col("__s") < F.col("__r"),
        "__time": F.col("__t"), "__no": F.col("__rid"), "__kind": F.lit(0),
    })
    loop = F.col("__s") == F.col("__r")
    pair = ranked(pair, strict, "__lo", "__hi")
    seen, write = prior(strict, "__lo", "__hi"), Window.partitionBy("__lo", "__hi").orderBy("__t", "__rid").rowsBetween(Window.unboundedPreceding, -1)
    up, down = F.col("__event") & F.col("__up"), F.col("__event") & ~F.col("__up")
    both = lambda f: F.when(F.col("__up"), f(up)).otherwise(f(down))
    pair = pair.withColumns({
        "__own": both(lambda e: F.count(F.when(e, 1)).over(seen)),
        "__last": both(lambda e: F.max(F.when(e, F.col("__t"))).over(seen)),
        "__against": F.when(F.col("__up"), F.count(F.when(down, 1)).over(write)).otherwise(F.count(F.when(up, 1)).over(write)),
    })
    columns = {"recency": F.col("__t") - F.col("__last")}
    measures = {g: {s.measure for s in stats if s.family == "reciprocity" and s.gate == g} for g in ("", "interrupted")}
    base = pair.select("__rid", "__t", "__lo", "__hi", "__up", "__event", "__own", "__last", "__against", loop.alias("__loop"))
    out = base
    for gate, wanted in measures.items():
        if not wanted:
            continue
        keys = ["__lo", "__hi", "__way", *(["__island"] if gate else [])]
        island = {"__island": F.col("__own")} if gate else {}
        asked = query(base, __lo=F.col("__lo"), __hi=F.col("__hi"), __way=F.when(F.col("__loop"), F.col("__up")).otherwise(~F.col("__up")), **island)
        island = {"__island": F.col("__against")} if gate else {}
        events = mark(base.filter("__event" + (" AND NOT __loop" if gate else "")), "__t", "__rid", __lo=F.col("__lo"), __hi=F.col("__hi"), __way=F.col("__up"), **island)
        found = summarise(ranked(asked.unionByName(events), strict, *keys), keys, strict, half_life, wanted, "__saw_").filter("__kind = 0")
        found = found.select(F.col("__id").alias("__of"), *[measured(m, "__saw_").alias(f"__{m}") for m in wanted])
        out = out.join(found, F.col("__rid") == F.col("__of"), "left").drop("__of")
        for m in wanted:
            value = F.col(f"__{m}")
            if gate:
                after = F.col("__t") - F.col("__last")
                lone = {"binary": F.lit(1), "count": F.lit(1.0), "time_recent": after, "time_first": after}.get(m)
                if lone is None:
                    lone = F.exp(-after * (F.log(F.lit(2.0)) / F.lit(float(half_life))))
                none = {"binary": F.lit(0), "count": F.lit(0.0), "exp_decay": F.lit(0.0)}.get(m, F.lit(None).cast("double"))
                value = F.when(F.col("__loop"), F.when(F.col("__last").isNotNull(), lone).otherwise(none)).otherwise(value)
            columns["_".join(filter(None, ("reciprocity", m, gate)))] = value
        # A column's plan refers to this gate's names, so they are settled before the next gate adds its own.
        settled = {k: c for k, c in columns.items() if k.startswith("reciprocity") and k not in out.columns}
        out = out.withColumns(settled).drop(*[f"__{m}" for m in wanted])
    if "reciprocity_binary" in out.columns:
        out = out.withColumn("reciprocity", F.col("reciprocity_binary"))
    out = out.withColumn("recency", columns["recency"])
    return out.select("__rid", *[s.name for s in stats])


def _triad(rows: DataFrame, strict: bool, family: str, stats: list[Statistic], half_life: float | None) -> DataFrame:
    """Two-paths of one family. They depend on the dyad only, so each is formed once and is a mark on the dyad.

    first: the first event of each edge. A two-path forms when the later of its legs first fires; in
    the ordered variant, when the second leg fires first after the first leg began. The interrupted
    variant sees those formed after the dyad's last visible event: the island is the number of the
    dyad's distinct event times before the formation.
    """
    one, two = LEGS[family]
    events = rows.filter("__event")
    edges = rows.groupBy("__s", "__r").agg(F.min(F.when(F.col("__event"), F.struct("__t", "__rid"))).alias("o"), F.max(~F.col("__prior")).alias("asked"))
    dyads = edges.filter("asked").select(F.col("__s").alias("s"), F.col("__r").alias("r"))
    wedges = two_paths(edges, one, two)
    (b_end,) = (x for x in two if x != "k")
    gates = {g: {s.measure for s in stats if s.gate == g} for g in ("", "ordered", "interrupted")}
    if sum(map(bool, gates.values())) > 1:
        wedges = written(wedges, "paths")  # joined once for all gates
    asked = query(rows.filter("NOT __prior"), s=F.col("__s"), r=F.col("__r"))
    names: list[tuple[str, str]] = []
    parts: list[DataFrame] = []
    formed = mark(wedges.select("s", "r", F.greatest("a_o", "b_o").alias("o")), "o.__t", "o.__rid", s=F.col("s"), r=F.col("r"))
    if gates[""]:
        parts.append(_answers(asked.unionByName(formed), ["s", "r"], strict, half_life, gates[""], family, ""))
    if gates["interrupted"]:
        fired = events.groupBy("__s", "__r", "__t").agg(F.min("__rid").alias("no")).join(dyads, (F.col("__s") == F.col("s")) & (F.col("__r") == F.col("r")), "left_semi")
        fired = mark(fired, "__t", "no", s=F.col("__s"), r=F.col("__r")).withColumn("__kind", F.lit(2))
        records = ranked(asked.unionByName(formed).unionByName(fired), strict, "s", "r")
        times = F.count(F.when(F.col("__kind") == 2, 1))
        # Of a formation: times before its own; of a row: times that it sees.
        earlier = Window.partitionBy("s", "r").orderBy("__time", "__kind").rowsBetween(Window.unboundedPreceding, -1)
        records = records.withColumn("__island", F.when(F.col("__kind") == 0, times.over(prior(strict, "s", "r"))).otherwise(times.over(earlier))).filter("__kind < 2").drop("__g")
        parts.append(_answers(records, ["s", "r", "__island"], strict, half_life, gates["interrupted"], family, "interrupted"))
    if gates["ordered"]:
        # The second leg's first event after the first leg's time: the next one in a window over the leg.
        begun = wedges.select("s", "r", "k", F.col("a_o.__t").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<__t:double,__rid:bigint>").alias("e"))
        later = events.select(F.col("__s").alias(two[0]), F.col("__r").alias(two[1]), F.col("__t").alias("t"), F.lit(0).alias("kind"), F.struct("__t", "__rid").alias("e"))
        later = later.withColumn("s" if b_end == "r" else "r", F.lit(None).cast("string")).select("s", "r", "k", "t", "kind", "e")
        # Events at the same time come before the two-paths that begin then, and so aren't after them.
        # Read backwards, as a frame that ends with the partition is formed anew for each row.
        following = Window.partitionBy("k", b_end).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
        nexts = begun.unionByName(later).withColumn("o", F.min("e").over(following)).filter("kind = 1 AND o IS NOT NULL")
        chained = mark(nexts, "o.__t", "o.__rid", s=F.col("s"), r=F.col("r"))
        parts.append(_answers(asked.unionByName(chained), ["s", "r"], strict, half_life, gates["ordered"], family, "ordered"))
    return reduce(lambda x, y: x.join(y, "__rid"), parts)


def _answers(records: DataFrame, keys: list[str], strict: bool, half_life: float | None, wanted: set[str], family: str, gate: str) -> DataFrame:
    found = summarise(ranked(records, strict, *keys), keys, strict, half_life, wanted, "__saw_").filter("__kind = 0")
    return found.select(F.col("__id").alias("__rid"), *[measured(m, "__saw_").alias("_".join(filter(None, (family, m, gate)))) for m in sorted(wanted)])


def endogenous_features(
    log: DataFrame,
    stats: Sequence[str] = ("sender_outdegree", "receiver_indegree", "reciprocity", "recency"),
    half_life: float | None = None,
    history: DataFrame | None = None,
    prior_log: DataFrame | None = None,
    order_col: str = "rid",
    untimed: DataFrame | None = None,
) -> DataFrame:
    """log with a column for each statistic.

    log: sender, receiver, time and more; order_col holds the input order as whole numbers, unique
    among rows of equal times (where it is missing, rows are numbered as they are read). Without history
    and prior_log, every row is an event and sees the rows before it, ties in input order. With either,
    only rows whose (sender, receiver, time) is in history are events (all, without history), and a row
    sees those of strictly earlier times; prior_log holds events that are seen but not returned. Counts
    and decays are 0 and times are null where nothing is seen; the set is an array, in order of first
    contact, and always strict. half_life is that of exp(-ln 2 * age / half_life).

    untimed: sender, receiver of ties from before the log whose time isn't known; order is strict then. They are in
    the sender's set, first and by name, and two-paths that rest on one count, in binary and count, from when their
    other leg is there. As such a two-path has no time of forming, it is in no time, decay, ordered or
    interrupted statistic until both legs have fired. Other statistics don't see untimed ties.
    """
    check_log(log)
    wanted = bound(tuple(stats), half_life)
    if clash := [s.name for s in wanted if s.name in log.columns]:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    strict = history is not None or prior_log is not None or untimed is not None
    rows = _prepared(log, history, prior_log, order_col)
    known = rows if untimed is None else rows.unionByName(_always(rows, untimed))
    parts = _degrees(rows, strict, {s.name for s in wanted})
    if any(s.name == "sender_receivers_set" for s in wanted):
        parts.append(_reached(known))
    dyadic = [s for s in wanted if s.family == "reciprocity" or s.name == "recency"]
    if any(s.name == "reciprocity" for s in dyadic) and not any(s.name == "reciprocity_binary" for s in dyadic):
        parts.append(_dyad(rows, strict, [*dyadic, STATISTICS["reciprocity_binary"]], half_life).drop("reciprocity_binary"))
    elif dyadic:
        parts.append(_dyad(rows, strict, dyadic, half_life))
    for family in LEGS:
        own = [s for s in wanted if s.family == family]
        counts = [s for s in own if untimed is not None and not s.gate and s.measure in ("binary", "count")]
        for seen, stats in ((known, counts), (rows, [s for s in own if s not in counts])):
            if stats:
                parts.append(_triad(seen, strict, family, stats, half_life))
    out = rows.filter("NOT __prior").select("__rid", "__row")
    for k, part in enumerate(parts):
        part = part.withColumnRenamed("__rid", f"__rid{k}")
        out = out.join(part, F.col("__rid") == F.col(f"__rid{k}"), "left").drop(f"__rid{k}")
    return out.select("__row.*", *[s.name for s in wanted])
