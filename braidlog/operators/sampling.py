"""Risk-set sampling: each event with non-events drawn from the dyads that could have fired."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.plans.features import check_log
from braidlog.plans.numbered import numbered
from braidlog.storage import written

#: Attempts after which strata with few candidate pairs draw from a list of the pairs that are left.
LISTED_FROM = 24


def _pools(rows: DataFrame, scope: str, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with the sizes of the pools of first and second actors (__a, __b, and __a0 where the first begin); both pools as actor, place.

    Actors are placed in the order in which they come into the pools, so a pool at any time is a run of
    places from the start (or, for senders that debut at a time, from __a0).
    """
    if scope == "citation":
        debut = rows.groupBy("sender").agg(F.min("time").alias("debut"))
        placed = numbered(debut, ["debut", "sender"], rank="place").select(F.col("sender").alias("actor"), "place")
        times = rows.select("time").distinct().join(debut.groupBy(F.col("debut").alias("time")).agg(F.count(F.lit(1)).alias("n")), "time", "left").fillna(0, ["n"])
        times = numbered(times, ["time"], {"earlier": F.col("n")}).select(F.col("time").alias("__at"), "earlier", "n")
        rows = rows.join(times, F.col("time") == F.col("__at")).drop("__at")
        end = F.col("earlier") + F.col("n")
        first = {"__a0": F.lit(0) if mode == "one" else F.col("earlier"), "__a": end, "__b": end if mode == "one" else F.col("earlier")}
        return rows.withColumns(first).drop("earlier", "n"), placed, placed
    roles = {"one": (("sender", "receiver"),), "two": (("sender",), ("receiver",))}[mode]
    tables = []
    for k, columns in enumerate(roles):
        seen = rows.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("actor"), "stratum").groupBy("actor").agg(F.min("stratum").alias("since"))
        placed = numbered(seen, ["since", "actor"], rank="place")
        tables.append(placed.select("actor", "place", (F.lit(0) if scope == "all" else F.col("since")).cast("long").alias("since")))
        size = placed.count()
        if scope == "all":
            rows = rows.withColumn(f"__size{k}", F.lit(size))
        else:
            new = placed.groupBy(F.col("since").alias("__since")).agg(F.count(F.lit(1)).alias("__new"))
            rows = rows.join(new, F.col("stratum") == F.col("__since"), "left").drop("__since").fillna(0, ["__new"])
            rows = numbered(rows, ["stratum"], {f"__size{k}": F.col("__new")}).drop("__rank", "__new")
            # Before the first event (and, of one pool, before two actors) all are candidates.
            least = 2 if mode == "one" else 1
            rows = rows.withColumn(f"__size{k}", F.when(F.col(f"__size{k}") < least, size).otherwise(F.col(f"__size{k}")))
    last = len(roles) - 1
    rows = rows.withColumns({"__a0": F.lit(0), "__a": F.col("__size0"), "__b": F.col(f"__size{last}")})
    return rows.drop("__size0", "__size1"), tables[0], tables[-1]


def sample_non_events(
    log: DataFrame, n_controls: int = 1, scope: str = "all", mode: str = "two", risk: str = "standard", exclude_pairs: DataFrame | None = None,
    allow_loops: bool = False, seed: int = 0, max_attempts: int = 1000, order_col: str = "rid", strict: bool = False,
) -> DataFrame:
    """stratum, event, sender, receiver, time, the other columns, rid: each event (1) and its controls (0).

    A stratum is an event's place in the order of order_col, from 1. Controls are drawn uniformly, with
    replacement, from the pairs that the scope offers at that event, without the event's own pair, loops
    (unless allowed), exclude_pairs, and with risk "remove" those that fired in an earlier row or at the
    same time. Scope "all": all actors; "appearance": those of earlier rows (all for the first);
    "citation": senders that debut at the event's time and its own, with actors that have sent before and
    its own receiver. Mode "one" draws both from one pool. Draws are hashes of seed, stratum, control and
    attempt, so they don't depend on how the log lies. After max_attempts (or LISTED_FROM, if that is less)
    an event with few pairs draws from a list of those that are left. One without any valid pair has
    no controls, or with strict is an error. Other columns of controls are null.
    """
    check_log(log)
    if n_controls < 1 or scope not in ("all", "appearance", "citation") or mode not in ("one", "two") or risk not in ("standard", "remove"):
        raise ValueError("n_controls, scope, mode or risk")
    if clash := {"stratum", "event"} & set(log.columns):
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    extra = [c for c in log.columns if c not in ("sender", "receiver", "time", order_col)]
    order = [order_col] if order_col in log.columns else ["time", "sender", "receiver"]
    base = log.withColumns({"sender": F.col("sender").cast("string"), "receiver": F.col("receiver").cast("string"), "time": F.col("time").cast("double")})
    base = written(numbered(base, order).withColumn("stratum", F.col("__rank") + 1).drop("__rank"), "events")
    rows, firsts, seconds = _pools(base.select("stratum", "sender", "receiver", "time"), scope, mode)
    pending = rows.withColumn("control", F.explode(F.sequence(F.lit(1), F.lit(n_controls))))
    fired = base.groupBy("sender", "receiver").agg(F.min("stratum").alias("__first")).select(F.col("sender").alias("__s"), F.col("receiver").alias("__r"), "__first")
    at_once = base.select(F.col("sender").alias("__s"), F.col("receiver").alias("__r"), F.col("time").alias("__t")).distinct()
    pending = written(pending, "pending")
    gone = None
    if exclude_pairs is not None:
        one, two = exclude_pairs.columns[:2]
        gone = exclude_pairs.select(F.col(one).cast("string").alias("__s"), F.col(two).cast("string").alias("__r")).distinct()

    def valid(tried: DataFrame) -> DataFrame:
        tried = tried.filter(~((F.col("s") == F.col("sender")) & (F.col("r") == F.col("receiver"))))
        same = (F.col("s") == F.col("__s")) & (F.col("r") == F.col("__r"))
        if not allow_loops:
            tried = tried.filter("s <> r")
        if gone is not None:
            tried = tried.join(gone, same, "left_anti")
        if risk == "remove":
            tried = tried.join(fired, same & (F.col("__first") < F.col("stratum")), "left_anti").join(at_once, same & (F.col("time") == F.col("__t")), "left_anti")
        return tried

    begun, found, limit = 0, [], max(1, min(LISTED_FROM, max_attempts))
    while True:
        # Nearly all first draws are valid; what is left is little, and tries several at once.
        attempts = min({0: 1, 1: 7}.get(begun, 2 * begun), limit - begun if begun < limit else 1000)
        tried = pending.withColumn("attempt", F.explode(F.sequence(F.lit(begun + 1), F.lit(begun + attempts))))
        tried = valid(_drawn(tried, firsts, seconds, scope, mode, seed))
        best = tried.groupBy("stratum", "control").agg(F.min(F.struct("attempt", "s", "r")).alias("pick"), F.first("time").alias("time"))
        found.append(written(best.select("stratum", "control", F.col("pick.s").alias("s"), F.col("pick.r").alias("r"), "time"), "drawn"))
        begun += attempts
        pending = written(pending.join(found[-1].select("stratum", "control"), ["stratum", "control"], "left_anti"), "pending")
        if pending.isEmpty():
            break
        if begun == limit:
            # Twice the pairs that can be invalid: those ruled out, the event's own, loops and own actors that have a place.
            out = (fired.count() if risk == "remove" else 0) + (gone.count() if gone is not None else 0) + 1
            na, nb = F.col("__a") - F.col("__a0") + 1, F.col("__b") + 1
            few = na * nb <= 2 * out + 4 * (na + nb)
            listed = pending.filter(few)
            if scope == "citation":
                found.append(_picked(listed, firsts, seconds, mode, seed, valid))
            elif not listed.isEmpty():
                found.append(_placed(listed, base, firsts, seconds, fired if risk == "remove" else None, gone, allow_loops, scope, mode, seed))
            if strict and not listed.join(found[-1].select("stratum", "control"), ["stratum", "control"], "left_anti").isEmpty():
                raise ValueError("an event has no valid non-event")
            pending = written(pending.filter(~few), "pending")
            if pending.isEmpty():
                break
    drawn = found[0]
    for more in found[1:]:
        drawn = drawn.unionByName(more)
    place = lambda c: (F.col("stratum") * (n_controls + 1) + c).cast("long")
    events = base.select("stratum", F.lit(1).alias("event"), "sender", "receiver", "time", *extra, place(F.lit(0)).alias("rid"))
    controls = drawn.select("stratum", F.lit(0).alias("event"), F.col("s").alias("sender"), F.col("r").alias("receiver"), "time", place(F.col("control")).alias("rid"))
    return events.unionByName(controls, allowMissingColumns=True)


def _drawn(tried: DataFrame, firsts: DataFrame, seconds: DataFrame, scope: str, mode: str, seed: int) -> DataFrame:
    """tried with the actors s and r that the hash of seed, stratum, control and attempt names."""
    hashed = F.xxhash64(F.lit(seed), "stratum", "control", "attempt")
    own = 1 if scope == "citation" else 0  # the event's own actors are candidates besides those placed
    sizes = {"__na": F.col("__a") - F.col("__a0") + own, "__nb": F.col("__b") + own}
    tried = tried.withColumns(sizes).filter("__na > 0 AND __nb > 0")
    tried = tried.withColumns({"__pa": F.col("__a0") + F.pmod(hashed, "__na"), "__pb": F.pmod(F.xxhash64(hashed, F.lit(1)), "__nb")})
    return _named(tried, firsts, seconds, mode, own)


def _named(tried: DataFrame, firsts: DataFrame, seconds: DataFrame, mode: str, own: int) -> DataFrame:
    """tried with the actors s and r at the places __pa and __pb; the place after the pool is the event's own actor."""
    one = firsts.select(F.col("actor").alias("__x"), F.col("place").alias("__px"))
    two = seconds.select(F.col("actor").alias("__y"), F.col("place").alias("__py"))
    inside_a, inside_b = F.col("__pa") < F.col("__a"), F.col("__pb") < F.col("__b")
    tried = tried.join(one, (F.col("__pa") == F.col("__px")) & inside_a, "left").join(two, (F.col("__pb") == F.col("__py")) & inside_b, "left")
    if own:
        # An own actor that has a place is drawn by it, not twice.
        places = firsts.select(F.col("actor").alias("__who"), F.col("place").alias("__where"))
        other = F.col("receiver") if mode == "one" else F.col("sender")
        tried = tried.join(places, F.col("__who") == other, "left")
        placed_a = F.col("__where").isNotNull() & (F.col("__where") >= F.col("__a0")) & (F.col("__where") < F.col("__a"))
        tried = tried.filter(inside_a | ~placed_a).drop("__who", "__where").join(places, F.col("__who") == F.col("receiver"), "left")
        placed_b = F.col("__where").isNotNull() & (F.col("__where") < F.col("__b"))
        tried = tried.filter(inside_b | ~placed_b).drop("__who", "__where")
        return tried.withColumns({"s": F.when(inside_a, F.col("__x")).otherwise(other), "r": F.when(inside_b, F.col("__y")).otherwise(F.col("receiver"))})
    return tried.withColumns({"s": F.col("__x"), "r": F.col("__y")})


def _picked(listed: DataFrame, firsts: DataFrame, seconds: DataFrame, mode: str, seed: int, valid) -> DataFrame:
    """stratum, control, s, r, time: of all valid pairs of the scope "citation", listed for each stratum, the one with the least hash."""
    strata = listed.drop("control").distinct().withColumns({"__na": F.col("__a") - F.col("__a0") + 1, "__nb": F.col("__b") + 1})
    pairs = strata.withColumn("__cell", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__na") * F.col("__nb") - 1).cast("long"))))
    pairs = pairs.withColumns({"__pa": F.col("__a0") + F.col("__cell") % F.col("__na"), "__pb": F.floor(F.col("__cell") / F.col("__na"))})
    pairs = valid(_named(pairs, firsts, seconds, mode, 1)).select("stratum", "s", "r")
    pairs = listed.select("stratum", "control", "time").join(pairs, "stratum")
    best = pairs.groupBy("stratum", "control").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "stratum", "control", "s", "r").alias("h"), "s", "r")).alias("pick"), F.first("time").alias("time"))
    return written(best.select("stratum", "control", F.col("pick.s").alias("s"), F.col("pick.r").alias("r"), "time"), "drawn")


def _nodes(early: int, born: int, first: int, cuts: list) -> Iterator[tuple[int, int]]:
    """Levels and numbers of the halved ranges that make up the strata 1 to early and born + 1 to first, without those from cuts (from, to)."""
    for low, high in ((1, min(early, first)), (max(early, born) + 1, first)):
        for a, b in [*sorted(cuts), (high + 1, high + 1)]:
            left, right, level = low, min(a - 1, high) + 1, 0
            while left < right:
                if left & 1:
                    yield level, left
                    left += 1
                if right & 1:
                    right -= 1
                    yield level, right
                left, right, level = left >> 1, right >> 1, level + 1
            low = max(low, b + 1)


def _placed(listed: DataFrame, base: DataFrame, firsts: DataFrame, seconds: DataFrame, fired: DataFrame | None, gone: DataFrame | None, allow_loops: bool, scope: str, mode: str, seed: int) -> DataFrame:
    """stratum, control, s, r, time: the valid pair at the place that the hash of seed, stratum and control names.

    A pair is valid in a few runs of strata: from where its actors are candidates to where it first fires,
    without the strata of its own times (or, if none is removed, its own strata). Each run is a few
    ranges of a tree that halves all strata, and a stratum's valid pairs are those of the ranges above
    it, so neither pairs are listed for each stratum nor strata for each pair.
    """
    top = listed.agg(F.max("__a").alias("a"), F.max("__b").alias("b")).first()
    n = base.count()
    one = firsts.select(F.col("actor").alias("s"), F.col("since").alias("__since"), F.col("place").alias("__x"))
    two = seconds.select(F.col("actor").alias("r"), F.col("since").alias("__also"), F.col("place").alias("__y"))
    # Pairs are numbers, which name both places; that they are few is why their events are listed.
    cells = base.sparkSession.range(top["a"] * top["b"]).select((F.col("id") % top["a"]).alias("__x"), F.expr(f"id div {top['a']}").alias("__y"))
    pairs = cells.join(one, "__x").join(two, "__y").drop("__x", "__y")
    if not allow_loops:
        pairs = pairs.filter("s <> r")
    same = (F.col("s") == F.col("__s")) & (F.col("r") == F.col("__r"))
    if gone is not None:
        pairs = pairs.join(gone, same, "left_anti")
    if fired is None:
        pairs = pairs.withColumn("first", F.lit(n).cast("long"))
        cuts = listed.select(F.col("sender").alias("__s"), F.col("receiver").alias("__r"), F.col("stratum").alias("lo"), F.col("stratum").alias("hi")).distinct()
    else:
        pairs = pairs.join(fired, same, "left").withColumn("first", F.coalesce("__first", F.lit(n)).cast("long")).drop("__s", "__r", "__first")
        before = base.select((F.col("stratum") + 1).alias("__next"), F.col("time").alias("__before"))
        runs = base.select("stratum", "time").join(before, F.col("stratum") == F.col("__next"), "left").withColumn("new", (~F.col("time").eqNullSafe(F.col("__before"))).cast("long"))
        runs = numbered(runs.select("stratum", "time", "new"), ["stratum"], {"run": F.col("new")})
        runs = runs.groupBy((F.col("run") + F.col("new")).alias("run"), F.col("time").alias("__at")).agg(F.min("stratum").alias("lo"), F.max("stratum").alias("hi"))
        own = base.select(F.col("sender").alias("__s"), F.col("receiver").alias("__r"), "time").distinct().join(fired.withColumnsRenamed({"__s": "__x", "__r": "__y"}), (F.col("__s") == F.col("__x")) & (F.col("__r") == F.col("__y")))
        # Later runs don't matter, as the pair is gone by then.
        cuts = own.join(runs, (F.col("time") == F.col("__at")) & (F.col("lo") <= F.col("__first"))).select("__s", "__r", "lo", "hi")
    cuts = cuts.groupBy("__s", "__r").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    # Strata at the start where too few actors have been seen, so that all are candidates.
    early = 0
    if scope == "appearance":
        least = firsts.filter(F.col("place") == (1 if mode == "one" else 0)).select("since").first()
        early = least["since"] if least else n
    pairs = pairs.join(cuts, same, "left").select("s", "r", F.greatest("__since", "__also").alias("born"), "first", "cuts")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(_nodes(early, row["born"], row["first"], [(c["lo"], c["hi"]) for c in row["cuts"] or ()]))
                if found:
                    size = len(found)
                    yield pa.RecordBatch.from_pydict({"s": [row["s"]] * size, "r": [row["r"]] * size, "level": pa.array([x[0] for x in found], pa.int32()), "node": pa.array([x[1] for x in found], pa.int64())})

    held = written(numbered(pairs.mapInArrow(ranges, "s string, r string, level int, node long"), ["level", "node", "s", "r"], rank="place"), "valid")
    nodes = held.groupBy("level", "node").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    above = listed.select("stratum").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(int(n).bit_length()))))
    above = above.withColumn("node", F.expr("shiftright(stratum, level)")).join(nodes, ["level", "node"])
    whole = Window.partitionBy("stratum")
    earlier = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("stratum", "start", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    drawn = listed.select("stratum", "control", "time").join(above, "stratum").withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "stratum", "control", F.lit("listed")), "total"))
    drawn = drawn.filter("at >= before AND at < before + n").withColumn("place", F.col("start") + F.col("at") - F.col("before"))
    return written(drawn.join(held.select("place", "s", "r"), "place").select("stratum", "control", "s", "r", "time"), "drawn")
