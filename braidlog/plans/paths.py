"""Two-paths that close a dyad, formed from their lightest vertex, so that a hub's edges never meet each other.

A two-path of a dyad is a triangle of the dyad s, r and the legs at k. Its edges meet first at the one of
the three vertices that is least in this order: vertices of few edges before those of many, the former by
hash, the latter by their number of edges. So a heavy vertex brings together only edges to heavier ones,
of which there are few, and the third edge is looked up by both its ends. In all that is at most m * sqrt(m)
pairs for m edges, where meeting at a fixed end makes the square of a hub's degree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.storage import written

#: A vertex isn't heavy below so many edges, whatever the square root of their number.
LIGHT = 64


def heavy_vertices(edges: DataFrame) -> DataFrame:
    """vertex, edges of those that have more than the square root of all ends (at most as many vertices as that)."""
    ends = edges.select(F.explode(F.array("__s", "__r")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("edges"))
    total = ends.agg(F.sum("edges")).first()[0] or 0
    return ends.filter(F.col("edges") > max(LIGHT, math.isqrt(total)))


def ordered(edges: DataFrame, heavy: DataFrame) -> DataFrame:
    """edges with the order's key of both ends, __ks and __kr."""
    def key(vertex: str, weight: str) -> Column:
        return F.struct(F.coalesce(F.col(weight), F.lit(0).cast("long")).alias("weight"), F.xxhash64(vertex).alias("hash"), F.col(vertex).alias("vertex"))

    out = edges
    for vertex in ("__s", "__r"):
        out = out.join(F.broadcast(heavy.select(F.col("vertex").alias(f"{vertex}_heavy"), F.col("edges").alias(f"{vertex}_weight"))), F.col(vertex) == F.col(f"{vertex}_heavy"), "left")
    return out.select("__s", "__r", "o", "asked", key("__s", "__s_weight").alias("__ks"), key("__r", "__r_weight").alias("__kr"))


def two_paths(edges: DataFrame, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    """s, r, k, a_o, b_o: for each dyad s, r the actors k, other than both, with which the first leg (one) and the second (two) have fired.

    edges: __s, __r, each pair once; o, when it first fired, null if never; asked, whether it is a dyad.
    one, two: from and to of the legs, of s, r and k.
    """
    edges = written(edges, "dyads")
    edges = ordered(edges, heavy_vertices(edges))
    sides = {
        "d": ("s", "r", edges.filter("asked").select(F.col("__s").alias("s"), F.col("__r").alias("r"), F.col("__ks").alias("ks"), F.col("__kr").alias("kr"))),
        **{n: (*leg, edges.filter("o IS NOT NULL").select(F.col("__s").alias(leg[0]), F.col("__r").alias(leg[1]), F.col("o").alias(f"{n}_o"), F.col("__ks").alias(f"k{leg[0]}"), F.col("__kr").alias(f"k{leg[1]}"))) for n, leg in (("a", one), ("b", two))},
    }
    parts = []
    for pivot in "srk":
        meeting = [n for n, side in sides.items() if pivot in side[:2]]
        (third,) = (n for n in sides if n not in meeting)
        (ends,) = ([x for x in "srk" if x != pivot],)
        near = []
        for n in meeting:
            (other,) = (x for x in sides[n][:2] if x != pivot)
            # The pivot is the least end of both edges; a loop has no two ends.
            near.append(sides[n][2].filter(F.col(f"k{pivot}") < F.col(f"k{other}")).drop(f"k{pivot}", f"k{other}"))
        met = near[0].join(near[1], pivot).filter(F.col(ends[0]) != F.col(ends[1]))
        closed = met.join(sides[third][2].drop(f"k{ends[0]}", f"k{ends[1]}"), ends)
        parts.append(closed.select("s", "r", "k", "a_o", "b_o"))
    # A dyad of an actor with itself has two ends only: both legs are between it and k.
    (a_end,), (b_end,) = (x for x in one if x != "k"), (x for x in two if x != "k")
    loops = edges.filter("asked AND __s = __r").select(F.col("__s").alias("s"))
    a = sides["a"][2].select(F.col(a_end).alias("s"), "k", "a_o").filter("s <> k").join(loops, "s", "left_semi")
    b = sides["b"][2].select(F.col(b_end).alias("s"), "k", "b_o")
    own = a.join(b, ["s", "k"]).select("s", F.col("s").alias("r"), "k", "a_o", "b_o")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(own)
