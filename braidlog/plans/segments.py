"""Running values within a key, where one key may hold a third of all rows: its rows are dealt by ranges of their order.

A key of few rows is one segment, number 0, and costs nothing more than a window over the key. The rows
of a key that holds many are cut into segments at places of its order that a sample proposes. A window
runs within a segment, and each segment begins with what those before it come to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key from which on it is dealt, where that isn't more than the share below of all rows.
MOST = 1 << 20
#: No more keys than this are dealt: a key must hold one in so many of all rows.
SHARE = 1000
#: Sampled rows for each segment.
SAMPLED = 32


@dataclass(frozen=True)
class Segments:
    """rows: with __seg. keys: of the segments. cut: whether any key has several segments."""

    rows: DataFrame
    keys: tuple[str, ...]
    cut: bool
    hot: DataFrame | None = None

    def begun(self, totals: dict[str, Column], before: Callable[[list[dict]], list[dict]]) -> DataFrame:
        """__key, __of and what before makes of the totals of each key's segments, for keys of several; as many rows as segments.

        before gets a key's segments in order, as dicts of the totals, and gives one dict for each.
        """
        own = self.rows.join(F.broadcast(self.hot), _same(self.keys, self.hot)).groupBy(F.col("__hot").alias("__key"), "__seg").agg(*[c.alias(n) for n, c in totals.items()])
        found: dict[tuple, list[dict]] = {}
        for r in sorted((r.asDict() for r in own.collect()), key=lambda r: r["__seg"]):
            found.setdefault(r["__key"], []).append(r)
        out = [{"__key": key, "__of": r["__seg"]} | b for key, rows in found.items() for r, b in zip(rows, before(rows))]
        kinds = {int: "long", float: "double", str: "string"}
        names = {k: next((kinds[type(r[k])] for r in out if r[k] is not None), "long") for r in out for k in r}
        return self.rows.sparkSession.createDataFrame([tuple(r[k] for k in names) for r in out], ", ".join(f"{k} {t}" for k, t in names.items()))

    def with_begun(self, begun: DataFrame) -> DataFrame:
        """rows with begun's columns, null for keys of one segment; begun has a row for each segment of a dealt key, so it is small."""
        names = [c for c in begun.columns if c not in ("__key", "__of")]
        rows = self.rows.join(F.broadcast(self.hot), _same(self.keys, self.hot), "left")
        out = rows.join(F.broadcast(begun), (F.col("__hot") == F.col("__key")) & (F.col("__seg") == F.col("__of")), "left")
        return out.select(*self.rows.columns, *names)


def _same(keys: tuple[str, ...], hot: DataFrame) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(hot[f"__hot_{k}"])
    return out


def dealt(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> Segments:
    """rows with __seg: 0, or the segment of its key's order that a row is in.

    order: columns that settle a row's place; rows that are equal in all of them stay in one segment. The
    rows are counted by key first. Dealt keys are SHARE at most, their segments about SHARE or total / most (MOST if
    none is given) in all, so what is sampled and broadcast has a bound.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    seen = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(most or MOST, (seen[0] or 0) // SHARE)
    if not seen[1] or seen[1] <= limit:
        return Segments(rows.withColumn("__seg", F.lit(0)), tuple(keys), False)
    found = counts.filter(F.col("__n") > limit).collect()
    spark = rows.sparkSession
    kinds = [T.StructField(f"__hot_{k}", rows.schema[k].dataType) for k in keys]
    hot = spark.createDataFrame([(i, r["__n"], *[r[k] for k in keys]) for i, r in enumerate(found)], T.StructType([T.StructField("__hot", T.LongType()), T.StructField("__size", T.LongType()), *kinds]))
    tied = rows.join(F.broadcast(hot), _same(tuple(keys), hot))
    chosen = tied.filter(F.pmod(F.xxhash64(*order), F.ceil(F.lit(limit) / SAMPLED)) == 0).select("__hot", F.struct(*order).alias("at")).distinct().collect()
    cuts = {i: [] for i in range(len(found))}
    for r in chosen:
        cuts[r["__hot"]].append(r["at"])
    at = rows.select(F.struct(*order).alias("at")).schema["at"].dataType
    table = [(i, sorted(x, key=lambda r: tuple((0,) if v is None else (1, v) for v in r))) for i, x in cuts.items()]
    table = [(i, x[SAMPLED - 1 :: SAMPLED]) for i, x in table]
    cut = spark.createDataFrame(table, T.StructType([T.StructField("__hot_of", T.LongType()), T.StructField("__cuts", T.ArrayType(at))]))
    out = rows.join(F.broadcast(hot), _same(tuple(keys), hot), "left").join(F.broadcast(cut), F.col("__hot") == F.col("__hot_of"), "left")
    here = F.struct(*[F.col(c) for c in order])
    out = out.withColumn("__seg", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= here)), F.lit(0)))
    return Segments(out.select(*rows.columns, "__seg"), tuple(keys), True, hot.select("__hot", *[f.name for f in kinds]))
