"""Sharding by rendezvous hashing of stable record keys over weighted shards. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.llm.common import written


def _score(key: Column, shard: Column | int, weight: float, even: bool) -> Column:
    """A shard's bid for a key. Equal weights: the hash itself; else weight / -ln(u), u the hash in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard if isinstance(shard, Column) else F.lit(shard)), 11)
    return bits if even else F.lit(weight) / -F.log((bits + 0.5) / F.lit(float(1 << 53)))


def rendezvous(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """The shard that bids most for a key, and its bid; of equal bids the smaller shard's counts.

    A bid depends on the key and one shard only, so one more shard takes keys only into itself, and a
    shard that is removed gives up only its own. Weights are positive; keys fall in proportion to them.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    if len(set(weights)) == 1:
        bids = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(_score(key, s, 1.0, True).alias("bid"), (-s).alias("shard")))
    else:
        bids = F.array(*[F.struct(_score(key, s, float(w), False).alias("bid"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)])
    best = F.array_max(bids)
    return -best["shard"], best["bid"]


def assign_shards(docs: DataFrame, key_col: str = "doc_id", weights: Sequence[float] = (1.0,) * 40, keep: dict[str, Column] | None = None, slices: int = 4096) -> DataFrame:
    """key, the columns of keep, shard int, slot long, grown_shard int for each row of docs.

    The key alone decides the shard, so repeated rows share one, and a null key is a key like others
    (it hashes as -1 would). slot numbers a shard's rows without gaps from 0: rows are ordered by
    slice (a hash of the key and keep, so the rows of a repeated key are many slices), then key; each (shard, slice) is ranked by itself and starts where the
    counts of the slices before it end, so no task holds a shard. grown_shard: where the key goes with
    one more shard of the mean weight. The counts table has len(weights) * slices rows.
    keep: further result columns, made of docs'; they break ties of equal keys.
    """
    keep = keep or {}
    taken = {key_col.lower(), "shard", "slot", "grown_shard"}
    if clash := [c for c in keep if c.lower() in taken]:
        raise ValueError(f"names of result columns: {clash}")
    n, even = len(weights), len(set(weights)) == 1
    key = F.coalesce(F.col(key_col), F.lit(-1).cast(docs.schema[key_col].dataType))
    shard, bid = rendezvous(key, weights)
    rows = docs.select(F.col(key_col).alias("__key"), *[c.alias(k) for k, c in keep.items()], shard.cast("int").alias("shard"), bid.alias("__bid"), F.pmod(F.xxhash64(F.lit("slice"), key, *keep.values()), F.lit(slices)).cast("int").alias("__slice"), key.alias("__id"))
    newcomer = _score(F.col("__id"), n, sum(weights) / n, even)
    rows = rows.withColumn("grown_shard", F.when(newcomer > F.col("__bid"), F.lit(n)).otherwise(F.col("shard"))).drop("__bid", "__id")
    rows = written(rows, "shards")  # two passes follow: counts, then ranks
    counts = rows.groupBy("shard", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("__shard"), F.col("__slice").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    if n * slices <= 1 << 20:
        starts = F.broadcast(starts)  # at most n * slices rows of 16 bytes
    within = Window.partitionBy("shard", "__slice").orderBy(F.col("__key").asc_nulls_first(), *keep)
    rows = rows.withColumn("__rank", F.row_number().over(within) - 1)
    rows = rows.join(starts, (F.col("shard") == F.col("__shard")) & (F.col("__slice") == F.col("__of")), "left")
    return rows.select(F.col("__key").alias(key_col), *keep, "shard", (F.col("__start") + F.col("__rank")).alias("slot"), "grown_shard")
