"""Point-in-time summaries: what queries see of the marks before them, in windows instead of joins.

Queries (log rows) and marks (events, formed two-paths) are one table with a key, a time and a
tie-breaking number. A query sees a mark of its key if the mark comes before it: by (time, number) in
row order, by time alone in strict order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A decayed sum is carried in stretches of time over which it changes by at most this power of e, so no term overflows.
STRETCH = 200.0
#: exp(STRETCH * (1 - REACH)) times any count is below the least double, exp(-745).
REACH = 5


def prior(strict: bool, *keys: str):
    """Window of the rows before a row. In strict order __g must hold the dense rank of times within the keys or some of them."""
    if strict:
        return Window.partitionBy(*keys).orderBy("__g").rangeBetween(Window.unboundedPreceding, -1)
    return Window.partitionBy(*keys).orderBy("__time", "__no", "__kind").rowsBetween(Window.unboundedPreceding, -1)


def ranked(records: DataFrame, strict: bool, *keys: str) -> DataFrame:
    return records.withColumn("__g", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__time"))) if strict else records


def query(log: DataFrame, **columns: Column) -> DataFrame:
    """Query records of log rows, which have __rid and __t."""
    return log.select(*[c.alias(n) for n, c in columns.items()], F.col("__rid").alias("__id"), F.col("__t").alias("__time"), F.col("__rid").alias("__no"), F.lit(0).alias("__kind"))


def mark(rows: DataFrame, time: str | Column, number: str | Column, **columns: Column) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(*[c.alias(n) for n, c in columns.items()], F.lit(None).cast("long").alias("__id"), as_col(time).alias("__time"), as_col(number).alias("__no"), F.lit(1).alias("__kind"))


def summarise(records: DataFrame, keys: Sequence[str], strict: bool, half_life: float | None, measures: set[str], prefix: str) -> DataFrame:
    """records with <prefix>n, hi, lo and, if wanted, decay: count, last and first time, decayed sum of the marks that each sees."""
    marked = F.col("__kind") == 1
    before = prior(strict, *keys)
    out = records.withColumn(f"{prefix}n", F.count(F.when(marked, 1)).over(before))
    if "time_recent" in measures:
        out = out.withColumn(f"{prefix}hi", F.max(F.when(marked, F.col("__time"))).over(before))
    if "time_first" in measures:
        out = out.withColumn(f"{prefix}lo", F.min(F.when(marked, F.col("__time"))).over(before))
    if "exp_decay" in measures:
        out = _decayed(out, keys, strict, math.log(2) / half_life, f"{prefix}decay")
    return out


def _decayed(records: DataFrame, keys: Sequence[str], strict: bool, rate: float, name: str) -> DataFrame:
    """Sum of exp(-rate * (time - mark's time)) over the marks before.

    Within a stretch of time the sum runs over exp(rate * (mark's time - stretch's start)); a stretch's
    total is carried into later ones by their distance. All terms are positive, so nothing cancels. A total
    is at most a count times exp(STRETCH), so after REACH stretches it is 0 in a double: a window of so
    many gives every digit, however many stretches a key has.
    """
    width = STRETCH / rate
    at = F.floor(F.col("__time") / width)
    records = records.withColumn("__at", at).withColumn("__grown", F.when(F.col("__kind") == 1, F.exp((F.col("__time") - F.col("__at") * width) * rate)))
    inner = F.coalesce(F.sum("__grown").over(prior(strict, *keys, "__at")), F.lit(0.0))
    earlier = Window.partitionBy(*keys).orderBy("__at").rangeBetween(-REACH, -1)
    totals = records.groupBy(*keys, "__at").agg(F.coalesce(F.sum("__grown"), F.lit(0.0)).alias("__total"))
    totals = totals.withColumn("__before", F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__total").alias("total"))).over(earlier)).drop("__total")
    names = [f"__k{i}" for i in range(len(keys))]
    totals = totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__at").alias("__of"), "__before")
    matched = F.lit(True)
    for k, n in zip(keys, names):
        matched = matched & F.col(k).eqNullSafe(F.col(n))
    grown = F.when(F.col("__kind") == 0, F.exp((F.col("__at") * width - F.col("__time")) * rate))
    carried = F.aggregate("__before", F.lit(0.0), lambda s, x: s + x["total"] * F.exp((x["at"] - F.col("__at")) * STRETCH))
    out = records.withColumn("__inner", inner).join(totals, matched & (F.col("__at") == F.col("__of")))
    return out.withColumn(name, (F.col("__inner") + carried) * grown).drop("__at", "__grown", "__inner", "__before", "__of", *names)


def measured(measure: str, prefix: str) -> Column:
    """A statistic of a query from its summary: 0 where it saw nothing, and null for times."""
    n = F.col(f"{prefix}n")
    if measure == "binary":
        return F.when(n > 0, 1).otherwise(0)
    if measure == "count":
        return n.cast("double")
    if measure == "exp_decay":
        return F.when(n > 0, F.col(f"{prefix}decay")).otherwise(0.0)
    return F.when(n > 0, F.col("__time") - F.col(f"{prefix}{'hi' if measure == 'time_recent' else 'lo'}"))
