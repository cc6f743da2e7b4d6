"""Exact quantiles of a column of any size: a bracket around a rank, narrowed until little is within it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.storage import discard, written

#: So many values or fewer are sorted by the driver.
LITTLE = 1 << 16
#: Ranks that a sketch names are off by at most one in so many.
ACCURACY = 10_000


def exact_quantile(df: DataFrame, column: str, q: float, little: int = LITTLE) -> float | None:
    """The q-quantile of a numeric column without its nulls, interpolated between the values next to it; None if there are none.

    A sketch of fixed size, merged from all tasks, names two values around the wanted rank. A count then
    tells whether one of them has that rank or, if not, which values it lies between, and only those are
    looked at again. So a sketch is never trusted, ties end the search, and what is left falls by a factor
    of thousands in a round whatever the distribution. No task or driver holds more than a sketch or
    `little` values. NaN is greater than all numbers.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be within 0 and 1")
    values = written(df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL"), "values")
    try:
        n = values.count()
        if n == 0:
            return None
        place = (n - 1) * q
        rank = math.floor(place)
        low = value_at(values, rank, n, little)
        if place == rank:
            return low
        # The next rank has the same value, or else the least that is greater.
        x = F.col("x")
        found = values.agg(F.count(F.when(x <= low, 1)).alias("upto"), F.min(F.when(x > low, x)).alias("above")).first()
        high = low if found["upto"] > rank + 1 else found["above"]
        return low if high == low else low + (high - low) * (place - rank)
    finally:
        discard(values)


def value_at(values: DataFrame, rank: int, n: int, little: int = LITTLE) -> float:
    """The value at a rank from 0 of n values x."""
    x = F.col("x")
    within = values
    while n > little:
        margin = 2 / ACCURACY
        around = [min(1.0, max(0.0, rank / n + d)) for d in (-margin, margin)]
        low, high = within.agg(F.percentile_approx("x", around, ACCURACY)).first()[0]
        cut = within.agg(*[F.count(F.when(c, 1)) for c in (x < low, x <= low, x < high, x <= high)]).first()
        if rank < cut[0]:
            within, n = within.filter(x < low), cut[0]
        elif rank < cut[1]:
            return low
        elif rank < cut[2]:
            within, rank, n = within.filter((x > low) & (x < high)), rank - cut[1], cut[2] - cut[1]
        elif rank < cut[3]:
            return high
        else:
            within, rank, n = within.filter(x > high), rank - cut[3], n - cut[3]
    return sorted((r[0] for r in within.collect()), key=lambda v: (math.isnan(v), v))[rank]
