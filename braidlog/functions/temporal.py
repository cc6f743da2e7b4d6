"""As-of lookups: the latest value before a time, and piecewise constant intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.storage import written

#: Sizes of buckets of intervals, each twice the one below.
LEVELS = 40


def as_of(rows: DataFrame, values: DataFrame, time_col: str, value_time: str, value_cols: Sequence[str], by: Sequence[str] = (), first_before: bool = True, compat: bool = False) -> DataFrame:
    """rows with the values of the last row of values whose time isn't later.

    Rows and values are one table in time order, and values are carried forward: no range join. A row
    before all values takes the first one's, or null without first_before. by: columns of both, within
    which to look. compat: the last row of values is never used, as lookups with both ends inside do.
    Repeated times of values: any one of them.
    """
    keys = list(by)
    if compat:
        values = values.join(values.groupBy(*keys).agg(F.max(value_time).alias("__last")), keys, "left") if keys else values.crossJoin(F.broadcast(values.agg(F.max(value_time).alias("__last"))))
        values = values.filter(F.col(value_time) < F.col("__last")).drop("__last")
    packed = F.struct(*[F.col(c).alias(c) for c in value_cols])
    known = values.select(*keys, F.col(value_time).cast("double").alias("__time"), packed.alias("__value"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("__row"))
    asked = rows.select(*keys, F.col(time_col).cast("double").alias("__time"), F.lit(None).cast(known.schema["__value"].dataType).alias("__value"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row"))
    both = known.unionByName(asked)
    return _carried(both, keys, first_before).select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in value_cols])


def _carried(both: DataFrame, keys: list[str], first_before: bool) -> DataFrame:
    """The rows that ask, with __found.

    Keys and times are dealt by ranges, also within a key and within a time, so no task has all rows of either.
    Only the first and last key of a range can go on in others; for these a range begins with the last value of the ranges before it.
    """
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumns({"__key": F.struct(*(keys or [F.lit(0).alias("all")])), "__tie": F.monotonically_increasing_id()})
    rows = written(both.repartitionByRange(parts, *keys, "__time", "__kind", "__tie").withColumn("__part", F.spark_partition_id()).drop("__tie", *keys), "carried")
    borders = rows.groupBy("__part").agg(F.min("__key").alias("__least"), F.max("__key").alias("__most"))  # as many rows as shuffle partitions
    borders = borders.select(F.col("__part").alias("__of"), "__least", "__most")
    shared = rows.join(F.broadcast(borders), F.col("__part") == F.col("__of")).filter((F.col("__key") == F.col("__least")) | (F.col("__key") == F.col("__most")))
    place = F.when(F.col("__kind") == 0, F.struct("__time"))
    ends = shared.groupBy(F.col("__part").alias("__of"), F.col("__key").alias("__which")).agg(F.max_by("__value", place).alias("__end"), F.min_by("__value", place).alias("__begin"))
    key = Window.partitionBy("__which")
    before = F.last("__end", ignorenulls=True).over(key.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("__begin", ignorenulls=True).over(key.orderBy(F.desc("__of")).rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select("__of", "__which", before.alias("__before"), after.alias("__after"))
    within = Window.partitionBy("__part", "__key").orderBy("__time", "__kind")
    found = {"__found": F.last("__value", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))}
    if first_before:
        found["__first"] = F.first("__value", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.withColumns(found).filter("__kind = 1").join(F.broadcast(ends), (F.col("__part") == F.col("__of")) & (F.col("__key") == F.col("__which")), "left")
    # Only rows before all values of their key find nothing so far: the first of their own range or a later one is the first of all.
    return out.withColumn("__found", F.coalesce("__found", "__before", *(["__first", "__after"] if first_before else [])))


def interval_join(rows: DataFrame, spans: DataFrame, time_col: str, from_col: str, to_col: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with every span that holds their time: from <= time < to, without end where to is null. by: columns of both that must be equal.

    A span is dealt to buckets of the least power of two that isn't shorter than it, so to two at most; a row
    looks into one bucket of each size that spans have (at most LEVELS; shorter spans share the least).
    So spans meet rows by equal keys, and mostly such as they hold, instead of all with all. Rows without
    a span aren't returned; a null time or start has none. Repeated rows and spans count each.
    """
    keys = list(by)
    if clash := set(rows.columns) & set(spans.columns) - set(keys):
        raise ValueError(f"columns of both: {', '.join(sorted(clash))}")
    start, end, time = (F.col(c).cast("double") for c in (from_col, to_col, time_col))
    finite = [F.when(F.abs(c) < F.lit(math.inf), c) for c in (start, end)]
    low, high = spans.agg(F.min(F.least(*finite)), F.max(F.greatest(*finite))).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    # Times beyond all ends are as good as the last of them: the exact test follows.
    inside = lambda c: F.greatest(F.least(c, F.lit(high)), F.lit(low)) - F.lit(low)
    least = (math.frexp(high - low)[1] if high > low else 0) - LEVELS + 1
    length = inside(F.coalesce(end, F.lit(high))) - inside(start)
    level = F.greatest(F.coalesce(F.ceil(F.log2(length)).cast("int"), F.lit(least)), F.lit(least))
    bucket = lambda c: F.floor(inside(c) / F.pow(F.lit(2.0), "__level")).cast("long")
    held = spans.filter(start.isNotNull() & (end.isNull() | (start < end))).withColumn("__level", level)
    levels = [r[0] for r in held.select("__level").distinct().collect()]
    held = held.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(F.coalesce(end, F.lit(high))))))
    asked = rows.filter(time.isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    met = asked.withColumn("__bucket", bucket(time)).join(held, [*keys, "__level", "__bucket"])
    return met.filter((time >= start) & (end.isNull() | (time < end))).drop("__level", "__bucket").select(*rows.columns, *[c for c in spans.columns if c not in keys])


def as_of_small(rows: DataFrame, values: DataFrame, time_col: str, value_time: str, value_cols: Sequence[str], compat: bool = False, most: int = 100_000) -> DataFrame:
    """The same for a short table of values: its rows become intervals, which are joined by buckets. A table of more than `most` rows goes through as_of."""
    if values.count() > most:
        return as_of(rows, values, time_col, value_time, value_cols, compat=compat)
    order = Window.orderBy("__from")  # at most `most` rows
    spans = values.select(F.col(value_time).cast("double").alias("__from"), *[F.col(c).alias(f"__v_{c}") for c in value_cols])
    if compat:
        last = spans.agg(F.max("__from")).first()[0]
        spans = spans.filter(F.col("__from") < last)
    spans = spans.withColumns({"__to": F.lead("__from").over(order), "__from": F.when(F.row_number().over(order) == 1, -math.inf).otherwise(F.col("__from"))})
    found = interval_join(rows, spans, time_col, "__from", "__to").select(*rows.columns, *[F.col(f"__v_{c}").alias(c) for c in value_cols])
    none = rows if spans.isEmpty() else rows.filter(F.col(time_col).isNull())
    return found.unionByName(none.select(*rows.columns, *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in value_cols]))


def days_since_first(log: DataFrame, time_col: str = "time", per_day: float = 86_400.0) -> DataFrame:
    """log with times as days since the first row's, from seconds (or per_day units a day)."""
    start = log.agg(F.min(time_col).alias("__start"))
    return log.crossJoin(F.broadcast(start)).withColumn(time_col, (F.col(time_col) - F.col("__start")) / per_day).drop("__start")


def weekday(time: str, period: float = 7.0):
    """Place of a numeric time within a period."""
    return F.pmod(F.col(time), F.lit(period))
