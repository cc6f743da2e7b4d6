"""Global row numbers and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.storage import written


def numbered(df: DataFrame, order: list[str], totals: dict[str, Column] | None = None, rank: str = "__rank") -> DataFrame:
    """df with each row's place from 0 in the order, and the totals of the rows before it.

    Rows are dealt by ranges of the order and written; ranges are ranked by themselves and begin where the
    counts of the ranges before them end. There are as many ranges as shuffle partitions, so their counts
    are a small table. Ties should be settled by the order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = totals or {}
    rows = df.withColumns({f"__add_{k}": c for k, c in totals.items()})
    rows = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    sums = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__add_{k}").alias(f"__sum_{k}") for k in totals])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__from_{k}") for k in totals])
    within = Window.partitionBy("__part").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(starts), F.col("__part") == F.col("__of"))
    out = out.withColumn(rank, F.col("__start") + F.row_number().over(within) - 1)
    out = out.withColumns({k: F.col(f"__from_{k}") + F.coalesce(F.sum(f"__add_{k}").over(earlier), F.lit(0)) for k in totals})
    return out.select(*df.columns, rank, *totals)
