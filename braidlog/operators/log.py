"""Event logs: cleaning, actor covariates, recency kernel, hyperedge wrapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.quantiles import exact_quantile
from braidlog.plans.features import check_log


def standardize_event_log(
    log: DataFrame, sender_col: str = "sender", receiver_col: str = "receiver", time_col: str = "time", drop_nas: bool = True, drop_loops: bool = False,
    strictly_increasing_time: bool = False, remove_duplicates: bool = False, keep_extra: bool = True, order_col: str | None = None,
) -> DataFrame:
    """sender and receiver as strings, time as double, and the other columns if keep_extra.

    Rows with a null in one of the three go, or are an error; then loops go; of rows with equal triples
    the first in input order stays. order_col gives the input order (else rows are numbered as read).
    strictly_increasing_time: an error if two rows that stay have equal times. Times can't be out of
    order, since a table has no order of its own.
    """
    if missing := [c for c in (sender_col, receiver_col, time_col) if c not in log.columns]:
        raise ValueError(f"event log lacks columns: {', '.join(missing)}")
    extra = [c for c in log.columns if c not in (sender_col, receiver_col, time_col)] if keep_extra else []
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = log.select(F.col(sender_col).cast("string").alias("sender"), F.col(receiver_col).cast("string").alias("receiver"), F.col(time_col).cast("double").alias("time"), *[c for c in extra if c not in ("sender", "receiver", "time")], order.alias("__order"))
    if drop_nas:
        rows = rows.dropna(subset=["sender", "receiver", "time"])
    elif not rows.filter("sender IS NULL OR receiver IS NULL OR time IS NULL").isEmpty():
        raise ValueError("event log has missing senders, receivers or times")
    if drop_loops:
        rows = rows.filter("sender <> receiver")
    if remove_duplicates:
        first = Window.partitionBy("sender", "receiver", "time").orderBy("__order")
        rows = rows.withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first")
    if strictly_increasing_time and not rows.groupBy("time").count().filter("count > 1").isEmpty():
        raise ValueError("times aren't strictly increasing")
    return rows.drop("__order")


def attach_static_covariates(
    log: DataFrame, sender_covariates: DataFrame | None = None, receiver_covariates: DataFrame | None = None, actor_col: str = "actor",
    sender_prefix: str = "sender_", receiver_prefix: str = "receiver_", allow_missing: bool = True, check: bool = True,
) -> DataFrame:
    """log with the covariates of senders and receivers, named with the prefixes; null where an actor has none.

    check: repeated actors, and unless allow_missing actors without covariates, are errors; these
    are looked for by jobs of their own. Spark broadcasts a covariate table that its size allows.
    """
    check_log(log)
    out = log
    for role, table, prefix in (("sender", sender_covariates, sender_prefix), ("receiver", receiver_covariates, receiver_prefix)):
        if table is None:
            continue
        values = [c for c in table.columns if c != actor_col]
        if actor_col not in table.columns or not values:
            raise ValueError(f"covariates need {actor_col} and a column of values")
        if check and not table.groupBy(actor_col).count().filter("count > 1").isEmpty():
            raise ValueError(f"repeated actors among {role} covariates")
        named = table.select(F.col(actor_col).cast("string").alias("__actor"), *[F.col(v).alias(prefix + v) for v in values])
        if check and not allow_missing and not out.join(named, F.col(role).cast("string") == F.col("__actor"), "left_anti").isEmpty():
            raise ValueError(f"{role}s without covariates")
        out = out.join(named, F.col(role).cast("string") == F.col("__actor"), "left").drop("__actor")
    return out


def attach_dyadic_covariates(log: DataFrame, table: DataFrame, fill: float | None = None, check: bool = True) -> DataFrame:
    """log with the values of its (sender, receiver) in table, which has these two columns and values, one row for each pair that has any.

    Pairs that the table doesn't list get fill (or null). check: repeated pairs are an error.
    """
    check_log(log)
    values = [c for c in table.columns if c not in ("sender", "receiver")]
    if not values or not {"sender", "receiver"} <= set(table.columns):
        raise ValueError("a dyadic table needs sender, receiver and a column of values")
    if clash := set(values) & set(log.columns):
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    if check and not table.groupBy("sender", "receiver").count().filter("count > 1").isEmpty():
        raise ValueError("repeated pairs in the dyadic table")
    named = table.select(F.col("sender").cast("string").alias("__s"), F.col("receiver").cast("string").alias("__r"), *values)
    out = log.join(named, (F.col("sender").cast("string") == F.col("__s")) & (F.col("receiver").cast("string") == F.col("__r")), "left").drop("__s", "__r")
    return out if fill is None else out.fillna(fill, values)


#: Kilometres, the mean radius of the earth.
EARTH = 6371.0


def attach_distance(log: DataFrame, places: DataFrame, out: str = "distance", log1p: bool = False, actor_col: str = "actor", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """log with the great-circle distance in kilometres of each row's sender and receiver, by their places in degrees; null where a place is missing.

    It is worked out for the rows that ask, so no matrix of all pairs of actors is made. log1p: of it, as a covariate.
    """
    if out in log.columns:
        raise ValueError(f"a column exists already: {out}")
    table = places.select(F.col(actor_col).alias("actor"), F.radians(lat).alias("lat"), F.radians(lon).alias("lon"))
    rows = attach_static_covariates(log, table, table, sender_prefix="__from_", receiver_prefix="__to_")
    half = lambda c: F.pow(F.sin((F.col(f"__to_{c}") - F.col(f"__from_{c}")) / 2), 2)
    chord = half("lat") + F.cos("__from_lat") * F.cos("__to_lat") * half("lon")
    chord = F.when(chord > 1, 1.0).otherwise(chord)  # least() would take a missing place for the other end of the earth
    found = 2 * EARTH * F.asin(F.sqrt(chord))
    return rows.withColumn(out, F.log1p(found) if log1p else found).select(*log.columns, out)


def recency_scale(values: DataFrame, delta: str, half_life: float | None = None, reference: DataFrame | None = None) -> float:
    """half_life, or twice the exact median of the reference's (else the values') first column."""
    if half_life is not None:
        if half_life <= 0:
            raise ValueError("half_life must be positive")
        return half_life
    median = exact_quantile(values, delta, 0.5) if reference is None else exact_quantile(reference, reference.columns[0], 0.5)
    if median is None or median <= 0:
        raise ValueError("the median must be positive")
    return 2 * float(median)


def transform_recency(log: DataFrame, delta: str, out: str | None = None, half_life: float | None = None, reference: DataFrame | None = None, check: bool = True) -> DataFrame:
    """log with exp(-delta / scale), null where delta is null. The scale isn't a half-life: the value falls to 1 / e over it."""
    if check and not log.filter(F.col(delta) < 0).isEmpty():
        raise ValueError("negative recencies")
    scale = recency_scale(log, delta, half_life, reference)
    return log.withColumn(out or f"{delta}_weight", F.exp(-F.col(delta).cast("double") / F.lit(float(scale))))


def fill_missing(log: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Nulls of these columns as value, as fits want them."""
    return log.fillna(value, subset=columns)


def set_minus_receiver(log: DataFrame, set_col: str = "sender_receivers_set", receiver_col: str = "receiver", out: str = "others") -> DataFrame:
    """log with the reached set without the row's own receiver."""
    return log.withColumn(out, F.array_remove(set_col, F.col(receiver_col)))


def nearest_value(log: DataFrame, values: DataFrame, set_col: str, focal_col: str, actor_col: str = "actor", value_col: str = "value", out: str = "nearest", key: str = "rid") -> DataFrame:
    """log with the least absolute difference of the focal actor's value to those of a row's set; null for an empty set."""
    table = values.select(F.col(actor_col).cast("string").alias("__actor"), F.col(value_col).cast("double").alias("__value"))
    focal = table.select(F.col("__actor").alias("__focal"), F.col("__value").alias("__own"))
    pairs = log.select(F.col(key).alias("__key"), F.col(focal_col).alias("__f"), F.explode(set_col).alias("__member"))
    pairs = pairs.join(table, F.col("__member") == F.col("__actor")).join(focal, F.col("__f") == F.col("__focal"))
    least = pairs.groupBy("__key").agg(F.min(F.abs(F.col("__own") - F.col("__value"))).alias(out))
    return log.join(least, F.col(key) == F.col("__key"), "left").drop("__key")
