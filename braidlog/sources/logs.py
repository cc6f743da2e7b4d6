"""Readers of event logs, a registry of named datasets, and the logs that the registered queries use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_registry: dict[str, str] = {}


def read_delimited_log(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, columns: dict[str, str] | None = None, order_by: str | None = None) -> DataFrame:
    """A delimited file (gzip too) as strings; columns renames some. With order_by, rid is the rank of that number among the rows."""
    out = spark.read.csv(path, sep=sep, header=header)
    for old, new in (columns or {}).items():
        out = out.withColumnRenamed(old, new)
    if order_by:
        from braidlog.plans.numbered import numbered

        out = numbered(out.withColumn(order_by, F.col(order_by).cast("double")), [order_by, *[c for c in out.columns if c != order_by]], rank="rid")
    return out


def read_edges_log(spark: SparkSession, path: str, names: tuple[str, ...] = ("sender", "receiver", "weight", "time"), comment: str = "%") -> DataFrame:
    """Lines of values between runs of blanks (gzip too); lines that begin with the comment sign, and empty ones, are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.trim("value") != "")).select(parts.alias("p"))
    return rows.select(*[F.try_element_at("p", F.lit(k + 1)).alias(n) for k, n in enumerate(names)])


def register_dataset(name: str, path: str) -> None:
    """Names a Parquet table."""
    _registry[name] = path


def dataset(spark: SparkSession, name: str) -> DataFrame:
    if name not in _registry:
        raise KeyError(f"no dataset {name}; registered: {', '.join(sorted(_registry)) or 'none'}")
    return spark.read.parquet(_registry[name])


def write_log(log: DataFrame, path: str, mode: str = "error") -> None:
    log.write.mode(mode).parquet(path)


def time_as_double(column: str, unit: float = 86_400.0):
    """A timestamp (with or without zone) as units since the epoch; the session's zone should be UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) / (1e6 * unit)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as user -> key, in order of event_id; views are no events where a mask is wanted (is_event)."""
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sender"), F.get_json_object("props", "$.k").alias("receiver"), F.col("event_id").cast("double").alias("time"),
        F.col("event_id").alias("rid"), F.col("value"), (F.col("event_type") != "view").alias("is_event"),
    )


def dense_log(spark: SparkSession, sf_dir: str, actors: int = 30) -> DataFrame:
    """The same among few actors."""
    fold = lambda c: F.pmod(F.col(c).cast("long"), F.lit(actors)).cast("string")
    return sparse_log(spark, sf_dir).withColumns({"sender": fold("sender"), "receiver": fold("receiver")})


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier's nation -> customer's nation at the ship date, in days: many ties."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("s_nationkey").cast("string").alias("sender"), F.col("c_nationkey").cast("string").alias("receiver"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double").alias("time"))


def order_hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order -> its customer; rid is the order's key and time its date in days."""
    line = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("I"))
    orders = _table(spark, sf_dir, "orders")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    return rows.select(F.col("l_orderkey").alias("rid"), "I", F.array(F.col("o_custkey").cast("string")).alias("J"), day.alias("time"))


LOGS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sparse": sparse_log, "dense": dense_log, "trade": trade_log}
