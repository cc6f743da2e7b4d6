"""Registered queries of the event-log operators, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.temporal import as_of, as_of_small, interval_join
from braidlog.operators.hyper import as_dyadic_log, as_hyperedge_log, hyperedge_activity, hyperedge_features, hyperedge_log, hyperedge_sizes, hyperedge_subrep
from braidlog.operators.log import attach_distance, attach_dyadic_covariates, attach_static_covariates, nearest_value, set_minus_receiver, standardize_event_log, transform_recency
from braidlog.operators.reshape import derive_stratum, widen_case_control
from braidlog.operators.sampling import sample_non_events
from braidlog.plans.catalog import GATES, LEGS, MEASURES
from braidlog.plans.features import endogenous_features
from braidlog.sources.logs import dense_log, order_hyperedges, read_delimited_log, read_edges_log, sparse_log, trade_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HALF_LIFE = 500.0
#: The logs of braidlog.sources.logs in SQL.
SPARSE = "SELECT user_id::VARCHAR AS s, json_extract_string(props, '$.k') AS r, event_id::DOUBLE AS t, event_id AS rid, value, event_type <> 'view' AS ev FROM events"
DENSE = f"SELECT ((s::BIGINT) % 30)::VARCHAR AS s, ((r::BIGINT) % 30)::VARCHAR AS r, t, rid, value, ev FROM ({SPARSE})"
TRADE = """SELECT s_nationkey::VARCHAR AS s, c_nationkey::VARCHAR AS r, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"""
HYPER = """SELECT o_orderkey AS rid, I, [o_custkey::VARCHAR] AS J, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS t
  FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS I FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey"""


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def _names(family: str) -> list[str]:
    gates = GATES if family != "reciprocity" else ("", "interrupted")
    return ["_".join(filter(None, (family, m, g))) for g in gates for m in MEASURES]


def _shown(df: DataFrame, stats: list[str]) -> DataFrame:
    return df.select("rid", *[F.round(c, 6).alias(c) if "decay" in c else F.col(c) for c in stats])


def _measures(alias: str, time: str, name: Callable[[str], str], extra: str = "true") -> str:
    """Aggregates over joined marks whose time is `time`; x is the row."""
    live = f"{time} IS NOT NULL AND {extra}"
    return f"""(count({time}) FILTER ({live}) > 0)::INTEGER AS {name('binary')}, count({time}) FILTER ({live})::DOUBLE AS {name('count')},
      round(coalesce(sum(exp(-ln(2) * (x.t - {time}) / {HALF_LIFE})) FILTER ({live}), 0), 6) AS {name('exp_decay')},
      any_value(x.t) - max({time}) FILTER ({live}) AS {name('time_recent')}, any_value(x.t) - min({time}) FILTER ({live}) AS {name('time_first')}"""


def _dyad_sql(log: str) -> str:
    """log: s, r, t, rid, ev and v, by which a row sees events: its number in row order, its time in strict order."""
    full = lambda g: lambda m: "_".join(filter(None, ("reciprocity", m, g)))
    before = "ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
WITH x AS ({log}), e AS (SELECT * FROM x WHERE ev),
own AS (SELECT x.rid, max(e.t) AS last, max(e.rid) AS number FROM x LEFT JOIN e ON e.s = x.s AND e.r = x.r AND e.v < x.v GROUP BY 1),
deg AS (SELECT rid, coalesce(sum(ev::INT) OVER (PARTITION BY s {before}), 0)::DOUBLE AS sender_outdegree,
  coalesce(sum(ev::INT) OVER (PARTITION BY r {before}), 0)::DOUBLE AS receiver_indegree FROM x),
rec AS (
  SELECT x.rid, any_value(x.t) - any_value(own.last) AS recency, {_measures('e', 'e.t', full(''))},
  {_measures('e', 'e.t', full('interrupted'), 'CASE WHEN x.s = x.r THEN e.rid = own.number ELSE own.number IS NULL OR e.rid > own.number END')}
  FROM x JOIN own USING (rid) LEFT JOIN e ON e.s = x.r AND e.r = x.s AND e.v < x.v GROUP BY x.rid)
SELECT rid, sender_outdegree, receiver_indegree, recency, {', '.join(_names('reciprocity'))}, reciprocity_binary AS reciprocity FROM deg JOIN rec USING (rid)
"""


def _triad_sql(log: str, family: str) -> str:
    one, two = LEGS[family]
    side = {"s": "d.s", "r": "d.r"}
    on = lambda a, leg: " AND ".join(f"{a}.{col} = {side[end]}" for col, end in zip(("s", "r"), leg) if end != "k")
    k = lambda a, leg: f"{a}.{'s' if leg[0] == 'k' else 'r'}"
    full = lambda g: lambda m: "_".join(filter(None, (family, m, g)))
    leg2 = " AND ".join(f"e.{col} = {'w.k' if end == 'k' else 'w.' + end}" for col, end in zip(("s", "r"), two))
    part = lambda g, marks, time, extra: f"""(SELECT x.rid, {_measures('m', f'm.{time}', full(g), extra)}
      FROM x JOIN own USING (rid) LEFT JOIN {marks} m ON m.s = x.s AND m.r = x.r AND m.v < x.v GROUP BY x.rid)"""  # noqa: E731
    return f"""
WITH x AS ({log}), e AS (SELECT * FROM x WHERE ev), f AS (SELECT s, r, min(t) AS t, min(v) AS v FROM e GROUP BY s, r),
own AS (SELECT x.rid, max(e.t) AS last FROM x LEFT JOIN e ON e.s = x.s AND e.r = x.r AND e.v < x.v GROUP BY 1),
d AS (SELECT DISTINCT s, r FROM x),
w AS (SELECT d.s, d.r, {k('a', one)} AS k, greatest(a.t, b.t) AS f, greatest(a.v, b.v) AS v, a.t AS t1 FROM d JOIN f a ON {on('a', one)} JOIN f b ON {on('b', two)} AND {k('b', two)} = {k('a', one)}
  WHERE {k('a', one)} NOT IN (d.s, d.r)),
o AS (SELECT w.s, w.r, w.k, min(e.t) AS fo, min(e.v) AS v FROM w JOIN e ON {leg2} AND e.t > w.t1 GROUP BY 1, 2, 3)
SELECT rid, {', '.join(_names(family))}
FROM {part('', 'w', 'f', 'true')} JOIN {part('ordered', 'o', 'fo', 'true')} USING (rid) JOIN {part('interrupted', 'w', 'f', '(own.last IS NULL OR m.f > own.last)')} USING (rid)
"""


_MASK = "is_event"
_DYADIC = ["sender_outdegree", "receiver_indegree", "recency", *_names("reciprocity"), "reciprocity"]


#: Events by sevens at one time, so that row order and strict order differ; a row is an event if an event has its triple.
TIES = 7
TIED = "SELECT s, r, floor(rid / {n}) AS t, rid, value, bool_or(ev) OVER (PARTITION BY s, r, floor(rid / {n})) AS ev FROM ({log})"


def _tied(log: DataFrame) -> DataFrame:
    return log.withColumn("time", F.floor(F.col("rid") / TIES).cast("double"))


def _register_families() -> None:
    every = lambda sql: f"SELECT s, r, t, rid, true AS ev, rid AS v FROM ({sql})"
    events = lambda sql: f"SELECT *, t AS v FROM ({sql})"
    for mode, seen in (("rows", every), ("events", events)):
        for ties in (False, True):

            def run(spark, sf_dir, log, stats, mode=mode, ties=ties):
                rows = log(spark, sf_dir)
                rows = _tied(rows) if ties else rows
                past = rows.filter(_MASK) if mode == "events" else None
                return _shown(endogenous_features(rows, stats, HALF_LIFE, history=past), stats)

            name = lambda family, mode=mode, ties=ties: f"{family}_family_{'ties_' * ties}{mode}"
            log = lambda sql, seen=seen, ties=ties: seen(TIED.format(n=TIES, log=sql) if ties else sql)
            QUERIES[name("reciprocity")] = lambda s, d, run=run: run(s, d, sparse_log, _DYADIC)
            ORACLE_SQL[name("reciprocity")] = _dyad_sql(log(SPARSE))
            for family in LEGS:
                QUERIES[name(family)] = lambda s, d, f=family, run=run: run(s, d, dense_log, _names(f))
                ORACLE_SQL[name(family)] = _triad_sql(log(DENSE), family)


_register_families()


@registered("sender_receivers_set", f"""
WITH x AS ({SPARSE}), f AS (SELECT s, r, min(t) AS t FROM x GROUP BY s, r)
SELECT x.rid, coalesce(string_agg(f.r, ',' ORDER BY f.t), '') AS reached, count(f.r) AS n FROM x LEFT JOIN f ON f.s = x.s AND f.t < x.t GROUP BY x.rid""")
def _reached(spark, sf_dir):
    got = endogenous_features(sparse_log(spark, sf_dir), ["sender_receivers_set"])
    return got.select("rid", F.array_join("sender_receivers_set", ",").alias("reached"), F.size("sender_receivers_set").cast("long").alias("n"))


@registered("prior_log_warm_start", f"""
WITH x AS ({DENSE}), q AS (SELECT * FROM x WHERE ev)
SELECT q.rid, count(e.t)::DOUBLE AS reciprocity_count, any_value(q.t) - max(e.t) AS reciprocity_time_recent
FROM q LEFT JOIN x e ON e.s = q.r AND e.r = q.s AND e.t < q.t GROUP BY q.rid""")
def _warm(spark, sf_dir):
    log = dense_log(spark, sf_dir)
    own, earlier = log.filter("is_event"), log.filter("NOT is_event")
    return endogenous_features(own, ["reciprocity_count", "reciprocity_time_recent"], prior_log=earlier).select("rid", "reciprocity_count", "reciprocity_time_recent")


@registered("prior_log_warm_start_ties", f"""
WITH x AS (SELECT s, r, floor(rid / {TIES}) AS t, rid, ev FROM ({DENSE})), q AS (SELECT * FROM x WHERE ev)
SELECT q.rid, count(e.t)::DOUBLE AS reciprocity_count, any_value(q.t) - max(e.t) AS reciprocity_time_recent
FROM q LEFT JOIN x e ON e.s = q.r AND e.r = q.s AND e.t < q.t GROUP BY q.rid""")
def _warm_tied(spark, sf_dir):
    log = _tied(dense_log(spark, sf_dir))
    return endogenous_features(log.filter("is_event"), ["reciprocity_count", "reciprocity_time_recent"], prior_log=log.filter("NOT is_event")).select("rid", "reciprocity_count", "reciprocity_time_recent")


_PRESENT = """
tr{0} AS (SELECT d.s, d.r, greatest(a.t, b.t) AS f FROM d JOIN {1} a ON a.s = d.s JOIN {1} b ON b.s = a.r AND b.r = d.r WHERE a.r NOT IN (d.s, d.r)),
cy{0} AS (SELECT d.s, d.r, greatest(a.t, b.t) AS f FROM d JOIN {1} a ON a.s = d.r JOIN {1} b ON b.s = a.r AND b.r = d.s WHERE a.r NOT IN (d.s, d.r))"""


@registered("untimed_ties", f"""
WITH x AS (SELECT s, r, t, rid FROM ({DENSE}) WHERE ev), u AS (SELECT s, r FROM ({DENSE}) GROUP BY 1, 2 HAVING count(*) FILTER (NOT ev) > count(*) FILTER (ev)),
f AS (SELECT s, r, min(t) AS t FROM x GROUP BY 1, 2), p AS (SELECT s, r, min(t) AS t FROM (SELECT s, r, -1.0 AS t FROM u UNION ALL SELECT * FROM f) GROUP BY 1, 2),
d AS (SELECT DISTINCT s, r FROM x),{_PRESENT.format('p', 'p')},{_PRESENT.format('f', 'f')},
own AS (SELECT x.rid, max(e.t) AS last FROM x LEFT JOIN x e ON e.s = x.s AND e.r = x.r AND e.t < x.t GROUP BY 1),
trc AS (SELECT x.rid, count(m.f) AS n FROM x LEFT JOIN trp m ON m.s = x.s AND m.r = x.r AND m.f < x.t GROUP BY 1),
cyc AS (SELECT x.rid, count(m.f) AS n FROM x LEFT JOIN cyp m ON m.s = x.s AND m.r = x.r AND m.f < x.t GROUP BY 1),
trt AS (SELECT x.rid, any_value(x.t) - min(m.f) AS first, count(m.f) FILTER (own.last IS NULL OR m.f > own.last) AS n FROM x JOIN own USING (rid) LEFT JOIN trf m ON m.s = x.s AND m.r = x.r AND m.f < x.t GROUP BY 1),
cyt AS (SELECT x.rid, any_value(x.t) - max(m.f) AS recent FROM x LEFT JOIN cyf m ON m.s = x.s AND m.r = x.r AND m.f < x.t GROUP BY 1),
st AS (SELECT x.rid, coalesce(string_agg(p.r, ',' ORDER BY p.t, p.r), '') AS reached FROM x LEFT JOIN p ON p.s = x.s AND p.t < x.t GROUP BY 1)
SELECT rid, trc.n::DOUBLE AS transitivity_count, (trc.n > 0)::INTEGER AS transitivity_binary, trt.first AS transitivity_time_first, trt.n::DOUBLE AS transitivity_count_interrupted,
  cyc.n::DOUBLE AS cyclic_count, cyt.recent AS cyclic_time_recent, reached FROM trc JOIN cyc USING (rid) JOIN trt USING (rid) JOIN cyt USING (rid) JOIN st USING (rid)""")
def _untimed(spark, sf_dir):
    """Pairs that are seen more often than they act are tied from before the log."""
    log = dense_log(spark, sf_dir)
    ties = log.groupBy("sender", "receiver").agg(F.sum(F.when(F.col("is_event"), -1).otherwise(1)).alias("more")).filter("more > 0")
    stats = ["transitivity_count", "transitivity_binary", "transitivity_time_first", "transitivity_count_interrupted", "cyclic_count", "cyclic_time_recent"]
    got = endogenous_features(log.filter("is_event"), [*stats, "sender_receivers_set"], untimed=ties)
    return got.select("rid", *stats, F.array_join("sender_receivers_set", ",").alias("reached"))


@registered("standardize_event_log", f"SELECT s AS sender, r AS receiver, t AS time FROM ({TRADE}) WHERE s <> r GROUP BY ALL")
def _standard(spark, sf_dir):
    return standardize_event_log(trade_log(spark, sf_dir), drop_loops=True, remove_duplicates=True).select("sender", "receiver", "time")


@registered("standardize_incomplete", f"SELECT s AS sender, r AS receiver, t AS time, rid FROM ({SPARSE}) WHERE value >= 2 AND value <= 40 AND s <> r")
def _incomplete(spark, sf_dir):
    """Rows without a receiver or a time go."""
    log = sparse_log(spark, sf_dir)
    log = log.withColumns({"receiver": F.when(F.col("value") >= 2, F.col("receiver")), "time": F.when(F.col("value") <= 40, F.col("time"))})
    return standardize_event_log(log, drop_loops=True).select("sender", "receiver", "time", "rid")


@registered("standardize_keeps_first", f"""
SELECT s AS sender, r AS receiver, day AS time, rid, value FROM (SELECT *, floor(t / 50) AS day, row_number() OVER (PARTITION BY s, r, floor(t / 50) ORDER BY rid) AS n FROM ({DENSE})) WHERE n = 1""")
def _first(spark, sf_dir):
    log = dense_log(spark, sf_dir).withColumn("day", F.floor(F.col("time") / 50).cast("double")).drop("time", "is_event")
    return standardize_event_log(log, time_col="day", remove_duplicates=True, order_col="rid").select("sender", "receiver", "time", "rid", "value")


@registered("attach_static_covariates", f"""
SELECT x.rid, a.c_acctbal AS sender_balance, a.c_nationkey AS sender_nation, b.s_acctbal AS receiver_balance FROM ({SPARSE}) x
LEFT JOIN customer a ON x.s = a.c_custkey::VARCHAR LEFT JOIN supplier b ON x.r = b.s_suppkey::VARCHAR""")
def _attached(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("actor"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    others = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("actor"), F.col("s_acctbal").alias("balance"))
    return attach_static_covariates(sparse_log(spark, sf_dir), people, others).select("rid", "sender_balance", "sender_nation", "receiver_balance")


@registered("attach_dyadic_covariates", f"""
WITH x AS ({DENSE}), p AS (SELECT s, r, min(value) AS least, count(*)::DOUBLE AS often FROM x WHERE ev GROUP BY 1, 2)
SELECT x.rid, coalesce(p.least, -1.0) AS least, coalesce(p.often, -1.0) AS often FROM x LEFT JOIN p USING (s, r)""")
def _dyadic(spark, sf_dir):
    log = dense_log(spark, sf_dir)
    table = log.filter("is_event").groupBy("sender", "receiver").agg(F.min("value").alias("least"), F.count(F.lit(1)).cast("double").alias("often"))
    return attach_dyadic_covariates(log.select("sender", "receiver", "time", "rid"), table, -1.0).select("rid", "least", "often")


_PLACES = "SELECT s_suppkey::VARCHAR AS a, radians(s_acctbal % 90) AS lat, radians(s_acctbal % 180) AS lon FROM supplier"


@registered("attach_distance", f"""
WITH x AS ({SPARSE}), p AS ({_PLACES})
SELECT x.rid, round(2 * 6371.0 * asin(sqrt(pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2))), 5) AS km
FROM x LEFT JOIN p a ON a.a = x.s LEFT JOIN p b ON b.a = x.r""")
def _distance(spark, sf_dir):
    places = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("actor"), (F.col("s_acctbal") % 90).alias("lat"), (F.col("s_acctbal") % 180).alias("lon"))
    return rounded(attach_distance(sparse_log(spark, sf_dir), places, "km").select("rid", "km"), "km", places=5)


def _kept(spark, log: DataFrame, write) -> str:
    """Writes the log as text into the shared folder; its path."""
    from uuid import uuid4

    from braidlog.storage import shared_dir

    path = f"{shared_dir(spark)}/log-{uuid4().hex}"
    write(log.select("sender", "receiver", "time").write, path)
    return path


@registered("read_delimited_log", f"SELECT s AS sender, r AS receiver, t AS day, row_number() OVER (ORDER BY rid) - 1 AS rid FROM ({SPARSE})")
def _read_delimited(spark, sf_dir):
    path = _kept(spark, sparse_log(spark, sf_dir), lambda w, at: w.csv(at, sep="\t", header=True, compression="gzip"))
    return read_delimited_log(spark, path, columns={"time": "day"}, order_by="day").select("sender", "receiver", "day", "rid")


@registered("read_edges_log", f"SELECT s AS sender, r AS receiver, t::BIGINT::VARCHAR AS weight FROM ({SPARSE})")
def _read_edges(spark, sf_dir):
    path = _kept(spark, sparse_log(spark, sf_dir).withColumn("time", F.col("time").cast("long")), lambda w, at: w.csv(at, sep=" ", compression="gzip"))
    return read_edges_log(spark, path).select("sender", "receiver", "weight")


def _streamed(spark, sf_dir, make) -> DataFrame:
    """make's rows over the events as a stream that is read to its end."""
    from uuid import uuid4

    from braidlog.storage import shared_dir
    from braidlog.streaming.features import ready

    ready(spark)
    table = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{sf_dir}/events[.]parquet")
    log = stream.select(F.col("user_id").cast("string").alias("sender"), F.get_json_object("props", "$.k").alias("receiver"), F.col("event_id").cast("double").alias("time"), F.col("event_id").alias("rid"))
    path = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    out = make(log)
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@registered("stream_degree", f"SELECT rid, (row_number() OVER (PARTITION BY s ORDER BY t) - 1)::DOUBLE AS sender_outdegree, false AS late FROM ({SPARSE})")
def _stream_degree(spark, sf_dir):
    from braidlog.streaming.features import stream_degree

    return _streamed(spark, sf_dir, stream_degree)


@registered("stream_dyad_features", f"""
WITH x AS ({SPARSE})
SELECT x.rid, any_value(x.t - (SELECT max(t) FROM x o WHERE o.s = x.s AND o.r = x.r AND o.t < x.t)) AS recency, count(e.t)::DOUBLE AS reciprocity_count, any_value(x.t) - max(e.t) AS reciprocity_time_recent,
  any_value(x.t) - min(e.t) AS reciprocity_time_first, false AS late FROM x LEFT JOIN x e ON e.s = x.r AND e.r = x.s AND e.t < x.t GROUP BY x.rid""")
def _stream_dyads(spark, sf_dir):
    from braidlog.streaming.features import stream_dyad_features

    return _streamed(spark, sf_dir, lambda log: stream_dyad_features(log, HALF_LIFE)).select("rid", "recency", "reciprocity_count", "reciprocity_time_recent", "reciprocity_time_first", "late")


@registered("stream_two_paths", _triad_sql(f"SELECT s, r, t, rid, true AS ev, t AS v FROM ({DENSE})", "transitivity"))
def _stream_two_paths(spark, sf_dir):
    """The log arrives in four pieces; a query goes on from its checkpoint with each, and so stops and starts again."""
    from uuid import uuid4

    from braidlog.storage import application_dir
    from braidlog.streaming.features import TriadSink

    log = dense_log(spark, sf_dir).select("sender", "receiver", "time", "rid")
    path, stats = f"{application_dir(spark)}/paths-{uuid4().hex}", _names("transitivity")
    sink = TriadSink(f"{path}/kept", stats, HALF_LIFE)
    top = log.agg(F.max("rid")).first()[0] or 0
    piece = F.floor(F.col("rid") * 4 / (top + 1))
    for k in range(4):
        log.filter(piece == k).write.parquet(f"{path}/in/piece{k}")
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.parquet(f"{path}/kept/features"), stats)


@registered("transform_recency", f"""
WITH x AS ({SPARSE}), d AS (SELECT rid, t - lag(t) OVER (PARTITION BY s, r ORDER BY t) AS recency FROM x)
SELECT rid, recency, round(exp(-recency / (SELECT 2 * median(recency) FROM d)), 6) AS weight FROM d""")
def _kernel(spark, sf_dir):
    log = endogenous_features(sparse_log(spark, sf_dir), ["recency"]).select("rid", "recency")
    return rounded(transform_recency(log, "recency", "weight"), "weight")


@registered("set_minus_receiver", f"""
WITH x AS ({SPARSE}), f AS (SELECT s, r, min(t) AS t FROM x GROUP BY s, r)
SELECT x.rid, count(f.r) FILTER (f.r <> x.r) AS n FROM x LEFT JOIN f ON f.s = x.s AND f.t < x.t GROUP BY x.rid""")
def _minus(spark, sf_dir):
    log = endogenous_features(sparse_log(spark, sf_dir), ["sender_receivers_set"])
    return set_minus_receiver(log).select("rid", F.size("others").cast("long").alias("n"))


@registered("nearest_value", f"""
WITH x AS ({SPARSE}), f AS (SELECT s, r, min(t) AS t FROM x GROUP BY s, r), v AS (SELECT s_suppkey::VARCHAR AS a, s_acctbal AS v FROM supplier)
SELECT x.rid, round(min(abs(own.v - v.v)), 6) AS nearest FROM x LEFT JOIN f ON f.s = x.s AND f.t < x.t LEFT JOIN v ON v.a = f.r LEFT JOIN v own ON own.a = x.r GROUP BY x.rid""")
def _nearest(spark, sf_dir):
    log = endogenous_features(sparse_log(spark, sf_dir), ["sender_receivers_set"])
    values = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("actor"), F.col("s_acctbal").alias("value"))
    return rounded(nearest_value(log, values, "sender_receivers_set", "receiver").select("rid", "nearest"), "nearest")


def _cases(spark, sf_dir):
    log = sparse_log(spark, sf_dir).select("sender", "receiver", "time", "rid", "value")
    return log.withColumns({"stratum": F.floor(F.col("rid") / 4), "event": (F.col("rid") % 4 == 0).cast("int")})


@registered("widen_case_control", f"""
WITH x AS (SELECT *, floor(rid / 4)::BIGINT AS g, rid % 4 AS k FROM ({SPARSE}))
SELECT a.g::VARCHAR AS stratum, a.s AS sender_ev, a.r AS receiver_ev, b.s AS sender_nv, b.r AS receiver_nv, a.value AS value_ev, b.value AS value_nv, a.value - b.value AS d_value,
  a.t AS time_ev, b.t AS time_nv, a.t - b.t AS d_time FROM x a JOIN x b ON a.g = b.g AND a.k = 0 AND b.k = 2""")
def _wide(spark, sf_dir):
    return widen_case_control(_cases(spark, sf_dir), stratum="stratum", control_index=2)


@registered("derive_stratum", f"SELECT rid, floor(rid / 1000)::BIGINT AS block, concat_ws('/', floor(rid / 1000)::BIGINT::VARCHAR, (floor((rid % 1000) / 4) + 1)::BIGINT::VARCHAR) AS derived FROM ({SPARSE})")
def _strata(spark, sf_dir):
    rows = _cases(spark, sf_dir).withColumn("block", F.floor(F.col("rid") / 1000))
    return derive_stratum(rows, case="event", within=("block",)).select("rid", "block", F.col("__stratum").alias("derived"))


@registered("case_control_gradient", f"""
WITH x AS (SELECT *, floor(rid / 4)::BIGINT AS g, rid % 4 AS k FROM ({SPARSE})), w AS (SELECT a.value - b.value AS d FROM x a JOIN x b ON a.g = b.g AND a.k = 0 AND b.k = 1)
SELECT count(*) AS n, round(sum(-d / (1 + exp(0.01 * d))), 6) AS gradient, round(sum(d * d * exp(0.01 * d) / power(1 + exp(0.01 * d), 2)), 6) AS curvature, round(sum(ln(1 + exp(-0.01 * d))), 6) AS loss FROM w""")
def _gradient(spark, sf_dir):
    from braidlog.models.likelihood import difference_step

    wide = widen_case_control(_cases(spark, sf_dir), stratum="stratum", covariates=["value"])
    step = difference_step(wide, ["d_value"], [0.01]).select("n", F.col("gradient")[0].alias("gradient"), F.col("curvature")[0].alias("curvature"), "loss")
    return rounded(step, "gradient", "curvature", "loss")


@registered("hyperedge_sizes", f"SELECT rid, len(I)::INTEGER AS size_I, len(J)::INTEGER AS size_J FROM ({HYPER})")
def _sizes(spark, sf_dir):
    return hyperedge_sizes(hyperedge_log(order_hyperedges(spark, sf_dir), order_col="rid", check=False)).select("rid", "size_I", "size_J")


@registered("hyperedge_features", f"""
WITH h AS ({HYPER}), m AS (SELECT rid, t, unnest(I) AS who FROM h),
q AS (SELECT a.rid, b.rid AS past, count(*) AS x FROM m a JOIN m b ON a.who = b.who AND b.t < a.t GROUP BY 1, 2),
p AS (SELECT q.rid, x, (a.J = b.J)::INT AS y, len(a.I) AS ni FROM q JOIN h a ON a.rid = q.rid JOIN h b ON b.rid = q.past)
SELECT h.rid, round(coalesce(sum((x = ni AND y = 1)::INT), 0)::DOUBLE, 6) AS activity, round(coalesce(sum(x), 0) / len(any_value(h.I)), 6) AS subrep_1,
  round(CASE WHEN len(any_value(h.I)) >= 2 THEN coalesce(sum(x * (x - 1) / 2.0), 0) / (len(any_value(h.I)) * (len(any_value(h.I)) - 1) / 2.0) END, 6) AS subrep_2,
  round(coalesce(sum(x * y), 0) / len(any_value(h.I)), 6) AS subrep_1_1 FROM h LEFT JOIN p USING (rid) GROUP BY h.rid""")
def _hyper(spark, sf_dir):
    stats = ["activity", "subrep_1", "subrep_2", "subrep_1_1"]
    log = hyperedge_log(order_hyperedges(spark, sf_dir), order_col="rid", check=False)
    return rounded(hyperedge_features(log, stats).select("rid", *stats), *stats)


@registered("hyperedge_activity", f"SELECT count(*) AS activity FROM ({HYPER}) WHERE t < 10000 AND list_has_all(I, ['1', '2'])")
def _activity(spark, sf_dir):
    return hyperedge_activity(hyperedge_log(order_hyperedges(spark, sf_dir), order_col="rid", check=False), ["1", "2"], (), 10000.0)


@registered("hyperedge_subrep", f"SELECT round(sum(n * (n - 1) / 2.0) / 3.0, 6) AS subrep FROM (SELECT len(list_intersect(I, ['1', '2', '3'])) AS n FROM ({HYPER}) WHERE t < 10000)")
def _subrep(spark, sf_dir):
    return rounded(hyperedge_subrep(hyperedge_log(order_hyperedges(spark, sf_dir), order_col="rid", check=False), ["1", "2", "3"], (), 10000.0, 2, 0), "subrep")


@registered("dyadic_hyperedge_roundtrip", f"SELECT rid, s AS sender, r AS receiver, t AS time FROM ({SPARSE})")
def _roundtrip(spark, sf_dir):
    return as_dyadic_log(as_hyperedge_log(sparse_log(spark, sf_dir)), check=False).select("rid", "sender", "receiver", "time")


#: Prices of orders by stretches of ten days.
_DAYS = "SELECT floor(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) / 10) * 10.0 AS day, sum(o_totalprice) AS price FROM orders GROUP BY 1"


def _daily(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = (F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) / 10) * 10).cast("double")
    return orders.groupBy(day.alias("day")).agg(F.sum("o_totalprice").alias("price"))


@registered("as_of_lookup", f"""
WITH v AS ({_DAYS}), x AS (SELECT DISTINCT t FROM ({TRADE})), m AS (SELECT t, max(v.day) AS day FROM x LEFT JOIN v ON v.day <= x.t GROUP BY t)
SELECT m.t AS time, round(coalesce(v.price, (SELECT arg_min(price, day) FROM v)), 4) AS price FROM m LEFT JOIN v ON v.day = m.day""")
def _lookup(spark, sf_dir):
    times = trade_log(spark, sf_dir).select("time").distinct()
    return rounded(as_of(times, _daily(spark, sf_dir), "time", "day", ["price"]), "price", places=4)


@registered("global_covariate_locf", f"""
WITH v AS ({_DAYS}), x AS (SELECT DISTINCT t FROM ({TRADE})), w AS (SELECT * FROM v WHERE day < (SELECT max(day) FROM v)), m AS (SELECT t, max(w.day) AS day FROM x LEFT JOIN w ON w.day <= x.t GROUP BY t)
SELECT m.t AS time, round(coalesce(w.price, (SELECT arg_min(price, day) FROM w)), 4) AS price FROM m LEFT JOIN w ON w.day = m.day""")
def _locf(spark, sf_dir):
    times = trade_log(spark, sf_dir).select("time").distinct()
    return rounded(as_of_small(times, _daily(spark, sf_dir), "time", "day", ["price"], compat=True), "price", places=4)


_ORDERED = "SELECT o_custkey AS customer, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS day, max(o_totalprice) AS price FROM orders GROUP BY 1, 2"
_SHIPPED = "SELECT DISTINCT o_custkey AS customer, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


@registered("as_of_by_key", f"""
WITH v AS ({_ORDERED}), x AS ({_SHIPPED}), m AS (SELECT x.customer, x.time, max(v.day) AS day FROM x LEFT JOIN v ON v.customer = x.customer AND v.day <= x.time GROUP BY 1, 2),
f AS (SELECT customer, arg_min(price, day) AS price FROM v GROUP BY 1)
SELECT m.customer, m.time, round(coalesce(v.price, f.price), 4) AS price FROM m LEFT JOIN v USING (customer, day) LEFT JOIN f ON f.customer = m.customer""")
def _keyed_lookup(spark, sf_dir):
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    values = orders.groupBy(F.col("o_custkey").alias("customer"), _day("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("price"))
    asked = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("customer"), _day("l_shipdate").alias("time")).distinct()
    return rounded(as_of(asked, values, "time", "day", ["price"], by=["customer"]), "price", places=4)


_TRANSIT = "SELECT l_suppkey AS supplier, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS since, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE + l_quantity::DOUBLE AS until, l_quantity AS quantity FROM lineitem"


@registered("interval_join", f"""
WITH v AS ({_TRANSIT}), x AS (SELECT DISTINCT supplier, since AS time FROM v)
SELECT x.supplier, x.time, count(*) AS n, round(sum(v.quantity)::DOUBLE, 4) AS quantity FROM x JOIN v ON v.supplier = x.supplier AND v.since <= x.time AND x.time < v.until GROUP BY 1, 2""")
def _in_transit(spark, sf_dir):
    """What of a supplier's is under way on each day on which it ships, if an item takes as many days as its quantity."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spans = items.select(F.col("l_suppkey").alias("supplier"), _day("l_shipdate").alias("since"), (_day("l_shipdate") + F.col("l_quantity").cast("double")).alias("until"), F.col("l_quantity").cast("double").alias("quantity"))
    asked = spans.select("supplier", F.col("since").alias("time")).distinct()
    met = interval_join(asked, spans, "time", "since", "until", by=["supplier"])
    return rounded(met.groupBy("supplier", "time").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")), "quantity", places=4)


@registered("exact_quantiles", f"""
WITH g AS (SELECT t - lag(t) OVER (PARTITION BY s, r ORDER BY t) AS gap FROM ({DENSE}))
{' UNION ALL '.join(f'SELECT {q}::DOUBLE AS q, round(quantile_cont(gap, {q}), 6) AS gap FROM g' for q in (0.0, 0.1, 0.5, 0.99, 1.0))}""")
def _quantiles(spark, sf_dir):
    """Of the recencies of a log."""
    from braidlog.functions.quantiles import exact_quantile
    from braidlog.storage import written

    gaps = written(endogenous_features(dense_log(spark, sf_dir), ["recency"]).select("recency"), "gaps")
    found = [(q, round(exact_quantile(gaps, "recency", q), 6)) for q in (0.0, 0.1, 0.5, 0.99, 1.0)]
    return spark.createDataFrame(found, "q double, gap double")


def _sampled(scope: str, mode: str, risk: str) -> Query:
    """For each event's stratum its controls, and how many of them break a rule, found from the log apart from the sampler.

    A control breaks a rule if it is a loop, the event's own dyad, if an actor isn't in scope at the event's time, or
    (risk "remove") if its dyad fired before or at it. A stratum without any valid pair has no controls.
    """

    def run(spark, sf_dir):
        log = dense_log(spark, sf_dir).select("sender", "receiver", "time", "rid")
        cc = sample_non_events(log, 2, scope, mode, risk, seed=5)
        case = cc.filter("event = 1").select("stratum", F.col("sender").alias("s"), F.col("receiver").alias("r"), F.col("time").alias("t"))
        sent = log.groupBy(F.col("sender").alias("actor")).agg(F.min("time").alias("since"))
        seen = log.select(F.explode(F.array("sender", "receiver")).alias("actor"), "time").groupBy("actor").agg(F.min("time").alias("since"))
        all_until = seen.orderBy("since").limit(2).agg(F.max("since")).first()[0]  # as long as fewer than two actors have appeared, all are in scope
        dyads = log.groupBy(F.col("sender").alias("ds"), F.col("receiver").alias("dr")).agg(F.min("time").alias("fired"))
        out = cc.filter("event = 0").select("stratum", "sender", "receiver").join(case, "stratum").join(dyads, (F.col("sender") == F.col("ds")) & (F.col("receiver") == F.col("dr")), "left")
        for who, tag in (("sender", "one"), ("receiver", "two")):
            table = (sent if scope == "citation" else seen).select(F.col("actor").alias("of"), F.col("since").alias(tag))
            out = out.join(table, F.col(who) == F.col("of"), "left").drop("of")
        t, own_s, own_r = F.col("t"), F.col("sender") == F.col("s"), F.col("receiver") == F.col("r")
        scoped = {
            ("all", "one"): F.col("one").isNotNull() & F.col("two").isNotNull(), ("all", "two"): F.col("one").isNotNull() & F.col("two").isNotNull(),
            ("appearance", "one"): (t <= all_until) | ((F.col("one") < t) & (F.col("two") < t)),
            ("citation", "two"): (own_s | (F.col("one") == t)) & (own_r | (F.col("two") < t)), ("citation", "one"): (own_s | (F.col("sender") == F.col("r")) | (F.col("one") <= t)) & (own_r | (F.col("two") <= t)),
        }[scope, mode]
        broken = (F.col("sender") == F.col("receiver")) | (own_s & own_r) | ~F.coalesce(scoped, F.lit(False))
        if risk == "remove":
            broken = broken | F.coalesce(F.col("fired") <= t, F.lit(False))
        found = out.groupBy("stratum").agg(F.count(F.lit(1)).alias("controls"), F.count(F.when(broken, 1)).alias("broken"))
        every = case.select("stratum", F.col("s").alias("sender"), F.col("r").alias("receiver")).join(found, "stratum", "left")
        return every.select("stratum", "sender", "receiver", F.coalesce("controls", F.lit(0)).cast("long").alias("controls"), F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))

    return run


#: The pairs that each event may be given, counted from the log.
_ALWAYS = f"SELECT *, 1 AS pairs FROM ({DENSE})"
_SENT = f"WITH x AS ({DENSE}), d AS (SELECT s AS a, min(t) AS since FROM x GROUP BY 1)"
_PAIRS = {
    ("all", "two", "standard"): _ALWAYS, ("all", "one", "standard"): _ALWAYS, ("appearance", "one", "standard"): _ALWAYS,
    ("citation", "two", "standard"): f"{_SENT} SELECT x.*, (SELECT count(*) FROM d WHERE since < x.t AND a <> x.s AND a <> x.r) AS pairs FROM x",
    ("citation", "one", "standard"): f"""{_SENT}, k AS (SELECT x.*, (SELECT count(*) FROM d WHERE since <= x.t) AS k, (SELECT count(*) FROM d WHERE since <= x.t AND a = x.r) AS r_sent FROM x)
      SELECT *, (k + 1 - r_sent) * (k - r_sent) - (s <> r)::INT AS pairs FROM k""",
    ("all", "one", "remove"): f"""WITH x AS ({DENSE}), f AS (SELECT s, r, min(t) AS t FROM x WHERE s <> r GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM (SELECT s FROM x UNION SELECT r FROM x))
      SELECT x.*, n * (n - 1) - (SELECT count(*) FROM f WHERE f.t <= x.t) AS pairs FROM x, n""",
}
for _scope, _mode, _risk in _PAIRS:
    registered(
        f"sample_{_scope}_{_mode}" + (f"_{_risk}" if (_scope, _risk) != ("all", "standard") else ""),
        f"SELECT row_number() OVER (ORDER BY rid) AS stratum, s AS sender, r AS receiver, CASE WHEN pairs > 0 THEN 2 ELSE 0 END::BIGINT AS controls, 0::BIGINT AS broken FROM ({_PAIRS[_scope, _mode, _risk]})",
    )(_sampled(_scope, _mode, _risk))


_EXCLUDED = f"SELECT s, r FROM ({DENSE}) GROUP BY 1, 2 HAVING count(*) FILTER (ev) > 3 * count(*) FILTER (NOT ev)"


@registered("sample_excluding_pairs", f"""
WITH x AS ({DENSE}), e AS ({_EXCLUDED}), n AS (SELECT count(*) AS n FROM (SELECT s FROM x UNION SELECT r FROM x)), o AS (SELECT count(*) AS o FROM e WHERE s <> r),
p AS (SELECT x.*, n * (n - 1) - o - (x.s <> x.r AND e.s IS NULL)::INT AS pairs FROM x CROSS JOIN n CROSS JOIN o LEFT JOIN e ON e.s = x.s AND e.r = x.r)
SELECT row_number() OVER (ORDER BY rid) AS stratum, s AS sender, r AS receiver, CASE WHEN pairs > 0 THEN 3 ELSE 0 END::BIGINT AS controls, 0::BIGINT AS broken FROM p""")
def _excluded(spark, sf_dir):
    """Pairs that nearly always act are never controls."""
    log = dense_log(spark, sf_dir)
    active = log.groupBy("sender", "receiver").agg(F.sum(F.when(F.col("is_event"), 1).otherwise(-3)).alias("more")).filter("more > 0").select("sender", "receiver")
    cc = sample_non_events(log.select("sender", "receiver", "time", "rid"), 3, "all", "one", exclude_pairs=active, seed=6)
    case = cc.filter("event = 1").select("stratum", "sender", "receiver")
    ruled = active.select(F.col("sender").alias("es"), F.col("receiver").alias("er"))
    out = cc.filter("event = 0").select("stratum", F.col("sender").alias("s"), F.col("receiver").alias("r")).join(case, "stratum").join(ruled, (F.col("s") == F.col("es")) & (F.col("r") == F.col("er")), "left")
    broken = F.col("es").isNotNull() | (F.col("s") == F.col("r")) | ((F.col("s") == F.col("sender")) & (F.col("r") == F.col("receiver")))
    found = out.groupBy("stratum").agg(F.count(F.lit(1)).alias("controls"), F.count(F.when(broken, 1)).alias("broken"))
    return case.join(found, "stratum", "left").select("stratum", "sender", "receiver", F.coalesce("controls", F.lit(0)).cast("long").alias("controls"), F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


@registered("clogit_step", f"""
WITH x AS (SELECT floor(rid / 4)::BIGINT AS g, rid % 4 = 0 AS y, value AS v, exp(0.01 * value) AS w FROM ({SPARSE})),
p AS (SELECT g, sum(w) AS w, sum(w * v) / sum(w) AS m, sum(w * v * v) / sum(w) AS q, max(v) FILTER (y) AS c, max(w) FILTER (y) AS wc FROM x GROUP BY g HAVING count(*) FILTER (y) = 1 AND count(*) > 1)
SELECT count(*) AS n, round(sum(ln(w / wc)), 6) AS loss, round(sum(m - c), 6) AS gradient, round(sum(q - m * m), 6) AS curvature FROM p""")
def _clogit_step(spark, sf_dir):
    from braidlog.models.likelihood import stratified_step

    step = stratified_step(_cases(spark, sf_dir), ["value"], [0.01])
    return rounded(step.select("n", "loss", F.col("gradient")[0].alias("gradient"), F.col("curvature")[0].alias("curvature")), "loss", "gradient", "curvature")


@registered("residual_process", f"""
WITH x AS (SELECT *, floor(rid / 4)::BIGINT AS g, rid % 4 AS k FROM ({SPARSE})), d AS (SELECT a.g, a.value - b.value AS d FROM x a JOIN x b ON a.g = b.g AND a.k = 0 AND b.k = 1),
s AS (SELECT g, d * (1 - 1 / (1 + exp(-0.01 * d))) AS v, row_number() OVER (ORDER BY g) / count(*) OVER () AS u FROM d)
SELECT g AS stratum, round(u, 6) AS u, round(sum(v) OVER (ORDER BY g) - u * sum(v) OVER (), 4) AS w FROM s""")
def _process(spark, sf_dir):
    from braidlog.models.compare import residual_process

    wide = widen_case_control(_cases(spark, sf_dir), stratum="stratum", covariates=["value"])
    wide = wide.withColumns({"__p": 1 / (1 + F.exp(-0.01 * F.col("d_value"))), "__order": F.col("stratum").cast("long")})
    got = residual_process(wide, ["d_value"]).select(F.col("__order").alias("stratum"), "u", F.col("w_d_value").alias("w"))
    return got.withColumns({"u": F.round("u", 6), "w": F.round("w", 4)})


@registered("cauchy_combination", """
WITH p AS (SELECT DISTINCT least(greatest(l_discount * 5 + 0.01, 1e-15), 1 - 1e-15) AS p FROM lineitem), t AS (SELECT avg(tan(pi() * (0.5 - p))) AS t FROM p)
SELECT round(t, 6) AS statistic, round(0.5 - atan(t) / pi(), 6) AS p_value FROM t""")
def _cauchy(spark, sf_dir):
    p = F.least(F.greatest(F.col("l_discount") * 5 + 0.01, F.lit(1e-15)), F.lit(1 - 1e-15))
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(p.alias("p")).distinct()
    t = table.agg(F.avg(F.tan(F.pi() * (0.5 - F.col("p")))).alias("t"))
    return rounded(t.select(F.col("t").alias("statistic"), (0.5 - F.atan("t") / F.pi()).alias("p_value")), "statistic", "p_value")


# Fits, goodness of fit, simulation and streams: SQL can't express them; the tests hold them against brute force.
_STATS = ["reciprocity_count", "sender_outdegree"]


def _rows(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def _events(spark, sf_dir):
    return dense_log(spark, sf_dir).select("sender", "receiver", "time", "rid")


@registered("compare_models")
def _compare(spark, sf_dir):
    from braidlog.models.compare import Sampling, compare_models

    return compare_models(_events(spark, sf_dir), {"reciprocity": _STATS[:1], "both": _STATS}, Sampling(seed=11))[0]


@registered("compare_models_smooth")
def _compare_smooth(spark, sf_dir):
    from braidlog.models.compare import Sampling, compare_models_smooth

    return compare_models_smooth(_events(spark, sf_dir), {"curve": {"reciprocity_count": "nl"}, "over_time": {"reciprocity_count": "tv"}}, Sampling(seed=11), k=6)[0]


@registered("compare_models_global")
def _compare_global(spark, sf_dir):
    from braidlog.models.compare import Sampling, compare_models_global

    return compare_models_global(_events(spark, sf_dir), {"time": {"reciprocity_count": "linear", "time": "global_time"}}, sampling=Sampling(seed=11), k=6)[0]


#: Newton's steps for one coefficient, written out: each reads the sums of the log-likelihood of strata at the last value.
_STEPS = 12


def _newton_sql(sums: str) -> str:
    """CTEs b0, b1, ...: sums is a SELECT of gradient g and curvature h at {b}."""
    return ", ".join(["b0 AS (SELECT 0.0::DOUBLE AS b)"] + [f"b{k} AS MATERIALIZED (SELECT b - g / h AS b FROM b{k - 1}, ({sums.format(b=f'(SELECT b FROM b{k - 1})')}))" for k in range(1, _STEPS + 1)])


_STRATA_SUMS = """SELECT sum(m - c) AS g, sum(q - m * m) AS h FROM (SELECT g, sum(exp({b} * v) * v) / sum(exp({b} * v)) AS m, sum(exp({b} * v) * v * v) / sum(exp({b} * v)) AS q, max(v) FILTER (y) AS c
  FROM x GROUP BY g HAVING count(*) FILTER (y) = 1 AND count(*) > 1)"""
_PAIR_SUMS = "SELECT sum(-d * (1 - 1 / (1 + exp(-{b} * d)))) AS g, sum(d * d * (1 / (1 + exp(-{b} * d))) * (1 - 1 / (1 + exp(-{b} * d)))) AS h FROM d"


@registered("rem_clogit", f"""
WITH x AS (SELECT floor(rid / 4)::BIGINT AS g, rid % 4 = 0 AS y, value AS v FROM ({SPARSE})), {_newton_sql(_STRATA_SUMS)}
SELECT 'value' AS term, round(b, 8) AS estimate, round(1 / sqrt(h), 8) AS std_error, round(b * sqrt(h), 5) AS z FROM b{_STEPS}, ({_STRATA_SUMS.format(b=f"(SELECT b FROM b{_STEPS})")})""")
def _rem_clogit(spark, sf_dir):
    from braidlog.models.rem import rem

    fit = _rows(spark, rem("value", _cases(spark, sf_dir), "clogit", stratum="stratum").summary(), "term string, estimate double, std_error double, z double")
    return fit.select("term", F.round("estimate", 8).alias("estimate"), F.round("std_error", 8).alias("std_error"), F.round("z", 5).alias("z"))


@registered("gof_univariate_pairs", f"""
WITH x AS (SELECT *, floor(rid / 4)::BIGINT AS g, rid % 4 AS k FROM ({SPARSE})), d AS (SELECT a.g, a.value - b.value AS d FROM x a JOIN x b ON a.g = b.g AND a.k = 0 AND b.k = 1),
{_newton_sql(_PAIR_SUMS)}, s AS (SELECT g, d * (1 - 1 / (1 + exp(-(SELECT b FROM b{_STEPS}) * d))) AS v FROM d),
c AS (SELECT g, count(*) OVER () AS n, row_number() OVER (ORDER BY g) / count(*) OVER () AS u, sum(v) OVER (ORDER BY g) AS run, sum(v) OVER () AS total, avg(v * v) OVER () AS J FROM s),
w AS (SELECT g, u, (run - u * total) / sqrt(n) / sqrt(J + 1e-8) AS W FROM c), t AS (SELECT max(abs(W)) AS top FROM w)
SELECT round(u, 6) AS u, round(W, 4) AS W, round(top, 4) AS statistic, round((SELECT least(1, greatest(0, 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * top * top)))) FROM generate_series(1, 100) i(k)), 4) AS p_value FROM w, t""")
def _gof_pairs(spark, sf_dir):
    from braidlog.models.compare import Prepared, Sampling, gof_univariate
    from braidlog.models.likelihood import difference_step, newton

    cases = _cases(spark, sf_dir)
    wide = widen_case_control(cases, stratum="stratum", covariates=["value"])
    fit = newton(lambda b: difference_step(wide, ["d_value"], b), ["value"])
    wide = wide.withColumns({"__p": 1 / (1 + F.exp(-float(fit.beta[0]) * F.col("d_value"))), "__order": F.col("stratum").cast("long")})
    got = gof_univariate(cases, ["value"], "value", Sampling(), Prepared(["value"], fit, wide, cases))
    return got["process"].select(F.round("u", 6).alias("u"), F.round("W", 4).alias("W"), F.lit(round(got["statistic"], 4)).alias("statistic"), F.lit(round(got["p_value"], 4)).alias("p_value"))


@registered("rem_gam")
def _rem_gam(spark, sf_dir):
    from braidlog.models.rem import rem

    fit = rem("nl(value)", _cases(spark, sf_dir), "gam", stratum="stratum", k=6)
    return spark.createDataFrame([(fit.n, float(fit.edf), float(fit.log_lik), fit.converged)], "n long, edf double, log_lik double, converged boolean")


@registered("rem_nn")
def _rem_nn(spark, sf_dir):
    from braidlog.models.nn import NetControl
    from braidlog.models.rem import rem

    fit = rem("value", _cases(spark, sf_dir), "nn", stratum="stratum", nn=NetControl(seed=1))
    return spark.createDataFrame([(fit.n, fit.parameters, fit.concordance, float(fit.log_lik))], "n long, parameters long, concordance double, log_lik double")


@registered("martingale_residuals")
def _residuals(spark, sf_dir):
    from braidlog.models.compare import Sampling, martingale_residuals

    return martingale_residuals(_events(spark, sf_dir), _STATS, Sampling(seed=11))


@registered("martingale_residual_sums", f"SELECT row_number() OVER (ORDER BY rid) AS stratum, s AS sender, r AS receiver, 2::BIGINT AS n, 0.0::DOUBLE AS total, true AS bounded FROM ({DENSE})")
def _residual_sums(spark, sf_dir):
    """Of each stratum the event, how many residuals it has, their sum, and whether a case's lies in 0 to 1 and a control's in -1 to 0."""
    from braidlog.models.compare import Sampling, martingale_residuals

    rows = martingale_residuals(_events(spark, sf_dir), _STATS, Sampling(seed=11))
    case = F.col("role") == "case"
    inside = F.when(case, F.col("residual").between(0, 1)).otherwise(F.col("residual").between(-1, 0))
    got = rows.groupBy("stratum").agg(F.max(F.when(case, F.col("sender"))).alias("sender"), F.max(F.when(case, F.col("receiver"))).alias("receiver"), F.count(F.lit(1)).alias("n"), F.abs(F.round(F.sum("residual"), 6)).alias("total"), F.min(inside).alias("bounded"))
    return got.select("stratum", "sender", "receiver", "n", "total", "bounded")


@registered("gof_global")
def _gof(spark, sf_dir):
    from braidlog.models.compare import Sampling, gof_global

    return _rows(spark, gof_global(_events(spark, sf_dir), _STATS, Sampling(seed=11))["components"], "covariate string, statistic double, p_value double")


@registered("gof_univariate")
def _gof_one(spark, sf_dir):
    from braidlog.models.compare import Sampling, gof_univariate

    return gof_univariate(_events(spark, sf_dir), _STATS, _STATS[0], Sampling(seed=11))["process"]


@registered("gof_multivariate")
def _gof_many(spark, sf_dir):
    from braidlog.models.compare import Sampling, gof_multivariate

    got = gof_multivariate(_events(spark, sf_dir), _STATS, _STATS[0], sampling=Sampling(seed=11))
    return spark.createDataFrame([(got["covariate"], float(got["statistic"]), float(got["p_value"]))], "covariate string, statistic double, p_value double")


@registered("gof_auxiliary")
def _gof_other(spark, sf_dir):
    from braidlog.models.compare import Sampling, gof_auxiliary

    got = gof_auxiliary(_events(spark, sf_dir), _STATS[:1], _STATS[1], sampling=Sampling(seed=11))
    return spark.createDataFrame([(got["auxiliary"], float(got["statistic"]), float(got["p_value"]))], "auxiliary string, statistic double, p_value double")


@registered("simulate_relational_events")
def _simulated(spark, sf_dir):
    from braidlog.models.simulate import Simulation, simulate_relational_events

    names = tuple(r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect())
    return simulate_relational_events(spark, Simulation(300, names, names, endogenous_effects={"reciprocity_count": 0.1}, n_controls=1), replicates=4, seed=3)


@registered("simulate_actor_covariates")
def _simulated_actors(spark, sf_dir):
    from braidlog.models.simulate import simulate_actor_covariates

    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]
    return simulate_actor_covariates(spark, names, ["x", "y"], [0.0, 1.0, 2.0], rho=0.5, seed=3)


@registered("simulate_directed_hyperedge_events")
def _simulated_directed(spark, sf_dir):
    from braidlog.models.simulate import simulate_directed_hyperedge_events

    names = [r["r_name"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]
    return simulate_directed_hyperedge_events(spark, 100, names, names, (1, 2), (1, 2), effects={"subrep_1_1": 0.1}, stats=["size_I", "activity"], seed=3)


@registered("simulate_hyperedge_events")
def _simulated_hyper(spark, sf_dir):
    from braidlog.models.simulate import simulate_hyperedge_events

    names = [r["r_name"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]
    return simulate_hyperedge_events(spark, 100, names, 3, effects={"subrep_1": 0.1}, stats=["size", "activity"], seed=3)


@registered("simulate_directed_hyperevents_tvnl")
def _simulated_curves(spark, sf_dir):
    import math

    from braidlog.models.simulate import simulate_directed_hyperevents_tvnl

    region = {r["r_name"]: float(r["r_regionkey"]) / 4 for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()}
    return simulate_directed_hyperevents_tvnl(spark, region, region, lambda t: math.sin(t), lambda v: -v * v, max_group_senders=2, seed=3)


@registered("nn_uncertainty")
def _uncertainty(spark, sf_dir):
    from braidlog.models.nn import NetControl
    from braidlog.models.rem import collected_strata, nn_uncertainty

    X, case, strata = collected_strata(_cases(spark, sf_dir), ["value"], "stratum", "event", 2500)
    found = nn_uncertainty(spark, X, case, strata, ["value"], NetControl(epochs=40, seed=1), B=24)
    band = found["bands"]["value"]
    rows = [tuple(float(v) for v in r) for r in zip(band["x"], band["mean"], band["low"], band["high"])]
    return spark.createDataFrame(rows, "x double, mean double, low double, high double")
