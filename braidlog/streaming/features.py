"""The same statistics on a stream: state for actors and dyads, kept events by actor for two-paths.

Rows of a micro-batch are read in (time, number) order, each sees those before it, and rows of earlier
batches come before. Statistics of past rows can't be taken back, so a stream must be in order up to
its watermark: a row that is older than what its key has seen is given with late set, without
statistics, and isn't counted by later rows; so a sink can count or keep late rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from braidlog.plans.catalog import LEGS
from braidlog.plans.features import endogenous_features
from braidlog.storage import deleted

DYAD = ("recency", "reciprocity_binary", "reciprocity_count", "reciprocity_time_recent", "reciprocity_time_first", "reciprocity_exp_decay")
_ROW = "sender string, receiver string, time double, rid long"
_WAY = ("count", "first", "last", "decay")
_KEPT = T.StructType([*(T.StructField(c, T.ArrayType(T.StringType())) for c in ("sender", "receiver")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in _WAY)])
#: Parts of a bucket's state; a batch reads and writes those that its rows are in.
BLOCKS = 16


def ready(spark: SparkSession) -> None:
    """Sets what keyed state needs; call it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class DyadProcessor(StatefulProcessor):
    """Keeps, for each sender and receiver of a bucket, how many events there were, when the first and last, and a decayed sum as of the last.

    A bucket is many pairs, as each call and each reading of state costs more than some hundred rows do.
    """

    def __init__(self, half_life: float | None):
        self.rate = math.log(2) / half_life if half_life else 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", T.StructType([T.StructField("block", T.IntegerType())]), _KEPT)

    def _read(self, block: int) -> dict[tuple[str, str], list[float]]:
        if not self.blocks.containsKey((block,)):
            return {}
        senders, receivers, *ways = self.blocks.getValue((block,))
        return dict(zip(zip(senders, receivers), map(list, zip(*ways))))

    def _write(self, block: int, kept: dict[tuple[str, str], list[float]]) -> None:
        if kept:
            self.blocks.updateValue((block,), (*map(list, zip(*kept)), *map(list, zip(*kept.values()))))

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        for block, rows in initial.groupby("block"):
            kept = self._read(int(block))
            for r in rows.itertuples(index=False):
                kept[(r.lo, r.hi) if r.up else (r.hi, r.lo)] = [float(r.count), float(r.first), float(r.last), float(r.decay)]
            self._write(int(block), kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["block", "time", "rid"])
        out, block, kept = [], None, {}
        for b, s, r, t, rid in zip(*(batch[c].tolist() for c in ("block", "sender", "receiver", "time", "rid"))):
            if b != block:
                if block is not None:
                    self._write(block, kept)
                block, kept = b, self._read(b)
            own, back = kept.get((s, r)), kept.get((r, s))
            if (own and t < own[2]) or (back and t < back[2]):
                out.append((s, r, t, rid, *[None] * len(DYAD), True))
                continue
            n = back[0] if back else 0.0
            decay = back[3] * math.exp(-self.rate * (t - back[2])) if back and self.rate else 0.0
            out.append((s, r, t, rid, t - own[2] if own else None, int(n > 0), n, t - back[2] if back else None, t - back[1] if back else None, decay, False))
            if own:
                own[3] = own[3] * math.exp(-self.rate * (t - own[2])) + 1
                own[0], own[2] = own[0] + 1, t
            else:
                kept[s, r] = [1.0, t, t, 1.0]
        self._write(block, kept)
        out = pd.DataFrame(out, columns=["sender", "receiver", "time", "rid", *DYAD, "late"])
        yield out.astype({"reciprocity_binary": "Int32"})

    def close(self) -> None:
        pass


def dyad_state(log: DataFrame, half_life: float | None = None) -> DataFrame:
    """A past log as the initial state of stream_dyad_features: lo, hi, up, count, first, last, decay (as of last)."""
    rate = math.log(2) / half_life if half_life else 0.0
    rows = log.select(F.least("sender", "receiver").alias("lo"), F.greatest("sender", "receiver").alias("hi"), (F.col("sender") < F.col("receiver")).alias("up"), F.col("time").cast("double").alias("time"))
    ends = rows.groupBy("lo", "hi", "up").agg(F.count(F.lit(1)).cast("double").alias("count"), F.min("time").alias("first"), F.max("time").alias("last"))
    both = rows.join(ends, ["lo", "hi", "up"])
    return both.groupBy("lo", "hi", "up", "count", "first", "last").agg(F.sum(F.exp((F.col("time") - F.col("last")) * rate)).alias("decay"))


def stream_dyad_features(stream: DataFrame, half_life: float | None = None, initial: DataFrame | None = None, buckets: int = 4096) -> DataFrame:
    """sender, receiver, time, rid, the statistics of DYAD and late of a stream with these columns.

    State is kept by buckets of pairs, whose number stays with a checkpoint. A batch reads and writes the pairs
    that share one of buckets * BLOCKS places with its own.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")

    def placed(rows: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("lo", "hi"), F.lit(buckets * BLOCKS))
        return rows.withColumns({"bucket": F.pmod(place, F.lit(buckets)).cast("int"), "block": F.floor(place / buckets).cast("int")})

    rows = stream.select(F.col("sender").cast("string"), F.col("receiver").cast("string"), F.col("time").cast("double"), F.col("rid").cast("long"))
    rows = placed(rows.withColumns({"lo": F.least("sender", "receiver"), "hi": F.greatest("sender", "receiver")})).drop("lo", "hi")
    schema = f"{_ROW}, recency double, reciprocity_binary int, reciprocity_count double, reciprocity_time_recent double, reciprocity_time_first double, reciprocity_exp_decay double, late boolean"
    return rows.groupBy("bucket").transformWithStateInPandas(DyadProcessor(half_life), schema, "Append", "None", placed(initial).groupBy("bucket") if initial is not None else None)


class DegreeProcessor(StatefulProcessor):
    """Keeps how many events an actor has had, and the time of the last."""

    def __init__(self, name: str):
        self.name = name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType()), T.StructField("last", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["time", "rid"])
        n, last = self.count.get() if self.count.exists() else (0, -math.inf)
        newest = batch["time"].cummax().clip(lower=last)
        late = batch["time"] < newest
        before = n + (~late).cumsum() - (~late)
        self.count.update((int(n + (~late).sum()), float(newest.iloc[-1])))
        yield pd.DataFrame({"rid": batch["rid"], self.name: before.astype(float).mask(late), "late": late})

    def close(self) -> None:
        pass


def stream_degree(stream: DataFrame, actor: str = "sender") -> DataFrame:
    """rid, sender_outdegree (or receiver_indegree) and late of a stream."""
    name = "sender_outdegree" if actor == "sender" else "receiver_indegree"
    rows = stream.select(F.col(actor).cast("string").alias("actor"), F.col("time").cast("double"), F.col("rid").cast("long"))
    return rows.groupBy("actor").transformWithStateInPandas(DegreeProcessor(name), f"rid long, {name} double, late boolean", "Append", "None")


class TriadSink:
    """For foreachBatch: statistics of two-paths of each batch, over all events of the batches so far.

    Both legs of a two-path touch the row's sender or receiver, so a batch needs only the past events of its
    own actors. Those are kept under path by actor: each event lies with its sender and with its receiver, in
    one of `buckets` folders by the actor's hash, and a batch reads the folders of its actors. A batch adds a
    segment; every FOLD segments of one size become one, so few are read and an event is written
    anew a logarithmic number of times. The past is the batch's prior log, so results are those of one
    strict run. A late row sees the events before its time; rows of earlier batches aren't given anew.
    A batch that is given again replaces what it wrote. Batches are numbered from 0 without gaps, as a
    streaming query numbers them. A row without a sender,
    receiver or time is given with what its own batch knows, and isn't an event for later ones.
    """

    FOLD = 4

    def __init__(self, path: str, stats: list[str], half_life: float | None = None, buckets: int = 64):
        if not all(s.startswith(tuple(LEGS)) for s in stats):
            raise ValueError("only statistics of two-paths")
        if buckets < 1:
            raise ValueError("buckets must be positive")
        self.path, self.stats, self.half_life, self.buckets = path.rstrip("/"), stats, half_life, buckets

    def _segments(self, batches: int) -> list[tuple[int, int]]:
        """The segments (from, to) that hold the first batches: those of the greatest size first."""
        out, start, size = [], 0, 1
        while size * self.FOLD <= batches:
            size *= self.FOLD
        while start < batches:
            if start + size <= batches:
                out.append((start, start + size))
                start += size
            else:
                size //= self.FOLD
        return out

    def _folded(self, batches: int) -> list[tuple[int, int]]:
        """The segments that end with this number of batches and are made of smaller ones, smallest first."""
        out, size = [], self.FOLD
        while batches and batches % size == 0:
            out.append((batches - size, batches))
            size *= self.FOLD
        return out

    def _at(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/events/segment={segment[0]}-{segment[1]}"

    def kept(self, spark: SparkSession, segments: list[tuple[int, int]]) -> DataFrame:
        """actor, sender, receiver, time, rid, bucket of segments; one that isn't there has no events."""
        schema = f"actor string, {_ROW}, bucket int"
        files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [at for at in map(self._at, segments) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(at))]
        parts = [spark.read.schema(schema).parquet(at) for at in there]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)

    def _keep(self, events: DataFrame, segment: tuple[int, int]) -> None:
        # A bucket is dealt to several tasks by actors, a hub's events by what they are.
        dealt = events.repartition("bucket", F.pmod(F.xxhash64("actor", "sender", "receiver", "time", "rid"), F.lit(8)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._at(segment))

    def past(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """sender, receiver, time of the events of earlier batches that touch an actor of rows."""
        spark = rows.sparkSession
        actors = rows.select(F.explode(F.array("sender", "receiver")).alias("actor")).distinct()
        buckets = [r[0] for r in actors.select(self._bucket("actor")).distinct().collect()]  # at most `buckets`
        near = self.kept(spark, self._segments(batch_id)).filter(F.col("bucket").isin(buckets)).join(actors, "actor", "left_semi")
        # An event of two of these actors is read with its sender only.
        others = near.filter("actor <> sender").join(actors.withColumnRenamed("actor", "sender"), "sender", "left_anti")
        return near.filter("actor = sender").select("sender", "receiver", "time").unionByName(others.select("sender", "receiver", "time"))

    def _bucket(self, actor: str) -> Column:
        return F.pmod(F.xxhash64(actor), F.lit(self.buckets)).cast("int").alias("bucket")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col("sender").cast("string"), F.col("receiver").cast("string"), F.col("time").cast("double"), F.col("rid").cast("long"))
        rows = rows.persist()
        try:
            # The query is past the batch before, so what that one folded isn't read any more.
            for start, end in self._folded(batch_id):
                size = (end - start) // self.FOLD
                for k in range(start, end, size):
                    deleted(spark, self._at((k, k + size)))
            out = endogenous_features(rows, self.stats, self.half_life, prior_log=self.past(rows, batch_id))
            out.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.path}/features/batch={batch_id}")
            ends = F.explode(F.array_distinct(F.array("sender", "receiver"))).alias("actor")
            whole = rows.dropna(subset=["sender", "receiver", "time"])
            self._keep(whole.select(ends, *rows.columns).select("*", self._bucket("actor")), (batch_id, batch_id + 1))
            for start, end in self._folded(batch_id + 1):
                size = (end - start) // self.FOLD
                self._keep(self.kept(spark, [(k, k + size) for k in range(start, end, size)]), (start, end))
        finally:
            rows.unpersist()
