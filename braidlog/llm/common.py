"""What the corpus operators share: tables, the shared folder and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.storage import discard, released, shared_dir, written  # noqa: F401

#: Characters that separate words and that exact duplicates may differ in: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches hold at most so many bytes from now on, else 10,000 rows of any length; a session's own setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow that gives its memory back when a partition ends; workers live on and serve other stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            released()

    return run


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column, hot_keys: int = 1000) -> DataFrame:
    """rows left-joined with groups on key, where a key may hold a third of all rows.

    groups has one row per key, and size counts the key's rows. Keys of more than total / hot_keys
    rows are fewer than hot_keys, so these groups are broadcast; the rows of the others meet their
    group in a shuffle in which no key is large. Rows that are done (hot or null key) take part in
    it with a salt from spread, so they don't meet in one task.
    """
    limit = max(hot_keys, total // hot_keys)
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > limit).select(F.col(key).alias("__hot"), F.struct(*values).alias("__found"))
    # Key and salt are one struct: a salt of its own would be a constant of the cold side, which Spark leaves out of the partitioning.
    cold = groups.filter(F.col(size) <= limit).select(F.struct(F.col(key).alias("key"), F.lit(0).alias("salt")).alias("__cold"), F.struct(*values).alias("__other"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    done = F.col("__hot").isNotNull() | F.col(key).isNull()
    salt = F.when(done, F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    out = out.withColumn("__key", F.struct(F.when(~done, F.col(key)).alias("key"), salt.alias("salt")))
    out = out.join(cold, F.col("__key") == F.col("__cold"), "left")
    out = out.withColumn("__found", F.coalesce("__found", "__other"))
    return out.select(*rows.columns, *[F.col(f"__found.{c}").alias(c) for c in values])


def flagged(rows: DataFrame, key: Column, wanted: DataFrame, bits: int) -> DataFrame:
    """rows with __hit: whether key may be in wanted (one column), by a bitmap of fixed size, bits / 8 bytes, that is broadcast.

    It is true for all keys that are in wanted and for few others, so what it clears needs no shuffle; null keys are false.
    """
    slot = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(bits)) + 1
    (name,) = wanted.columns
    table = wanted.select(slot(F.col(name)).alias("__slot")).groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    at = rows.withColumn("__slot", slot(key)).join(F.broadcast(table), F.bitmap_bucket_number("__slot") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.bitmap_bit_position("__slot") % 8)), F.lit(2)) == 1
    return at.select(*rows.columns, (F.coalesce(hit, F.lit(False)) & key.isNotNull()).alias("__hit"))


def without(docs: DataFrame, id_col: str, dropped: DataFrame, filter_bits: int = 1 << 25) -> DataFrame:
    """docs without the rows whose id is in dropped (one column); null ids stay.

    Rows that a bitmap of the dropped ids clears pass where they are; only the others, the dropped ones
    and few more, are shuffled to be looked up.
    """
    (name,) = dropped.columns
    rows = flagged(docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__id")), F.col("__id"), dropped, filter_bits)
    clear = rows.filter("NOT __hit").select("__row.*")
    again = rows.filter("__hit").select("__row", "__id").join(dropped.select(F.col(name).alias("__dropped")), F.col("__id") == F.col("__dropped"), "left_anti")
    return clear.unionByName(again.select("__row.*"))


def kept_by(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, for whose texts keep gives true; it gets blocks of texts."""
    bounded_batches(docs.sparkSession)
    arrow = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from braidlog.llm.words import blocks_of

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow)], schema=arrow)
            for k, block in blocks_of(batch.column(at)):
                yield batch.slice(k, len(block)).filter(pa.array(keep(block).astype(bool)))

    return docs.mapInArrow(tidied(pick), docs.schema)
