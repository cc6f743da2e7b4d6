"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.llm.common import WHITE, attach, discard, flagged, written


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty. Replacing byte strings is far cheaper in the JVM than a regex."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for white in WHITE:
        out = F.replace(out, F.lit(white), F.lit(""))
    return out


def _levels(text: Column, prefix_chars: int) -> tuple[Column, Column]:
    """Length in bytes and prefix hash of a normalised text."""
    return F.octet_length(text), F.xxhash64(F.substring(text, 1, prefix_chars))


def _shared(docs: DataFrame, text_col: str, prefix_chars: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """The classes of length and prefix (one hash each) that several rows have, and the table that they come from.

    First lengths that occur once are settled, then prefixes among the rows of other lengths. Length and
    prefix of all rows are a narrow table that one reading of the texts makes.
    """
    length, prefix = _levels(normalised(F.col(text_col)), prefix_chars)
    keyed = written(docs.select(length.alias("__len"), prefix.alias("__pre")), "levels")
    several = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*keys)
    left = flagged(keyed, F.col("__len"), several(keyed, "__len"), filter_bits).filter("__hit")
    return several(left, "__len", "__pre").select(F.xxhash64("__len", "__pre").alias("__class")), keyed


def _refined(docs: DataFrame, columns: list[Column], id_col: str, text_col: str, prefix_chars: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """columns, __chars, __id and __hash: the full hash of rows whose class survives, else null; and the table to discard when it is used.

    The classes that survive are a bitmap of fixed size, so the texts need no shuffle; two classes in one
    bit only cost a full hash in vain.
    """
    classes, keyed = _shared(docs, text_col, prefix_chars, filter_bits)
    rows = docs.select(*columns, F.col(id_col).alias("__id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__chars"), normalised(F.col(text_col)).alias("__text"))
    rows = flagged(rows, F.xxhash64(*_levels(F.col("__text"), prefix_chars)), classes, filter_bits)
    return rows.withColumn("__hash", F.when(F.col("__hit"), F.unhex(F.sha2("__text", 256)))).drop("__text", "__hit"), keyed


def _judged(rows: DataFrame) -> DataFrame:
    """rows (a table with __uid, __id, __chars, __hash) with the id that stays, the group's size and whether the row stays."""
    # The row that stays: most code points, then smallest id; a null id comes last, and of equal rows one stays.
    best = F.min(F.struct((-F.col("__chars")).alias("chars"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__uid").alias("uid")))
    groups = rows.filter("__hash IS NOT NULL").groupBy("__hash").agg(F.count(F.lit(1)).alias("__size"), best.alias("__best"))
    found = attach(rows, groups, "__hash", "__size", rows.count(), F.col("__uid"))
    keep = F.when(F.col("__best").isNull(), F.col("__id")).otherwise(F.col("__best.id"))
    return found.select("*", keep.alias("__keep"), F.coalesce(F.col("__best.uid") == F.col("__uid"), F.lit(True)).alias("__stays"), F.coalesce("__size", F.lit(1).cast("long")).alias("__many"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = 64, filter_bits: int = 1 << 25) -> DataFrame:
    """Every row's group of equal texts: id, the carried columns, keep_id, group_size, kept.

    Texts are equal when they are after white space is deleted. The row with the most code points
    stays, then the smallest id (of any type that has an order); a null id comes last, and of rows that agree in both one
    stays. Null and empty texts are one group of empty texts. An empty table gives no rows.
    Carried columns that are named like a result column are left out; other columns aren't read.
    prefix_chars: of the normalised text, for the second level. filter_bits: of the bitmaps of
    surviving lengths and classes, a multiple of 32768. A very long text is hashed where it lies.
    """
    carry = tuple(c for c in carry if c.lower() not in {id_col.lower(), "keep_id", "group_size", "kept"})
    names = {c: f"__c{k}" for k, c in enumerate(carry)}
    rows, keyed = _refined(docs, [F.col(c).alias(n) for c, n in names.items()], id_col, text_col, prefix_chars, filter_bits)
    rows = written(rows.withColumn("__uid", F.monotonically_increasing_id()), "hashes")
    discard(keyed)
    return _judged(rows).select(F.col("__id").alias(id_col), *[F.col(n).alias(c) for c, n in names.items()], F.col("__keep").alias("keep_id"), F.col("__many").alias("group_size"), F.col("__stays").alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, filter_bits: int = 1 << 25) -> DataFrame:
    """The rows that stay, with all their columns; only rows whose text may have an equal are written and compared."""
    rows, _ = _refined(docs, [F.struct(*docs.columns).alias("__row")], id_col, text_col, prefix_chars, filter_bits)
    several = written(rows.filter("__hash IS NOT NULL").withColumn("__uid", F.monotonically_increasing_id()), "several")
    stay = _judged(several.select("__uid", "__id", "__chars", "__hash")).filter("__stays").select(F.col("__uid").alias("__of"))
    found = several.join(stay, F.col("__uid") == F.col("__of"), "left_semi")
    return rows.filter("__hash IS NULL").select("__row.*").unionByName(found.select("__row.*"))
