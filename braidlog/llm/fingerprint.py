"""Context-triggered piecewise hashing: a rolling hash cuts a text into chunks, chunk hashes make a signature."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import bounded_batches, tidied, written

#: Bytes under the rolling hash, blocks in a text at most, symbols of a signature at most, bits that can trigger a cut.
ROLL, BLOCKS, SYMBOLS, TRIGGER_BITS = 8, 64, 128, 40
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class Fingerprint(NamedTuple):
    """block: log2 of the mean chunk size. fine, coarse: symbols at that size and at twice it."""

    block: int
    fine: np.ndarray
    coarse: np.ndarray

    def __str__(self) -> str:
        show = lambda s: base64.b64encode(np.stack([s >> 4, (s & 15) << 4], 1).astype(np.uint8).tobytes()).decode().rstrip("=") if len(s) else ""
        return f"{1 << self.block}:{show(self.fine)}:{show(self.coarse)}"


def _cuts(triggers: list[int], size: int, block: int) -> list[int]:
    """Last bytes of chunks: triggers at least half a block after the last cut, and further cuts where four blocks have none.

    So a text that repeats itself gets neither thousands of cuts nor none.
    """
    least, most, last, cuts = (1 << block) // 2, 4 << block, -1, []
    for at in [*triggers, size - 1]:
        while at - last > most:
            last += most
            cuts.append(last)
        if at - last >= least:
            last = at
            cuts.append(at)
    return cuts


def _signature(mixed: np.ndarray, cuts: list[int]) -> np.ndarray:
    """A 12-bit symbol for each chunk; the last ends at the text's end."""
    starts = [0, *(c + 1 for c in cuts if c + 1 < len(mixed))]
    return ((np.add.reduceat(mixed, starts) * _MIX[2]) >> np.uint64(52)).astype(np.uint16)


def fingerprint(data: bytes) -> Fingerprint:
    """The fingerprint of a whole text's bytes.

    The block size is the least power of two of which BLOCKS make the text, so it depends on the
    length alone. The hash at a byte covers the ROLL bytes that end there; at block size 2**k it triggers
    a cut where its trigger bits end in k ones, so the cuts depend on what surrounds them and an edit
    moves only those near it. Chunks are half a block to four blocks long, so a signature has at most
    SYMBOLS symbols.
    """
    if not data:
        return Fingerprint(0, np.empty(0, np.uint16), np.empty(0, np.uint16))
    block = max(0, ((len(data) - 1) // BLOCKS).bit_length())
    padded = bytes(ROLL - 1) + data
    rolled = np.ndarray(len(data), "<u8", padded, strides=(1,)) * _MIX[0]
    mask = np.uint64(((1 << min(block, TRIGGER_BITS)) - 1) << (64 - TRIGGER_BITS))
    fine = np.flatnonzero((rolled & mask) == mask)
    coarse = fine[(rolled[fine] >> np.uint64(64 - TRIGGER_BITS + min(block, TRIGGER_BITS - 1))) & np.uint64(1) == 1]
    rolled ^= rolled >> np.uint64(31)
    rolled *= _MIX[1]
    rolled ^= rolled >> np.uint64(29)
    return Fingerprint(block, *(_signature(rolled, _cuts(at.tolist(), len(data), k)) for at, k in ((fine, block), (coarse, block + 1))))


def likeness_of_signatures(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """1 - edit distance / (both lengths), with insertions and deletions, for each pair; two empty ones are alike.

    Each pair's longest common subsequence takes two machine words, so all pairs go through it together.
    """
    n = len(left)
    a, b = np.full((n, SYMBOLS), 0xFFFF, np.uint16), np.full((n, SYMBOLS), 0xFFFE, np.uint16)
    for k, (x, y) in enumerate(zip(left, right)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    match = np.packbits(b[:, :, None] == a[:, None, :], axis=2, bitorder="little").view("<u8")
    low, high = np.full(n, ~np.uint64(0)), np.full(n, ~np.uint64(0))
    for j in range(max(map(len, right), default=0)):
        first, second = match[:, j, 0], match[:, j, 1]
        low_sum = low + (low & first)
        high_sum = high + (high & second) + (low_sum < low)
        low, high = low_sum | (low & ~first), high_sum | (high & ~second)
    common = (np.bitwise_count(~low) + np.bitwise_count(~high)).astype(float)
    both = np.array([len(x) + len(y) for x, y in zip(left, right)], float)
    return np.where(both > 0, 2 * common / np.maximum(both, 1), 1.0)


def likeness(pairs: list[tuple[Fingerprint, Fingerprint]], at_once: int = 256) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; block sizes must be equal or one twice the other to be compatible, else 0."""
    out, left, right, of = np.zeros(len(pairs)), [], [], []
    for k, (x, y) in enumerate(pairs):
        sides = [(x.fine, y.fine), (x.coarse, y.coarse)] if x.block == y.block else [(x.fine, y.coarse)] if x.block == y.block + 1 else [(x.coarse, y.fine)] if y.block == x.block + 1 else []
        if not len(x.fine) or not len(y.fine):  # an empty text is like an empty text only
            sides = [(x.fine, y.fine)]
        for p, q in sides:
            left.append(p), right.append(q), of.append(k)
    for at in range(0, len(of), at_once):
        np.maximum.at(out, of[at : at + at_once], likeness_of_signatures(left[at : at + at_once], right[at : at + at_once]))
    return out


def _edited(text: str, following: str) -> str:
    last = len(text) // 4
    return text[: len(text) - last] + following[:last]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 20_000) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    Rows are ordered by id, then a hash of the text; a null text is empty, a null id comes first, and the first row
    follows the last (one row follows itself). The edited text has its last quarter of code points
    replaced by as many from the start of the following text. Texts are dealt once, by ranges of ids;
    a task holds one batch of its sorted rows and hands its first and last row to a second step, which
    joins the last row of each range with the first of the next. A very long text is one value, which one task
    holds. Other columns aren't read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType
    result = [(id_col, key), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in [*result, ("part", T.LongType()), ("edge", T.StringType()), ("text", T.StringType())]])
    arrow = to_arrow_schema(schema)

    def judged(keys: list, texts: list[str], prints: list[Fingerprint]) -> Iterator[pa.RecordBatch]:
        """Results for all but the last."""
        edits = [_edited(x, y).encode() for x, y in zip(texts, texts[1:])]
        marks = [fingerprint(x) for x in edits]
        n = len(edits)
        near = likeness([*zip(prints, marks), *zip(prints, prints[1:])])
        columns = [keys[:n], [len(x) for x in texts[:n]], [hashlib.sha256(x).hexdigest() for x in edits], [str(x) for x in prints[:n]], [str(x) for x in marks], near[:n], near[n:], [None] * n, [None] * n, [None] * n]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def edge(part: int, kind: str, row: tuple) -> pa.RecordBatch:
        columns = [row[0], len(row[1]), None, None, None, None, None, part, kind, row[1]]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
                if not keys:
                    continue
                if last is None:
                    yield edge(part, "first", (keys[0], texts[0]))
                prints = [fingerprint(x.encode()) for x in texts]
                if last is not None:
                    keys, texts, prints = [last[0], *keys], [last[1], *texts], [last[2], *prints]
                yield from judged(keys, texts, prints)
                last = keys[-1], texts[-1], prints[-1]
        if last is not None:
            yield edge(part, "last", last)

    def over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = [row["text"], row["following"]]
                yield from judged([row[id_col], None], texts, [fingerprint(x.encode()) for x in texts])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows_per_task)
    # Rows of one id are dealt on by a hash of the text, and equal rows by their number, so a repeated id isn't one task.
    place = [F.col("__id"), F.xxhash64("__text"), F.col("__no")]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).withColumn("__no", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *place).sortWithinPartitions(*place).select("__id", "__text")
    out = written(rows.mapInArrow(tidied(in_order), schema), "fingerprints")
    # One row for each range: its number and the next one's, around the end.
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = out.filter("edge = 'first'").select("part").withColumn("next", F.coalesce(F.lead("part").over(ring), F.min("part").over(whole)))
    first = out.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = out.filter("edge = 'last'").select(F.col(id_col), "part", "text")
    edges = last.join(ranges, "part").join(first, "next").select(F.col(id_col), "text", "following").mapInArrow(tidied(over_edges), schema)
    names = [n for n, _ in result]
    return out.filter("edge IS NULL").select(*names).unionByName(edges.select(*names))
