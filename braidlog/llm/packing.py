"""Packing documents into token windows: full windows are cut off, the rest goes best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import bounded_batches, tidied, written


class OpenWindows:
    """Open windows by what they still hold: a segment tree over remaining capacities 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, by: int) -> None:
        node = self.leaves + left
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, left: int) -> None:
        self.windows[left].append(window)
        self._add(left, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window with the least remaining capacity that is need or more: (window, capacity)."""
        node = self.leaves + need
        while not self.count[node]:  # up to the first subtree on the right that has a window
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.leaves
        self._add(left, -1)
        return self.windows[left].pop(), left


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """window and offset of each piece; lengths must come in descending order and be at most capacity."""
    free, made = OpenWindows(capacity), 0
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        if found := free.tightest(length):
            w, left = found
        else:
            w, left = made, capacity
            made += 1
        window[k], offset[k] = w, capacity - left
        if left > length:
            free.put(w, left - length)
    return window, offset


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = False, short_first: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: id, start, length, ids_crc32, doc_tokens[, ids]. Full windows first, then what is left; short_first: the other way round."""
    bounded_batches(docs.sparkSession)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from braidlog.llm.tokenizer import fast_encoder

        encode = fast_encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in arrow]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                ends = range(len(ids), 0, -capacity) if short_first else range(capacity, len(ids) + capacity, capacity)
                for end in ends:
                    start = max(0, end - capacity)
                    part = ids[start:end]
                    values = [key, start, len(part), zlib.crc32(part.tobytes()), len(ids)] + [part.astype(np.int32)] * with_ids
                    for column, value in zip(rows, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, arrow)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidied(cut), schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = False, group_pieces: int = 8192) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document is its ids and end_id; null and empty texts are end_id alone. Documents of more than
    capacity tokens are cut into full windows, which are sequences of their own, and one rest. The
    rests are dealt by a hash into groups of about group_pieces, and each group is packed best-fit
    decreasing by one task, so memory and the padded share don't depend on the corpus. Within a
    group, equal lengths are ordered by id, then start. Rows that repeat an id, a text or both are dealt
    by their number in the table of pieces too, so they don't meet in one task. Repeated rows are documents of their own; an
    empty table gives no rows; other columns aren't read. sequence_id: group * 2**32 + its window.
    """
    pieces = written(cut_documents(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *pieces.schema.fields[5:]])
    arrow = to_arrow_schema(schema)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit_decreasing(table["length"].to_numpy(), capacity)
        columns = {c: table[c] for c in table.column_names} | {"sequence_id": pa.array(window + (key[0].as_py() << 32)), "offset": pa.array(offset)}
        return pa.table([columns[f.name] for f in arrow], schema=arrow)

    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(id_col, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(lambda key, table: pack(key, table.drop_columns("__group")), schema)
