"""Packing documents into token windows by local search: documents are exchanged between windows until windows empty."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import written
from braidlog.llm.packing import best_fit_decreasing, cut_documents

#: Sequence numbers of whole windows begin here; those of others hold round, group and window.
_WHOLE = 1 << 62


class Exchange:
    """Windows of a group of pieces, and what each underfull one could give: one piece, two pieces or nothing (for a move).

    The emptiest window gives pieces to a fuller one and takes less back: one for none, one for one, two
    for one or one for two. What it passes on must fit the other's gap. So the sum of squared fills grows
    with each exchange, and the search ends at the fewest windows that lengths allow, where no window has
    an exchange left, or where many exchanges have emptied none. Pieces of one length in a window stand for each other, so a window offers few pairs.
    """

    def __init__(self, lengths: np.ndarray, window: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.held: list[list[int]] = [[] for _ in range(int(window.max()) + 1)]
        for piece, w in enumerate(window.tolist()):
            self.held[w].append(piece)
        self.fill = np.bincount(window, self.lengths, len(self.held)).astype(np.int64)
        self.least = -(-int(self.lengths.sum()) // capacity)
        self.span: dict[int, tuple[int, int]] = {}
        self.given = np.empty((4, 1024), np.int64)  # of each offer: length, window, its pieces (-1: none)
        self.used = 0
        for w in range(len(self.held)):
            self._offer(w)

    def _distinct(self, window: int) -> list[tuple[int, int]]:
        """length, piece; once a length, or twice where two pieces have it."""
        seen: dict[int, int] = {}
        out = []
        for piece in self.held[window]:
            n = int(self.lengths[piece])
            if seen.setdefault(n, 0) < 2:
                seen[n] += 1
                out.append((n, piece))
        return out

    def _choices(self, window: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Single pieces and pairs: length, piece, other piece."""
        own = self._distinct(window)
        pairs = {a[0] + b[0]: (a[0] + b[0], a[1], b[1]) for a, b in combinations(own, 2)}
        return list({n: (n, p, -1) for n, p in own}.values()), list(pairs.values())

    def _offer(self, window: int) -> None:
        if window in self.span:
            a, b = self.span.pop(window)
            self.given[1, a:b] = -1
        if not self.held[window] or self.fill[window] == self.capacity:
            return
        single, pairs = self._choices(window)
        rows = np.array([(0, -1, -1), *single, *pairs], np.int64).T
        if self.used + rows.shape[1] > self.given.shape[1]:
            live = self.given[:, : self.used][:, self.given[1, : self.used] >= 0]
            self.given = np.concatenate([live, np.empty((4, live.shape[1] + 4 * rows.shape[1] + 1024), np.int64)], 1)
            self.used = live.shape[1]
            starts = np.flatnonzero(np.append(True, live[1, 1:] != live[1, :-1])) if self.used else np.empty(0, np.int64)
            self.span = {int(live[1, a]): (int(a), int(b)) for a, b in zip(starts, [*starts[1:], self.used])}
        a, b = self.used, self.used + rows.shape[1]
        self.given[0, a:b], self.given[1, a:b], self.given[2:, a:b] = rows[0], window, rows[1:]
        self.span[window], self.used = (a, b), b

    def _best(self, source: int) -> tuple[tuple[int, ...], int, tuple[int, ...]] | None:
        """Pieces that source gives, to which window, and what it takes, so that squared fill grows most; None if it can't grow."""
        given = self.given[:, : self.used]
        target = given[1]
        open_ = np.flatnonzero((target >= 0) & (target != source))
        open_ = open_[self.fill[target[open_]] >= self.fill[source]]
        if not len(open_):
            return None
        back, at = given[0, open_], target[open_]
        gap = self.capacity - self.fill[at]
        taken = (given[2, open_] >= 0).astype(int) + (given[3, open_] >= 0)
        best, found = 0, None
        for kind, own in enumerate(self._choices(source), 1):
            if not own:
                continue
            own.sort()
            sizes = np.array([o[0] for o in own], np.int64)
            place = np.searchsorted(sizes, back + gap, "right") - 1
            passed = np.where(place >= 0, sizes[place] - back, 0)
            ok = (passed > 0) & (taken > 0 if kind == 2 else True) & (taken + kind < 4)
            grown = np.where(ok, 2 * passed * (self.fill[at] - self.fill[source]) + 2 * passed * passed, 0)
            k = int(grown.argmax())
            if grown[k] > best:
                best = int(grown[k])
                takes = tuple(p for p in given[2:, open_[k]].tolist() if p >= 0)
                found = tuple(p for p in own[int(place[k])][1:] if p >= 0), int(at[k]), takes
        return found

    def _swap(self, source: int, gives: tuple[int, ...], target: int, takes: tuple[int, ...]) -> None:
        for a, b, pieces in ((source, target, gives), (target, source, takes)):
            for p in pieces:
                self.held[a].remove(p)
                self.held[b].append(p)
                self.fill[a] -= self.lengths[p]
                self.fill[b] += self.lengths[p]
        self._offer(source)
        self._offer(target)

    def search(self, patience: int = 512) -> int:
        """Exchanges until there are as few windows as lengths allow, none has an exchange left, or so many tries emptied no window; how many were made."""
        made, tries, windows = 0, 0, sum(map(bool, self.held))
        none = np.iinfo(np.int64).max
        stuck = self.fill == self.capacity
        while windows > self.least and tries < patience:
            source = int(np.where(stuck | (self.fill == 0), none, self.fill).argmin())
            if stuck[source] or not self.held[source]:
                break
            tries += 1
            if found := self._best(source):
                self._swap(source, *found)
                made += 1
                stuck = self.fill == self.capacity
                if not self.held[source]:
                    windows, tries = windows - 1, 0
            else:
                stuck[source] = True
        return made

    def placed(self) -> tuple[np.ndarray, np.ndarray]:
        """window and offset of each piece."""
        window, offset = np.empty(len(self.lengths), np.int64), np.empty(len(self.lengths), np.int64)
        for w, pieces in enumerate(self.held):
            at = 0
            for p in pieces:
                window[p], offset[p] = w, at
                at += int(self.lengths[p])
        return window, offset


def exchanged(lengths: np.ndarray, capacity: int) -> Exchange:
    """Best-fit decreasing, then the search; lengths must come in descending order and be at most capacity."""
    out = Exchange(lengths, best_fit_decreasing(lengths, capacity)[0], capacity)
    out.search()
    return out


def _round(pieces: DataFrame, number: int, groups: int, capacity: int, again: int) -> DataFrame:
    """pieces with sequence_id, offset and open: whether the next round packs the piece once more."""
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    order = [f.name for f in pieces.schema.fields if not isinstance(f.dataType, T.ArrayType) and f.name != "length"]

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns("__group").sort_by([("length", "descending"), *((c, "ascending") for c in order)])
        found = exchanged(table["length"].to_numpy(), capacity)
        window, offset = found.placed()
        ends = np.zeros(len(found.held), bool)
        left = again if groups > 1 else 0
        for w in sorted((w for w, p in enumerate(found.held) if p and found.fill[w] < capacity), key=lambda w: found.fill[w]):
            left -= len(found.held[w])
            if left < 0:
                break
            ends[w] = True
        columns = {"sequence_id": pa.array(window + (key[0].as_py() << 24) + (number << 54)), "offset": pa.array(offset), "open": pa.array(ends[window])}
        return pa.table([columns.get(f.name) if f.name in columns else table[f.name] for f in arrow], schema=arrow)

    # Rows that repeat a piece are told apart by their number in the table, so they don't meet in one group.
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*order[:4], F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(pack, schema)


def pack_by_exchange(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False, group_pieces: int = 8192) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A document is its ids and end_id; null and empty texts are end_id alone. Documents of more than
    capacity tokens are cut into pieces of capacity tokens, the first of what is left over; whole pieces
    are sequences of their own. The others are dealt by a hash into groups of about group_pieces, and
    each group is packed by one task: best-fit decreasing to begin with, then exchanges between underfull
    windows (see Exchange). A group's emptiest windows, of a sixteenth of its pieces at most, are packed
    once more with those of other groups, and so on until one group is left, so what groups leave unfilled
    doesn't grow with their number. A task holds one group, whatever the corpus.

    Repeated rows are documents of their own, null ids too; ties are ordered by id, start and checksum. An
    empty table gives no rows; other columns aren't read. Groups depend on the layout of the table of pieces,
    so sequence numbers do; they have gaps. A very long text is encoded by one task.
    """
    cut = cut_documents(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids, short_first=True).drop("doc_tokens")
    cut = written(cut.withColumn("piece", F.ceil(F.col("start") / capacity).cast("int")), "pieces")
    out = [cut.filter(F.col("length") == capacity).withColumns({"sequence_id": F.lit(_WHOLE) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    rest, number = cut.filter(F.col("length") < capacity), 0
    while left := rest.count():
        groups = -(-left // group_pieces)
        packed = written(_round(rest, number, groups, capacity, group_pieces // 16), "packed")
        out.append(packed.filter("NOT open").drop("open"))
        rest, number = packed.filter("open").drop("sequence_id", "offset", "open"), number + 1
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
