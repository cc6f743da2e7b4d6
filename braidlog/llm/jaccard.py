"""N-gram Jaccard join: token-combination prefixes find candidates, whole sets verify them, links make components.

A document's set holds hashes of its word shingles. All sets are sorted by one order of tokens: rare
tokens first, by hash, then the tokens of a bounded table of frequent ones, by how frequent they are.
Two sets that link share a token among the first few of each; where frequent tokens come into these
prefixes, the prefixes are extended and pairs of frequent tokens are indexed instead of single ones.
Any order gives all links; the table only keeps lists short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import attach, bounded_batches, discard, flagged, tidied, without, written
from braidlog.llm.components import connected
from braidlog.llm.words import blocks_of, mix, words_of

_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Join:
    """words: of a shingle. percent: documents link from this Jaccard similarity on.

    frequent: tokens that the table of frequent tokens has at most. short: documents of a list up to
    which all its pairs are looked at once. run: rows of a list that one task takes; longer lists are
    dealt to several. block: rows of a list from which on it is cut, into at most
    `blocks`, of which each two meet at last. chunk: tokens that are
    counted together in the survey; one in `sampled` of those that a chunk holds once is counted too, for
    all of them. bytes: of texts that are hashed together. sketch: bits of a set's sketch.
    """

    words: int = 5
    percent: int = 80
    frequent: int = 1 << 20
    short: int = 24
    run: int = 20_000
    block: int = 4096
    blocks: int = 8
    chunk: int = 1 << 21
    sampled: int = 256
    bytes: int = 1 << 19
    sketch: int = 1024
    filter_bits: int = 1 << 24

    def needed(self, n: int) -> int:
        """Tokens that a set of n shares at least with any set that it links with."""
        return (self.percent * n + 99) // 100

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens that sets of a and of b tokens share at least if they link."""
        return -(-self.percent * (a.astype(np.int64) + b) // (100 + self.percent))

    def meet(self, n: np.ndarray, reach: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a and b of a list can be of sets that link: both must reach what sets of their sizes share at least.

        A row's reach is how much its set can still share if nothing before this place is shared.
        """
        least = self.least(n[a], n[b])
        return (reach[a] >= least) & (reach[b] >= least)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words are one shingle, no words none."""
    found = words_of(texts)
    found = found._replace(data=_LOWER[found.data])
    h, first = found.hashes(), found.first_of_text()
    n = max(0, len(h) - words + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(words):
        shingles += h[k : n + k] * _PLACE[k]
    shingles = mix(shingles)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(shingles[a : b - words + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(shingles[:0])
    return out


def _key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(tokens + np.uint64(1)).sum().astype(np.int64)), int((mix(tokens ^ _PLACE[2]) * _PLACE[3]).sum().astype(np.int64))


def _survey(docs: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """Rows of two kinds: doc, n, k1, k2 for each document, and token, count for tokens of a chunk of different sets.

    A token that a chunk holds once is given, with count 0, if a hash of chunk and token chooses it: a token that is spread so
    thinly that no chunk holds it twice still shows.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "n", "k1", "k2", "token", "count")])
    arrow = to_arrow_schema(schema)

    def table(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            drawn = mix(token + np.bitwise_xor.reduce(token)) % np.uint64(join.sampled) == 0
            given = (n > 1) | drawn
            return table(token=token[given].view(np.int64), count=np.where(n > 1, n, 0)[given])

        for batch in batches:
            for at, block in blocks_of(batch.column(1), join.bytes):
                sets = shingle_sets(block, join.words)
                keys = [_key(s) for s in sets]
                yield table(doc=batch.column(0).slice(at, len(block)).cast(pa.int64()), n=[len(s) for s in sets], k1=[k[0] for k in keys], k2=[k[1] for k in keys])
                for s, k in zip(sets, keys):
                    if k not in seen:
                        seen.add(k)
                        held.append(s)
                        size += len(s)
                if size >= join.chunk:
                    yield counted()
                    held, size, seen = [], 0, set()
        if size:
            yield counted()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidied(survey), schema)


def _placed(survey: DataFrame, total: int) -> DataFrame:
    """doc, n, rep for each row: the smallest document with an equal set; null for empty sets and rows without id."""
    rows = survey.filter("n IS NOT NULL").select("doc", "n", F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.struct("k1", "k2")).alias("key"))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return attach(rows, classes, "key", "copies", total, F.coalesce(F.col("doc"), F.lit(-1))).select("doc", "n", "rep")


def _frequent(surveyed: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and about how many sets hold them. At most join.frequent: a histogram of counts says from which count on they fit."""
    counts = surveyed.filter("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("n"), F.count(F.when(F.col("count") == 0, 1)).alias("drawn"))
    counts = counts.select("token", (F.col("n") + F.when(F.col("drawn") > 1, F.col("drawn") * join.sampled).otherwise(F.col("drawn"))).alias("n")).filter("n > 3")
    bands = sorted(((r["band"], r["tokens"]) for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("band")).agg(F.count(F.lit(1)).alias("tokens")).collect()), reverse=True)
    total, lowest = 0, None
    for band, tokens in bands:
        if total + tokens > join.frequent:
            break
        total, lowest = total + tokens, band
    if lowest is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.filter(F.floor(F.log2("n") * 8) >= lowest).toArrow()
    token, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


class Signatures:
    """What a set is indexed under."""

    def __init__(self, join: Join, token: np.ndarray, count: np.ndarray):
        self.join, self.token, self.count = join, token, count
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(token & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """How frequent each token is; 0 for rare ones."""
        out = np.zeros(len(tokens), np.int64)
        at = np.flatnonzero(self.maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(self.token):
            place = np.minimum(np.searchsorted(self.token, tokens[at]), len(self.token) - 1)
            hit = self.token[place] == tokens[at]
            out[at[hit]] = self.count[place[hit]]
        return out

    def of(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """signatures, how many documents each may have where that is known (else 0), and their reach.

        With needed(n) = a, the first n - a + 1 tokens of one of two sets that link hold a token of the
        other's. With n - a + 1 + g they share g + 1; of those that are frequent two then fall into one
        of g classes, if no rare one is shared. g depends on the size's power of two, and a set whose
        partners may be of the next power is indexed for both. Small sets are indexed by single tokens.
        If the first token that is shared stands at place i (from 0), n - i tokens can be; if it is the
        later of two among the first g + 1 shared, n - i + g.
        """
        n = len(tokens)
        prefix = n - self.join.needed(n) + 1
        rare = np.flatnonzero(counts == 0)
        if len(rare) >= prefix:
            return tokens[rare[:prefix]], np.zeros(prefix, np.int64), n - np.arange(prefix)
        often = np.flatnonzero(counts)
        often = often[np.lexsort((tokens[often], counts[often]))]
        level = n.bit_length() - 1
        sigs, sizes, reach = [tokens[rare]], [counts[rare]], [n - np.arange(len(rare))]
        single = 0
        for k in (level, level + 1):
            if k > level and n * 100 < self.join.percent << k:
                break
            classes = (1 << k) // 8 if k > 4 else 0
            taken = often[: max(0, prefix + classes - len(rare))]
            if not classes:
                single = max(single, len(taken))
                continue
            of = (mix(tokens[taken] ^ _PLACE[6]) % np.uint64(classes)).tolist()
            members: dict[int, list[int]] = {}
            for place, c in enumerate(of):
                members.setdefault(c, []).append(place)
            both = [p for m in members.values() for p in combinations(m, 2)]
            if both:
                a, b = np.array(both).T
                x, y = tokens[taken[a]], tokens[taken[b]]
                sigs.append(mix(np.minimum(x, y) * _PLACE[4] + np.maximum(x, y) * _PLACE[5] + np.uint64(k)))
                sizes.append(np.minimum(counts[taken[a]], counts[taken[b]]))
                reach.append(n - len(rare) - b + classes)
        sigs.append(tokens[often[:single]])
        sizes.append(counts[often[:single]])
        reach.append(n - len(rare) - np.arange(single))
        return np.concatenate(sigs), np.concatenate(sizes), np.minimum(np.concatenate(reach), n)


def _index(docs: DataFrame, join: Join, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """sig, salt, doc, n, reach: what each document (id, text) is indexed under. salt: the part of a long list, else -1."""
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("salt", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("reach", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(join, *sent.value)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for at, block in blocks_of(batch.column(1), join.bytes):
                sets = shingle_sets(block, join.words)
                counts = signatures.counts(np.concatenate(sets)) if sets else np.empty(0, np.int64)
                bounds = np.append(0, np.cumsum([len(s) for s in sets]))
                sigs, expected, docs_, sizes, reaches = [], [], [], [], []
                for k, s in enumerate(sets):
                    if not len(s) or not ids[at + k].is_valid:
                        continue
                    sig, often, reach = signatures.of(s, counts[bounds[k] : bounds[k + 1]])
                    sigs.append(sig), expected.append(often), reaches.append(reach)
                    docs_.append(np.full(len(sig), ids[at + k].as_py())), sizes.append(np.full(len(sig), len(s)))
                if not sigs:
                    continue
                doc, parts = np.concatenate(docs_), np.concatenate(expected) // join.run + 1
                salt = np.where(parts > 1, (mix(doc.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), -1)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.concatenate(sigs).view(np.int64), salt, doc, np.concatenate(sizes), np.concatenate(reaches)), arrow)], schema=arrow)

    return docs.mapInArrow(tidied(index), schema)


def _gathered(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(k).to_numpy() for b in held]) if held else np.empty(0, np.int64) for k in range(columns)]


def _once(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each pair of different documents once, the smaller first."""
    x, y = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
    return np.unique(np.stack([x, y], 1)[x < y], axis=0)


def _led(drawn: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row and of the row with the least draw in its run; runs lie together."""
    new = np.append(True, run[1:] != run[:-1])
    starts, of = np.flatnonzero(new), np.cumsum(new) - 1
    leader = np.flatnonzero(drawn == np.minimum.reduceat(drawn, starts)[of])
    leader = leader[np.append(True, of[leader][1:] != of[leader][:-1])]
    return np.arange(len(run)), leader[of]


def _lists(rows: DataFrame, join: Join, parts: int) -> DataFrame:
    """Pairs that may link (doc, mate), and the rows of long lists (sig, doc, n, reach).

    A list of at most join.short documents gives all its pairs. A longer one gives each document with
    the one that comes first by a hash, so the lists of a group of near copies mostly name the same
    pairs; its rows are given for what follows.
    """
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("reach", T.IntegerType()), T.StructField("mate", T.LongType())])
    arrow = to_arrow_schema(schema)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, salt, doc, n, reach = _gathered(batches, 5)
        if not len(sig):
            return
        order = np.argsort(sig, kind="stable")
        near = sig[order][1:] == sig[order][:-1]
        order = order[np.append(False, near) | np.append(near, False) | (salt[order] >= 0)]  # rows alone in their list go
        order = order[np.lexsort((doc[order], salt[order], sig[order]))]
        sig, salt, doc, n, reach = (x[order] for x in (sig, salt, doc, n, reach))
        if not len(sig):
            return
        run = np.cumsum(np.append(True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]))) - 1
        long = (np.bincount(run)[run] > join.short) | (salt >= 0)  # the rest of a dealt list is elsewhere
        pairs, at = [], np.flatnonzero(~long)
        for step in range(1, join.short):
            at = at[at + step < len(run)]
            at = at[run[at] == run[np.minimum(at + step, len(run) - 1)]]
            good = at[join.meet(n, reach, at, at + step)]
            pairs.append((good, good + step))
        at = np.flatnonzero(long)
        if len(at):
            a, b = (at[x] for x in _led(mix(doc[at].view(np.uint64)), run[at]))
            good = join.meet(n, reach, a, b)
            pairs.append((a[good], b[good]))
        both = _once(doc, *(np.concatenate(x) for x in zip(*pairs))) if pairs else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.nulls(len(both), pa.int32()), pa.nulls(len(both), pa.int32()), pa.array(both[:, 1])], schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(doc[at]), pa.array(n[at], pa.int32()), pa.array(reach[at], pa.int32()), pa.nulls(len(at), pa.int64())], schema=arrow)

    return rows.repartition(parts, "sig", "salt").mapInArrow(tidied(shared), schema)


def _drawn(rows: DataFrame, join: Join, parts: int) -> DataFrame:
    """Of rows (sig, doc, n, reach, comp, length): pairs (doc, mate) to look at, and the rows that may still link with another component.

    Each document of a list is paired with three that hashes of list and document choose. A row stays if its list has
    a row of another component that it can meet; where a list is dealt to several tasks all of its rows stay.
    """
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("reach", T.IntegerType()), T.StructField("mate", T.LongType())])
    arrow = to_arrow_schema(schema)

    def stays(n: np.ndarray, reach: np.ndarray, comp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n), bool)
        for at in range(0, len(n), 256):
            part = slice(at, at + 256)
            least = join.least(n[part, None], n)
            out[part] = ((reach[part, None] >= least) & (reach >= least) & (comp[part, None] != comp)).any(1)
        return out

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, salt, doc, n, reach, comp = _gathered(batches, 6)
        if not len(sig):
            return
        order = np.lexsort((doc, salt, sig))
        sig, salt, doc, n, reach, comp = (x[order] for x in (sig, salt, doc, n, reach, comp))
        run = np.cumsum(np.append(True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]))) - 1
        pairs = [_led(mix(doc.view(np.uint64) * _PLACE[k] + sig.view(np.uint64)), run) for k in (5, 6, 7)]
        a, b = (np.concatenate(x) for x in zip(*pairs))
        good = (comp[a] != comp[b]) & join.meet(n, reach, a, b)
        both = _once(doc, a[good], b[good])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.nulls(len(both), pa.int32()), pa.nulls(len(both), pa.int32()), pa.array(both[:, 1])], schema=arrow)
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])).tolist()
        keep = [salt[a] >= 0 or stays(n[a:b], reach[a:b], comp[a:b]) for a, b in zip(starts, [*starts[1:], len(run)])]
        at = np.flatnonzero(np.concatenate([np.broadcast_to(k, b - a) for k, a, b in zip(keep, starts, [*starts[1:], len(run)])]))
        yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(doc[at]), pa.array(n[at], pa.int32()), pa.array(reach[at], pa.int32()), pa.nulls(len(at), pa.int64())], schema=arrow)

    parted = F.ceil(F.col("length") / join.run).cast("int")
    salt = F.when(parted > 1, F.pmod(F.xxhash64("doc"), parted).cast("int")).otherwise(-1)
    return rows.select("sig", salt.alias("salt"), "doc", "n", "reach", "comp").repartition(parts, "sig", "salt").mapInArrow(tidied(draw), schema)


def _sets(docs: DataFrame, id_col: str, text_col: str, join: Join, wanted: DataFrame) -> DataFrame:
    """doc, n, sketch, text of the documents in wanted, and of few others. A text is smaller than its set's hashes, and packs better.

    A sketch's bits say of each residue of tokens whether the set has an odd number of it; those in which two sketches
    differ are at most the tokens in which the sets do.
    """
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in blocks_of(batch.column(1), join.bytes):
                found = shingle_sets(block, join.words)
                odd = [np.packbits(np.bincount((s % np.uint64(join.sketch)).astype(np.int64), minlength=join.sketch) & 1 == 1) for s in found]
                columns = batch.column(0).slice(k, len(block)), [len(s) for s in found], [x.view(np.int64) for x in odd], block
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    rows = flagged(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), F.col("doc"), wanted, join.filter_bits)
    return rows.filter("__hit").select("doc", "text").mapInArrow(tidied(sets), schema)


def _links(left: np.ndarray, right: np.ndarray, join: Join) -> bool:
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    met = int((both[1:] == both[:-1]).sum())
    return met > 0 and 100 * met >= join.percent * (len(both) - met)


def _near(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The distinct pairs whose sketches don't differ in more bits than the tokens in which linked sets of their sizes do."""
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}"))
    differ = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda sum_, x: sum_ + x)
    both = F.col("n_a") + F.col("n_b")
    least = F.ceil(F.lit(join.percent) * both / (100 + join.percent))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(differ <= both - 2 * least).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """a, b of the pairs whose sets link, as a table; sets in no pair that sketches leave aren't shuffled."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A document that leads many lists is in many pairs of a batch; its set is made once.
            ids = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            _, first, of = np.unique(ids, return_index=True, return_inverse=True)
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first))
            sets = [s for _, block in blocks_of(texts, join.bytes) for s in shingle_sets(block, join.words)]
            keep = pa.array([_links(sets[x], sets[y], join) for x, y in zip(of[: batch.num_rows], of[batch.num_rows :])], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=arrow)

    # Without an aggregate on top, Spark can split the join's part of a document that leads many lists.
    pairs = written(_near(pairs, sets, join), "pairs")
    here = flagged(sets.select("doc", "text"), F.col("doc"), pairs.select(F.explode(F.array("a", "b")).alias("doc")), join.filter_bits).filter("__hit")
    one = here.select(F.col("doc").alias("a"), F.col("text").alias("left"))
    two = here.select(F.col("doc").alias("b"), F.col("text").alias("right"))
    out = written(pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(tidied(verify), schema).distinct(), "links")
    discard(pairs)
    return out


def _dealt(rows: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """rows of lists (sig, doc, n, reach, comp, length) with their sketches, for each class of sizes and each two blocks that they are in."""
    blocks = F.least(F.lit(join.blocks), F.greatest(F.lit(1), F.ceil(F.col("length") / join.block))).cast("int")
    span = math.log(100 / join.percent)
    rows = rows.withColumn("kind", F.explode(F.array(*[(F.floor(F.log(F.col("n")) / span + 1e-9) - k).cast("int") for k in (0, 1)])))
    # Rows that are alone with their class, or all of one component there, have no pair.
    met = rows.groupBy("sig", "kind").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("many")).filter("low < high").select("sig", "kind", "many")
    rows = rows.drop("length").join(met.withColumnRenamed("many", "length"), ["sig", "kind"]).join(sets.select("doc", "sketch"), "doc")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("sig", "kind", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "doc", "n", "reach", "comp", "sketch")


def _crossed(rows: DataFrame, sets: DataFrame, join: Join, parts: int) -> DataFrame:
    """a, b: the pairs of a list, of different components, that may link.

    rows: sig, doc, n, reach, comp, length. Sets that link are of one class of sizes or of two that follow each other
    (a class spans the ratio that links span), so a row comes with its own class and the one below. A long list is cut
    into blocks, `blocks` at most, and each two blocks meet in a task; so rows are copied twice `blocks` times at most,
    however long the list is, and what grows with its square is tests inside tasks. Pairs must reach what sets of their
    sizes share, and their sketches differ no more than linked sets do, so few are left.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sig, kind, one, two, own, doc, n, reach, comp = _gathered(iter(held), 9)
        sketch = np.concatenate([b.column(9).flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1) for b in held])
        order = np.lexsort((doc, two, one, kind, sig))
        sig, kind, one, two, own, doc, n, reach, comp, sketch = (x[order] for x in (sig, kind, one, two, own, doc, n, reach, comp, sketch))
        new = (sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.flatnonzero(np.append(True, new)).tolist()
        found = [np.empty((0, 2), np.int64)]
        for first, end in zip(starts, [*starts[1:], len(sig)]):
            for at in range(first, end, 64):
                x, y = np.arange(at, min(at + 64, end)), np.arange(at + 1, end)
                least = join.least(n[x, None], n[y])
                good = (y > x[:, None]) & (comp[x, None] != comp[y]) & (reach[x, None] >= least) & (reach[y] >= least)
                if one[first] != two[first]:
                    good &= own[x, None] != own[y]
                a, b = np.nonzero(good)
                few, a, b = least[a, b], x[a], y[b]
                differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
                good = differ <= n[a].astype(np.int64) + n[b] - 2 * few
                found.append(_once(doc, a[good], b[good]))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow)

    return _dealt(rows, sets, join).repartition(parts, "sig", "kind", "one", "two").mapInArrow(tidied(cross), schema)


def _labels(links: DataFrame, total: int) -> DataFrame:
    """doc, label: the smallest document within two links. Documents of one label are in one component; a component may have several."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"), F.count(F.lit(1)).alias("links"))
    of = attach(both, near.withColumnRenamed("a", "b"), "b", "links", 2 * total, F.col("a"))
    return of.groupBy(F.col("a").alias("node")).agg(F.min("least").alias("component"))


def _mixed(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with comp and the list's length."""
    placed = lists.join(joined, F.col("doc") == F.col("node"), "left").select("sig", "doc", "n", "reach", F.coalesce("component", "doc").alias("comp"))
    still = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("length")).filter("low < high").select("sig", "length")
    return placed.join(still, "sig")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """id, n_shingles, component_id for each row: the size of its set and the smallest id that links lead to.

    Documents link when percent / 100 of their sets' union is shared. Ids are whole numbers and keys:
    rows that repeat one share its component. A null or empty text has an empty set and links with
    nothing; a text of fewer words than a shingle has one shingle, the whole sequence. A row without id
    has no component. An empty table gives no rows; other columns aren't read. A very long text is one
    set, which one task holds. Tokens are 64-bit hashes of shingles.

    Of documents with equal sets only the smallest is indexed. All links between components are found, but not all
    within one are listed: a list's documents are first compared with few of it, which gives components, and then
    with those that are in other components.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")
    bounded_batches(docs.sparkSession)
    survey = written(_survey(docs, id_col, text_col, join), "survey")
    rows, tokens = survey.filter("n IS NOT NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // 2_000_000)
    placed = written(_placed(survey, rows), "placed")
    frequent = _frequent(survey, join)
    discard(survey)
    of_doc = placed.filter("rep IS NOT NULL").groupBy("doc").agg(F.max(F.col("doc") == F.col("rep")).alias("leads"), F.min("rep").alias("rep"), F.max("rep").alias("last"))
    singles = without(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", of_doc.filter("NOT leads").select("doc"))
    found = written(_lists(_index(singles, join, frequent), join, parts), "lists")
    del frequent
    pairs = lambda df: df.filter("mate IS NOT NULL").select(F.col("doc").alias("a"), F.col("mate").alias("b"))
    lists = lambda df: df.filter("sig IS NOT NULL").select("sig", "doc", "n", "reach")
    edges = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sets = written(_sets(docs, id_col, text_col, join, found.select(F.explode(F.array("doc", "mate")).alias("doc")).filter("doc IS NOT NULL")), "sets")
    links = _verified(pairs(found), sets, join)
    # Lists that lie in one component are done. The others are compared by a few pairs for each document, then whole.
    drawn = written(_drawn(_mixed(lists(found), _labels(links, rows)), join, parts), "drawn")
    discard(found)
    more = _verified(pairs(drawn), sets, join)
    # An id whose rows have different sets joins their classes.
    repeated = placed.join(of_doc.filter("rep < last").select("doc", F.col("rep").alias("v")), "doc").filter("rep <> v").select(F.col("rep").alias("u"), "v")
    joined = connected(edges(links).unionByName(edges(more)).unionByName(repeated))
    last = _verified(_crossed(_mixed(lists(drawn), joined), sets, join, parts), sets, join)
    discard(drawn, sets, links, more)
    # The last links join components; so few nodes are left that this is quick.
    name = lambda df, c: df.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c, "left").withColumn(c, F.coalesce(f"{c}_of", c)).drop(f"{c}_of")
    again = connected(name(name(edges(last), "u"), "v"))
    classes = placed.filter("rep IS NOT NULL").groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    classes = classes.join(joined, F.col("rep") == F.col("node"), "left").select("rep", "copies", F.coalesce("component", "rep").alias("first"))
    classes = classes.join(again, F.col("first") == F.col("node"), "left").select("rep", "copies", F.coalesce("component", "first").alias("component"))
    out = attach(placed, classes, "rep", "copies", rows, F.coalesce(F.col("doc"), F.lit(-1)))
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).cast(kind).alias("component_id"))
