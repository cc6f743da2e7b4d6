"""Byte-level BPE: frequent words go through a minimal acyclic transducer, all others through exact merges."""

from __future__ import annotations

import heapq
import mmap
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import bounded_batches, tidied
from braidlog.llm.tokenizer import Vocabulary

# Unicode's white space, as the split pattern of byte-level BPE means it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: In texts of ASCII and these letters alone, the standard module's classes are exact and faster.
_PLAIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


def _split_pattern(letter: str, number: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


#: Above all ranks.
_NONE = 1 << 60


class Splitter:
    """Cuts texts into special tokens and the words whose bytes are merged."""

    def __init__(self, special: Iterable[str] = ()):
        import regex

        self.whole = regex.compile(_split_pattern(r"\p{L}", r"\p{N}"))
        self.plain = re.compile(_split_pattern(_PLAIN, "0-9"))
        self.other = re.compile(rf"[^\x00-\x7f{_PLAIN}]")
        marks = sorted(special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    def words(self, text: str) -> list[str]:
        return (self.whole if self.other.search(text) else self.plain).findall(text)

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(whether special, words) in order."""
        if self.special is None or not self.special.search(text):
            yield False, self.words(text)
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield (True, [part]) if k % 2 else (False, self.words(part))


class Merger:
    """Exact BPE of one word: the pair of lowest rank is merged first, of equal ones the leftmost."""

    def __init__(self, vocabulary: Vocabulary):
        self.n = len(vocabulary.bytes_of)
        self.of = {a * self.n + b: found for (a, b), found in vocabulary.merges.items()}
        self.byte = [vocabulary.id_of[bytes([b])] for b in range(256)]
        keys = np.array(sorted(self.of), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.found = np.array([self.of[k] for k in keys.tolist()] + [(_NONE, 0)], np.int64)

    def many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. Short words are merged together, a step of all at a time."""
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= 32]
        for k in set(range(len(words))) - set(short):
            out[k] = self.ids(words[k])
        short.sort(key=lambda k: len(words[k]))
        for a in range(0, len(short), 4096):  # words of like lengths, so little is padding
            part = short[a : a + 4096]
            for k, ids in zip(part, self._together([words[k] for k in part])):
                out[k] = ids
        return out

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank and merged id of pairs; pairs past a word's end and pairs that never merge have the rank _NONE."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit[..., None], self.found[at], (_NONE, 0))

    def _together(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(sizes.max()) + 1
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < sizes[:, None]] = np.array(self.byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        pairs = self._looked_up(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        column = np.arange(width)
        while len(live):
            ranks = pairs[live, :, 0]
            at = ranks.argmin(1)  # of equal ranks the leftmost
            going = ranks[np.arange(len(live)), at] < _NONE
            live, at = live[going], at[going]
            if not len(live):
                break
            ids[live, at] = pairs[live, at, 1]
            after = np.minimum(column + (column > at[:, None]), width - 1)  # what follows moves up by one
            ids[live] = np.take_along_axis(ids[live], after, 1)
            ids[live, -1] = -1
            after = np.minimum(column[:-1] + (column[:-1] >= at[:, None]), width - 2)
            pairs[live] = np.take_along_axis(pairs[live], after[:, :, None], 1)
            pairs[live, -1] = (_NONE, 0)
            pairs[live, at] = self._looked_up(ids[live, at], ids[live, np.minimum(at + 1, width - 1)])
            before = at > 0
            rows, left = live[before], at[before] - 1
            pairs[rows, left] = self._looked_up(ids[rows, left], ids[rows, left + 1])
        flat, ends = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def ids(self, word: bytes) -> list[int]:
        ids = [self.byte[b] for b in word]
        return self._short(ids) if len(ids) <= 64 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, n, none = self.of.get, self.n, (_NONE, 0)
        found = [get(a * n + b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = get(ids[k - 1] * n + ids[k], none)
            if k < len(found):
                found[k] = get(ids[k] * n + ids[k + 1], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        get, n, size = self.of.get, self.n, len(ids)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(size - 1) if (found := get(ids[k] * n + ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= size or ids[right] != b:
                continue
            ids[k], ids[right] = made, -1
            after[k] = after[right]
            if after[k] < size:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < size and (found := get(ids[x] * n + ids[y])):
                    heapq.heappush(heap, (found[0], x, ids[x], ids[y], found[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Words to their ids in a minimal acyclic automaton.

    States with equal futures are one state, so words share suffixes as well as prefixes. Each arc
    carries how many words come before those that it leads to; summed along a word's path that is the
    word's number in order, which leads to its ids. Everything is flat arrays in one file, which readers
    map into memory.
    """

    PARTS = (("keys", "<i8"), ("targets", "<i4"), ("before", "<i4"), ("final", "<i4"), ("at", "<i8"), ("ids", "<i4"))

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<i8", len(self.PARTS))
        offset = head.nbytes
        for (name, kind), count in zip(self.PARTS, head.tolist()):
            setattr(self, name, np.frombuffer(buffer, kind, count, offset))
            offset += -(-count * np.dtype(kind).itemsize // 8) * 8
        self.buffer = buffer

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        """The file's content. Words are added in order; what follows the prefix shared with the next word is final and is merged with an equal state."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []  # of each finished state: (byte, target) pairs
        finals: list[bool] = []
        path: list[list] = [[False, []]]  # open states along the last word: [final, arcs]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                key = (final, *out)
                if key not in register:
                    register[key] = len(arcs)
                    arcs.append(tuple(out))
                    finals.append(final)
                byte = path[-1][1].pop()[0]
                path[-1][1].append((byte, register[key]))

        last = b""
        for word in order:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            close(shared)
            for b in word[shared:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        root = len(arcs)
        arcs.append(tuple(path[0][1]))
        finals.append(path[0][0])
        below = [0] * len(arcs)  # words that can be read from a state; a state's targets are finished before it
        keys, targets, before = [], [], []
        for s, out in enumerate(arcs):
            below[s] = int(finals[s])
            for b, t in out:
                keys.append(s << 8 | b), targets.append(t), before.append(below[s])
                below[s] += below[t]
        ids = [words[w] for w in order]
        at = np.append(0, np.cumsum([len(x) for x in ids])) if ids else np.zeros(1)
        parts = (keys, targets, before, [*map(int, finals), root], at, [i for x in ids for i in x])
        arrays = [np.asarray(x, kind) for x, (_, kind) in zip(parts, cls.PARTS)]
        blob = np.array([len(a) for a in arrays], "<i8").tobytes()
        return blob + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, content: bytes) -> Transducer:
        """The content as a file in this process's temporary folder, mapped; the name goes at once, so nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1. All words take a step together."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        out, state, live = np.zeros(n, np.int64), np.full(n, int(self.final[-1]), np.int64), np.arange(n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        for k in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > k]
            if not len(live):
                break
            key = state[live] << 8 | flat[starts[live] + k]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(live), bool)
            out[live[~hit]] = -1
            live, at = live[hit], at[hit]
            out[live] += self.before[at]
            state[live] = self.targets[at]
        ended = out >= 0
        out[ended & (self.final[state] == 0)] = -1
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.at[number] : self.at[number + 1]]


class Codes(dict):
    """Words numbered as they are first asked for; new holds those that haven't been learned."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class Encoder:
    """Texts to ids: words seen lately from a bounded memo, others through the transducer, unseen ones through merges."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer, memo: int = 1 << 18):
        self.splitter, self.merger, self.special = Splitter(vocabulary.special), Merger(vocabulary), vocabulary.special
        self.transducer, self.most = transducer, memo
        self._forget()

    def _forget(self) -> None:
        self.code = Codes()
        self.at, self.ids = array("q", [0]), array("I")

    def _learn(self) -> None:
        words, self.code.new = self.code.new, []
        raw = [w.encode() for w in words]
        numbers = self.transducer.numbers(raw).tolist()
        merged = iter(self.merger.many([data for data, number in zip(raw, numbers) if number < 0]))
        for number in numbers:
            self.ids.extend(next(merged) if number < 0 else self.transducer.ids_of(number).tolist())
            self.at.append(len(self.ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.code) > self.most:
            self._forget()
        words: list[str] = []
        ends, marks = [], []
        for text in texts:
            for special, part in self.splitter.parts(text):
                if special:
                    marks.append(len(words))
                words += part
            ends.append(len(words))
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        self._learn()
        at, ids = np.frombuffer(self.at, np.int64), np.frombuffer(self.ids, np.uint32) if self.ids else np.empty(0, np.uint32)
        sizes = (at[1:] - at[:-1])[codes]
        first = at[:-1][codes]
        if marks:  # a special token is one id after those of the words; the memo's entry for its string is of the string as a word
            ids = np.append(ids, np.array([self.special[words[k]] for k in marks], np.uint32))
            sizes[marks], first[marks] = 1, len(ids) - len(marks) + np.arange(len(marks))
        stops = np.cumsum(sizes)
        flat = ids[np.repeat(first - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.append(0, stops)[np.append(0, ends)]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


def _blocks(texts: Iterable[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about most characters, so that memory doesn't follow the batch."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def frequent_words(docs: DataFrame, tokenizer: str, text_col: str = "text", lexicon: int = 1 << 16, longest: int = 64) -> list[str]:
    """The words that all texts hold most often, lexicon of them at most, of at most longest characters, which bounds what the driver gets.

    Words that a block of texts holds once aren't counted there. Words that are left out are merged when they come.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for block in _blocks(x.as_py() or "" for x in batch.column(0)):
                found: Counter = Counter()
                for text in block:
                    found.update(splitter.words(text))
                often = {w: n for w, n in found.items() if n > 1 and len(w) <= longest}
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(often), pa.string()), "n": pa.array(list(often.values()), pa.int64())})

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(lexicon).collect()]


def compile_lexicon(words: Iterable[str], tokenizer: str) -> bytes:
    merger = Merger(Vocabulary(tokenizer))
    raw = [w.encode() for w in words]
    return Transducer.compile(dict(zip(raw, merger.many(raw))))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon: bytes | None = None) -> DataFrame:
    """id, n_tokens, ids (binary, little-endian unsigned 32-bit) of each row's whole text.

    The ids are those of the tokenizers library without added tokens, truncation or padding: a special
    token's string in a text is that token. Null and empty texts have no ids. Repeated rows are encoded
    alike; an empty table gives no rows; other columns aren't read. lexicon: of compile_lexicon; by
    default that of the most frequent words of all texts. It is 65,536 words at most, about 2 MB, and is
    broadcast and mapped into memory by the workers.
    """
    bounded_batches(docs.sparkSession)
    if lexicon is None:
        lexicon = compile_lexicon(frequent_words(docs, tokenizer, text_col), tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(tokenizer), Transducer.mapped(sent.value))
        for batch in batches:
            at = 0
            for block in _blocks(x.as_py() or "" for x in batch.column(1)):
                found = encoder.encode(block)
                columns = [batch.column(0).slice(at, len(block)), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())]
                at += len(block)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidied(encode), schema)


def decode_documents(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded without ids_col, and with the text that its ids stand for, special tokens too. Bytes that aren't UTF-8 become U+FFFD; null ids are an empty text."""
    bounded_batches(encoded.sparkSession)
    keep = [c for c in encoded.columns if c not in (ids_col, text_col)]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(text_col, T.StringType())])
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = Vocabulary(tokenizer).bytes_of.__getitem__
        for batch in batches:
            texts = [b"".join(map(piece, np.frombuffer(x.as_py() or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch.column(len(keep))]
            columns = [*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return encoded.select(*keep, F.col(ids_col)).mapInArrow(tidied(decode), schema)
