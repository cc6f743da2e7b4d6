"""Quality: attention-based multiple-instance learning over the passages of a document, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import bounded_batches, tidied
from braidlog.llm.toxicity import Adam, fit_logistic
from braidlog.llm.words import _SPACE, blocks_of, words_of

#: Kinds of bytes: lower case, upper case, digit, space, line end, sentence mark, other mark, byte of a longer character.
KINDS = 8
_KIND = np.full(256, 6, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[0x09, 0x20]] = 3
_KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KIND[128:] = 7


@dataclass(frozen=True)
class Shape:
    """A passage is this many words; its inputs are shares of triples of byte kinds and word statistics."""

    passage_words: int = 40
    encoded: int = 24
    gate: int = 12


@dataclass(frozen=True)
class Training:
    """sample: labelled rows that the fit takes at most, half of them of each label where there are enough."""

    sample: int = 6000
    epochs: int = 30
    batch: int = 64
    rate: float = 0.004
    decay: float = 1e-4
    seed: int = 11


STATISTICS = 6
#: Bytes from which a text is read in runs.
LONG = 1 << 20


def passage_inputs(texts: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """A row of inputs for each passage of each text, and the text of each passage. A text without words is one passage of zeros."""
    words = words_of(texts)
    first = words.first_of_text()
    size = np.diff(first)
    count = np.maximum(1, -(-size // shape.passage_words))
    starts = np.cumsum(count) - count
    of = np.repeat(np.arange(len(size)), count)
    n = len(of)
    word_of = starts[words.text] + (np.arange(len(words.start)) - first[words.text]) // shape.passage_words
    length = (words.end - words.start).astype(np.float32)
    total = np.maximum(np.bincount(word_of, minlength=n), 1)[:, None]
    # Bytes belong to the passage of the word that begins at or before them, up to the end of its text.
    to = np.minimum(np.append(words.start[1:], len(words.data)), words.ends[words.text])
    spans = to - words.start
    at = np.repeat(words.start - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    data, owner, text = _KIND[words.data[at]].astype(np.int64), np.repeat(word_of, spans), np.repeat(words.text, spans)
    inside = text[:-2] == text[2:] if len(data) > 2 else np.empty(0, bool)
    triple = (data[:-2] * KINDS**2 + data[1:-1] * KINDS + data[2:])[inside] if len(data) > 2 else np.empty(0, np.int64)
    owner = owner[:-2][inside] if len(data) > 2 else owner[:0]
    shares = np.bincount(owner * KINDS**3 + triple, minlength=n * KINDS**3).reshape(n, -1).astype(np.float32)
    shares = np.sqrt(shares / np.maximum(shares.sum(1, keepdims=True), 1))
    key = words.hashes()
    again = np.append(False, (key[1:] == key[:-1]) & (word_of[1:] == word_of[:-1]))
    order = np.lexsort((key, word_of))
    fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (word_of[order][1:] != word_of[order][:-1]))[: len(key)]
    fewer = np.bincount(word_of[order], weights=fresh, minlength=n)[:, None]
    upper = np.bincount(word_of, weights=_KIND[words.data[words.start]] == 1, minlength=n)[:, None]
    ends = np.bincount(word_of, weights=_KIND[words.data[words.end - 1]] == 6, minlength=n)[:, None]
    stats = np.concatenate([
        np.bincount(word_of, weights=length, minlength=n)[:, None] / total / 10,
        fewer / total,
        np.bincount(word_of, weights=again, minlength=n)[:, None] / total,
        upper / total,
        ends / total,
        np.minimum(total, shape.passage_words) / shape.passage_words,
    ], 1)
    stats[np.bincount(word_of, minlength=n) == 0] = 0
    return np.concatenate([shares, stats], 1).astype(np.float32), of


def pieces(data: np.ndarray, passage_words: int, size: int) -> Iterator[tuple[int, int]]:
    """From and to of runs of whole passages of a text's bytes, of about size each; a passage that is longer is a run by itself."""
    at = 0
    while len(data) - at > size:
        span, whole = size, 0
        while True:
            begins = ~_SPACE[data[at : at + span]]
            begins[1:] &= _SPACE[data[at : at + span - 1]][: len(begins) - 1]
            begin = np.flatnonzero(begins)
            whole = (len(begin) - 1) // passage_words * passage_words
            if whole > 0 or at + span >= len(data):
                break
            span *= 2
        if whole <= 0:
            break
        yield at, at + int(begin[whole])
        at += int(begin[whole])
    yield at, len(data)


def passage_runs(data: np.ndarray, shape: Shape, size: int = 1 << 18) -> Iterator[np.ndarray]:
    """The inputs of one text's passages, a run at a time."""
    for at, to in pieces(data, shape.passage_words, size):
        piece = data[at : to + 2]  # the triples of bytes that begin in a run may end after it
        text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(piece)], np.int64)), pa.py_buffer(piece)])
        rows, _ = passage_inputs(text, shape)
        yield rows[:-1] if to < len(data) else rows  # without the word that these two bytes begin


def inputs_in_runs(texts: pa.Array, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """passage_inputs of texts in order; those of more than LONG bytes a run at a time."""
    sizes, at = np.asarray(pa.compute.binary_length(texts).fill_null(0)), 0
    for k in [*np.flatnonzero(sizes > LONG).tolist(), len(texts)]:
        if k > at:
            rows, of = passage_inputs(texts.slice(at, k - at), shape)
            yield rows, of + at
        if k < len(texts):
            for rows in passage_runs(np.frombuffer(texts[k].as_buffer(), np.uint8), shape):
                yield rows, np.full(len(rows), k)
        at = k + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Passages are encoded; gated attention weighs them; the weighted sum is scored."""

    def __init__(self, shape: Shape, seed: int):
        rng = np.random.default_rng(seed)
        d, h, g = KINDS**3 + STATISTICS, shape.encoded, shape.gate
        draw = lambda *size, by: (rng.standard_normal(size) * by).astype(np.float32)
        self.shape = shape
        self.p = {"E": draw(d, h, by=0.3), "e": np.zeros(h, np.float32), "V": draw(h, g, by=h**-0.5), "U": draw(h, g, by=h**-0.5), "w": draw(g, by=0.3), "c": draw(h, by=0.3), "b": np.zeros(1, np.float32)}
        self.middle, self.wide = np.zeros(d, np.float32), np.ones(d, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def attended(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of passages: scaled inputs, their encoding, both sides of the gate, the attention's score."""
        p = self.p
        x = (rows - self.middle) / self.wide
        encoded = np.tanh(x @ p["E"] + p["e"])
        left, right = np.tanh(encoded @ p["V"]), _sigmoid(encoded @ p["U"])
        return x, encoded, left, right, (left * right) @ p["w"]

    def long_logit(self, data: np.ndarray, size: int = 1 << 18) -> float:
        """Of one text's bytes, a run of passages at a time: attention is pooled as it goes, against the greatest score so far."""
        top, total, whole = -np.inf, 0.0, np.zeros(self.shape.encoded)
        for rows in passage_runs(data, self.shape, size):
            _, encoded, _, _, score = self.attended(rows)
            peak = max(top, float(score.max()))
            weight = np.exp(score - peak)
            total = total * np.exp(top - peak) + weight.sum()
            whole = whole * np.exp(top - peak) + weight @ encoded
            top = peak
        return float(whole / total @ self.p["c"] + self.p["b"][0])

    def logits(self, rows: np.ndarray, of: np.ndarray, texts: int, keep: dict | None = None) -> np.ndarray:
        """Of each text; `of` is sorted and names every text."""
        p = self.p
        x, encoded, left, right, score = self.attended(rows)
        starts = np.searchsorted(of, np.arange(texts))
        weight = np.exp(score - np.maximum.reduceat(score, starts)[of])
        weight = weight / np.add.reduceat(weight, starts)[of]
        whole = np.add.reduceat(weight[:, None] * encoded, starts, axis=0)
        if keep is not None:
            keep |= {"x": x, "encoded": encoded, "left": left, "right": right, "weight": weight, "whole": whole, "starts": starts, "of": of}
        return whole @ p["c"] + p["b"][0]

    def gradients(self, k: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        p, of = self.p, k["of"]
        d_whole = slope[:, None] * p["c"]
        d_weight = (k["encoded"] * d_whole[of]).sum(1)
        d_score = k["weight"] * (d_weight - np.add.reduceat(k["weight"] * d_weight, k["starts"])[of])
        d_left = d_score[:, None] * p["w"] * k["right"] * (1 - k["left"] ** 2)
        d_right = d_score[:, None] * p["w"] * k["left"] * k["right"] * (1 - k["right"])
        d_encoded = (k["weight"][:, None] * d_whole[of] + d_left @ p["V"].T + d_right @ p["U"].T) * (1 - k["encoded"] ** 2)
        return {
            "c": k["whole"].T @ slope, "b": np.array([slope.sum()]), "w": (k["left"] * k["right"]).T @ d_score,
            "V": k["encoded"].T @ d_left, "U": k["encoded"].T @ d_right, "E": k["x"].T @ d_encoded, "e": d_encoded.sum(0),
        }

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Texts of more than LONG bytes are read in runs of passages, the others together."""
        sizes, logit = np.asarray(pa.compute.binary_length(texts).fill_null(0)), np.zeros(len(texts))
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            rows, of = passage_inputs(texts if len(short) == len(texts) else texts.take(pa.array(short)), self.shape)
            logit[short] = self.logits(rows, of, len(short))
        for k in np.flatnonzero(sizes > LONG).tolist():
            logit[k] = self.long_logit(np.frombuffer(texts[k].as_buffer(), np.uint8))
        return np.round(_sigmoid(self.scale * logit + self.shift), 6)


def train(texts: list[str], labels: np.ndarray, prior: float, shape: Shape = Shape(), training: Training = Training()) -> Network:
    """Fits the network to texts with labels 0 and 1.

    A fifth of the texts isn't learned from: their logits are fitted to their labels, with a share of
    label 1 half way between prior and a half. prior is the score where there is one label only.
    """
    net, rng = Network(shape, training.seed), np.random.default_rng(training.seed)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        net.p["c"][:] = 0
        net.shift = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return net
    last = np.zeros(len(texts), bool)
    for y in (0, 1):
        last[labels == y] = np.arange((labels == y).sum()) % 5 == 4
    parts, of = [], []
    for at, block in blocks_of(pa.array(texts, pa.string()), 1 << 18):
        for x, owner in inputs_in_runs(block, shape):
            parts.append(x.astype(np.float16)), of.append(owner + at)
    rows, of = np.concatenate(parts), np.concatenate(of)
    del parts
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    net.middle, net.wide = rows.mean(0, dtype=np.float32), np.maximum(np.sqrt(np.maximum((rows.astype(np.float32) ** 2).mean(0) - rows.mean(0, dtype=np.float32) ** 2, 0)), 0.02)
    adam, learn = Adam(net.p, training.rate), np.flatnonzero(~last)
    share = np.clip(labels[learn].mean(), 0.02, 0.98)

    def some(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(bounds)[pick]
        at = np.repeat(bounds[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return rows[at].astype(np.float32), np.repeat(np.arange(len(pick)), n)

    epochs = max(training.epochs, min(300, 40_000 // max(1, len(learn))))
    for epoch in range(epochs):
        adam.rate = training.rate * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(learn)
        for a in range(0, len(order), training.batch):
            pick = order[a : a + training.batch]
            x, owner = some(pick)
            kept: dict = {}
            q = _sigmoid(net.logits(x, owner, len(pick), kept))
            slope = ((q - labels[pick]) * np.where(labels[pick] == 1, 0.5 / share, 0.5 / (1 - share)) / len(pick)).astype(np.float32)
            g = net.gradients(kept, slope)
            g["E"] = g["E"] + training.decay * net.p["E"]
            adam.step(g)
    if len(set(labels[last].tolist())) == 2:
        x, owner = some(np.flatnonzero(last))
        net.scale, net.shift = fit_logistic(net.logits(x, owner, int(last.sum())).astype(np.float64), labels[last], (prior + 0.5) / 2)
    return net


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the carried columns, score of each row: 0 to 1, higher where label 1 is likelier.

    A very long text is scored whole, in runs of passages, so memory follows a run and not the text (but for a single word, which is held whole).
    Every passage of the whole text is encoded and weighed. Null and empty texts are one passage of
    zeros. Repeated rows score alike; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    carry = tuple(c for c in carry if c.lower() not in {id_col.lower(), "score"})
    schema = T.StructType([docs.schema[id_col], *(docs.schema[c] for c in carry), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            found = [net.scores(block) for _, block in blocks_of(batch.column(0))]
            columns = [*batch.columns[1:], pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col), *carry).mapInArrow(tidied(score), schema)
