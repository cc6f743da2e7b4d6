"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import bounded_batches, released, tidied
from braidlog.llm.words import Words, blocks_of, lower, mix, words_of


@dataclass(frozen=True)
class Shape:
    """Sizes of the network. A window has `window` words and begins `stride` after the one before, so windows overlap."""

    hidden: int = 12
    attention: int = 8
    word_dims: int = 8
    char_dims: int = 8
    char_bits: int = 17
    grams: tuple[int, ...] = (3, 4, 5)
    window: int = 32
    stride: int = 20


@dataclass(frozen=True)
class Training:
    """sample: labelled rows that the fit takes at most, half of them of each label where there are enough.

    known: texts that hold a word at least for it to have an embedding of its own. The embeddings are learned
    from whole texts first (bag_: epochs, texts at once, rate, share of words left out, pull towards 0), in bag_least steps at least.
    Then the network learns from windows; few texts are gone through more often, so that least of them are seen (in 40 epochs at most).
    """

    sample: int = 5000
    folds: int = 5
    known: int = 3
    bag_epochs: int = 8
    bag_batch: int = 64
    bag_least: int = 400
    bag_rate: float = 0.01
    bag_drop: float = 0.3
    bag_pull: float = 1e-4
    epochs: int = 6
    least: int = 24_000
    batch: int = 256
    rate: float = 0.003
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lexemes:
    """The distinct words of a block with their character n-grams, and where each word of the texts is among them."""

    def __init__(self, words: Words, shape: Shape):
        low = words._replace(data=lower(words.data))
        self.hash, first, self.code = np.unique(low.hashes(), return_index=True, return_inverse=True)
        self.of_text = words.first_of_text()
        start, size = low.start[first], low.end[first] - low.start[first]
        # Each distinct word's bytes between two marks, end to end; grams of all lengths that stay within a word.
        marked = np.cumsum(size + 2) - (size + 2)
        flat = np.zeros(int((size + 2).sum()) + 8, np.uint64)
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        flat[np.repeat(marked + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())] = low.data[at]
        n = len(flat) - 8
        left = np.repeat(marked + size + 2, size + 2) - np.arange(n) if n else np.empty(0, np.int64)  # bytes to the word's end
        grams, owner = [], []
        of = np.repeat(np.arange(len(size)), size + 2)
        rolled = flat[:n].copy()
        for k in range(1, max(shape.grams)):
            rolled = rolled * np.uint64(257) + flat[k : n + k]
            if k + 1 in shape.grams:
                fits = left >= k + 1
                grams.append(mix(rolled[fits] + np.uint64(k + 1 << 56)))
                owner.append(of[fits])
        gram, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.gram = gram[order].astype(np.uint32)  # the tables take fewer bits
        self.first_gram = np.searchsorted(owner[order], np.arange(len(size) + 1))


class Network:
    """Inputs of a word: its embedding, if it is known, and the pooled embeddings of its character n-grams."""

    def __init__(self, shape: Shape, seed: int, known: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        s, h = shape, shape.hidden
        self.shape, self.inputs = shape, shape.word_dims + shape.char_dims
        self.known = np.empty(0, np.uint64) if known is None else known
        draw = lambda *size, by=1.0: (rng.standard_normal(size) * by).astype(np.float32)
        # The last row is that of unknown words and stays 0.
        self.p: dict[str, np.ndarray] = {"word": np.zeros((len(self.known) + 1, s.word_dims), np.float32), "char": np.zeros((1 << s.char_bits, s.char_dims), np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": draw(self.inputs, 3 * h, by=self.inputs**-0.5), f"c{side}": np.zeros(3 * h, np.float32), f"U{side}": draw(h, 3 * h, by=h**-0.5)}
        self.p |= {"A": draw(2 * h, s.attention, by=(2 * h) ** -0.5), "v": draw(s.attention, by=0.5), "o": draw(2 * h, by=0.3), "bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def _rows(self, lex: Lexemes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the words' and of the n-grams' embeddings, and the root of how many n-grams each word has."""
        place = np.searchsorted(self.known, lex.hash)
        if len(self.known):
            hit = self.known[np.minimum(place, len(self.known) - 1)] == lex.hash
            place = np.where(hit, place, len(self.known))
        grams = (lex.gram & np.uint32((1 << self.shape.char_bits) - 1)).astype(np.int64)
        return place, grams, np.sqrt(np.maximum(np.diff(lex.first_gram), 1))[:, None].astype(np.float32)

    def word_inputs(self, lex: Lexemes) -> np.ndarray:
        """A row of inputs for each distinct word."""
        word, grams, root = self._rows(lex)
        if len(grams):
            chars = np.add.reduceat(self.p["char"][grams], np.minimum(lex.first_gram[:-1], len(grams) - 1), axis=0) / root
        else:
            chars = np.zeros((len(lex.hash), self.shape.char_dims), np.float32)
        return np.concatenate([self.p["word"][word], chars], 1)

    def windows(self, code: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """code: of each word; of_text: where each text's words begin. Word codes of every window of every text, -1 past a text's end, and the text of each window. A text without words has one empty window."""
        s = self.shape
        size = np.diff(of_text)
        count = np.maximum(1, -(-(size - (s.window - s.stride)) // s.stride))
        of = np.repeat(np.arange(len(size)), count)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * s.stride
        at = start[:, None] + np.arange(s.window)
        inside = at < size[of][:, None]
        codes = np.full(at.shape, -1, np.int64)
        codes[inside] = code[(at + of_text[of][:, None])[inside]]
        return codes, of

    def _pass(self, gates: np.ndarray, codes: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states (step, window, hidden) of one direction; gates: what each word adds, with a last row for none."""
        h, U = self.shape.hidden, self.p[f"U{side}"]
        n, steps = codes.shape
        out, state = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            given, fed = gates[codes[:, t]], state @ U
            both = given[:, : 2 * h] + fed[:, : 2 * h]
            np.negative(both, both), np.exp(both, both)
            both += 1
            np.reciprocal(both, both)
            reset, update = both[:, :h], both[:, h:]
            new = np.tanh(given[:, 2 * h :] + reset * fed[:, 2 * h :])
            after = new + update * (state - new)
            out_of = codes[:, t] < 0
            if out_of.any():
                after[out_of] = state[out_of]
            if keep is not None:
                keep.append((t, state, reset, update, new, fed[:, 2 * h :], out_of))
            out[t] = state = after
        return out

    def logits(self, inputs: np.ndarray, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, passes, states = self.p, {}, []
        for side in "fb":
            gates = np.concatenate([inputs @ p[f"W{side}"] + p[f"c{side}"], np.zeros((1, 3 * self.shape.hidden), np.float32)])
            passes[side] = None if keep is None else []
            states.append(self._pass(gates, codes, side, passes[side]))
        both = np.concatenate(states, 2)
        squashed = np.tanh(both @ p["A"])
        score = squashed @ p["v"]
        inside = codes.T >= 0
        score = np.where(inside, score, -np.inf)
        top = score.max(0)
        weight = np.where(inside, np.exp(score - np.where(np.isfinite(top), top, 0)), 0)
        weight = (weight / np.maximum(weight.sum(0), 1e-30)).astype(np.float32)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        if keep is not None:
            keep |= {"passes": passes, "both": both, "squashed": squashed, "weight": weight, "pooled": pooled, "inputs": inputs, "codes": codes}
        return pooled @ p["o"] + p["bias"][0]

    def gradients(self, kept: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the parameters and of the inputs' rows, for the loss whose slope in each logit is given."""
        p, h = self.p, self.shape.hidden
        both, squashed, weight, codes = kept["both"], kept["squashed"], kept["weight"], kept["codes"]
        g = {"o": kept["pooled"].T @ slope, "bias": np.array([slope.sum()])}
        pooled = slope[:, None] * p["o"]
        d_weight = np.einsum("tnh,nh->tn", both, pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = np.einsum("tn,tna->a", d_score, squashed)
        d_flat = (d_score[:, :, None] * p["v"]) * (1 - squashed**2)
        g["A"] = np.einsum("tnh,tna->ha", both, d_flat)
        d_both = weight[:, :, None] * pooled + d_flat @ p["A"].T
        d_inputs = np.zeros_like(kept["inputs"])
        for k, side in enumerate("fb"):
            U, d_state = p[f"U{side}"], np.zeros((codes.shape[0], h), np.float32)
            d_gates = np.zeros((len(kept["inputs"]), 3 * h), np.float32)
            g[f"U{side}"] = np.zeros_like(U)
            for t, state, reset, update, new, fed, out_of in reversed(kept["passes"][side]):
                d_after = d_state + d_both[t][:, k * h : (k + 1) * h]
                d_live = np.where(out_of[:, None], 0, d_after)
                d_update = d_live * (state - new) * update * (1 - update)
                d_new = d_live * (1 - update) * (1 - new**2)
                d_reset = d_new * fed * reset * (1 - reset)
                d_fed = np.concatenate([d_reset, d_update, d_new * reset], 1)
                d_given = np.concatenate([d_reset, d_update, d_new], 1)
                g[f"U{side}"] += state.T @ d_fed
                d_state = np.where(out_of[:, None], d_after, d_live * update + d_fed @ U.T)
                live = ~out_of
                np.add.at(d_gates, codes[live, t], d_given[live])
            g[f"c{side}"] = d_gates.sum(0)
            g[f"W{side}"] = kept["inputs"].T @ d_gates
            d_inputs += d_gates @ p[f"W{side}"].T
        return g, d_inputs

    def embedding_gradients(self, lex: Lexemes, d_inputs: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What the inputs' gradients say of the embeddings: the rows that they touch, each once, and their gradients."""
        word, grams, root = self._rows(lex)
        seen = word < len(self.known)
        share = np.repeat(d_inputs[:, self.shape.word_dims :] / root, np.diff(lex.first_gram), axis=0)
        return {"word": _summed(word[seen], d_inputs[seen, : self.shape.word_dims]), "char": _summed(grams, share)}

    def text_logits(self, texts: pa.Array) -> np.ndarray:
        lex = Lexemes(words_of(texts), self.shape)
        return self.greatest(self.word_inputs(lex), *self.windows(lex.code, lex.of_text), len(texts))

    def greatest(self, inputs: np.ndarray, codes: np.ndarray, of: np.ndarray, texts: int, at_once: int = 4096) -> np.ndarray:
        """The greatest logit of each text's windows; every window is scored."""
        out = np.full(texts, -np.inf, np.float32)
        for a in range(0, len(of), at_once):
            np.maximum.at(out, of[a : a + at_once], self.logits(inputs, codes[a : a + at_once]))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.round(_sigmoid(self.scale * self.text_logits(texts).astype(np.float64) + self.shift), 6)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once, with the sum of its values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, np.int64)
    return rows[starts], np.add.reduceat(values[order], starts, axis=0) if len(rows) else values


class Adam:
    """Gradients are arrays, or (rows, their gradients) of a table, of which only these rows move."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]) -> None:
        self.t += 1
        whole = {k: x if isinstance(x, tuple) else (slice(None), x) for k, x in g.items()}
        size = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for _, x in whole.values()))
        clip = min(1.0, 5.0 / max(size, 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, (at, x) in whole.items():
            x = (x * clip).astype(np.float32)
            m, v = self.m[k][at], self.v[k][at]
            self.m[k][at] = m = m + 0.1 * (x - m)
            self.v[k][at] = v = v + 0.001 * (x * x - v)
            self.p[k][at] -= rate * m / (np.sqrt(v) + 1e-8)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: float, expected: float = 2.0, steps: int = 50) -> tuple[float, float]:
    """scale and shift of a logistic curve by damped Newton steps; label 1 weighs as if its share were prior.

    Few values are drawn towards the expected slope, in standard deviations.
    """
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) / len(x)
    mean, wide = float(x.mean()), float(x.std()) or 1.0
    rows = np.stack([(x - mean) / wide, np.ones(len(x))], 1)
    pull, aim = np.array([2 / len(x), 0.0]), np.array([expected, 0.0])
    loss = lambda c: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (rows @ c))).sum() + 0.5 * (pull * (c - aim) ** 2).sum())
    c = np.array([1.0, np.log((prior + 1e-6) / (1 - prior + 1e-6))])
    for _ in range(steps):
        q = _sigmoid(np.clip(rows @ c, -30, 30))
        slope = rows.T @ (weight * (q - y)) + pull * (c - aim)
        move = np.linalg.solve((rows * (weight * q * (1 - q))[:, None]).T @ rows + np.diag(pull + 1e-9), slope)
        size, now = 1.0, loss(c)
        while size > 1e-6 and loss(c - size * move) > now:
            size /= 2
        c = c - size * move
        if abs(size * move).max() < 1e-8:
            break
    slope = max(float(c[0]), expected / 4)
    return slope / wide, float(c[1]) - slope * mean / wide


def _learn_embeddings(net: Network, lex: Lexemes, texts: list[np.ndarray], labels: np.ndarray, prior: float, training: Training, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Fits the embeddings by whole texts: a text's logit is the log of the sum of exp of its distinct words' scores, so few words can make it.

    texts: each one's distinct words. Gives what an embedding is weighed by for a score, and the bias.
    """
    some = np.flatnonzero([len(t) > 0 for t in texts])
    p = {"word": net.p["word"], "char": net.p["char"], "a": rng.standard_normal(net.inputs).astype(np.float32), "bias": np.zeros(1, np.float32)}
    if not len(some):
        return p["a"], 0.0
    share = float(np.clip(prior, 0.01, 0.99))
    p["bias"][0] = np.log(share / (1 - share)) - np.mean([np.log(max(1.0, len(texts[k]) * (1 - training.bag_drop))) for k in some])
    adam = Adam(p, training.bag_rate)
    steps = -(-len(some) // training.bag_batch)
    for _ in range(max(training.bag_epochs, min(40, -(-training.bag_least // steps)))):
        order = rng.permutation(some)
        for at in range(0, len(order), training.bag_batch):
            pick = order[at : at + training.bag_batch]
            words = np.concatenate([texts[k] for k in pick])
            of = np.repeat(np.arange(len(pick)), [len(texts[k]) for k in pick])
            rows, local = np.unique(words, return_inverse=True)
            few = _only(lex, rows)
            inputs = net.word_inputs(few)
            score = np.where(rng.random(len(words)) >= training.bag_drop, (inputs @ p["a"])[local], -30.0)
            top = np.full(len(pick), -30.0)
            np.maximum.at(top, of, score)
            part = np.exp(score - top[of])
            total = np.bincount(of, part, len(pick))
            slope = (_sigmoid(top + np.log(total) + p["bias"][0]) - labels[pick]) / len(pick)
            d_score = np.bincount(local, slope[of] * part / total[of], len(rows)).astype(np.float32)
            g = net.embedding_gradients(few, d_score[:, None] * p["a"])
            g = {k: (r, x + training.bag_pull * p[k][r]) for k, (r, x) in g.items()}
            adam.step(g | {"a": inputs.T @ d_score, "bias": np.array([slope.sum()])})
    return p["a"], float(p["bias"][0])


def _joined(parts: list[Lexemes]) -> tuple[Lexemes, list[np.ndarray]]:
    """The distinct words of several blocks, and where each block's are among them."""
    every = np.concatenate([x.hash for x in parts])
    hashes, first, place = np.unique(every, return_index=True, return_inverse=True)
    out = object.__new__(Lexemes)
    size = np.concatenate([np.diff(x.first_gram) for x in parts])
    starts = np.append(0, np.cumsum(size))[:-1][first]
    n = size[first]
    at = np.repeat(starts - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    out.hash, out.gram, out.first_gram = hashes, np.concatenate([x.gram for x in parts])[at], np.append(0, np.cumsum(n))
    return out, np.split(place, np.cumsum([len(x.hash) for x in parts])[:-1])


def train(texts: list[str], labels: np.ndarray, prior: float, shape: Shape = Shape(), training: Training = Training()) -> Network:
    """Fits the network to texts with labels 0 and 1.

    The embeddings are learned from whole texts first. A text's windows are then ranked by the scores of their words' embeddings:
    the first stands for a toxic text; the first two and one at random are clean in a clean text; from these the whole
    network learns, embeddings too. The last fold isn't learned from: its texts' greatest logits
    are fitted to their labels, with a share of label 1 half way between prior and a half. prior is the
    score where there is one label only.
    """
    rng = np.random.default_rng(training.seed)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        net = Network(shape, training.seed)
        net.p["o"][:] = 0
        net.shift = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return net
    fold = np.zeros(len(texts), np.int64)
    for y in (0, 1):  # every fold gets its part of each label
        fold[labels == y] = np.arange((labels == y).sum()) % training.folds
    last = fold == training.folds - 1
    column = pa.array(texts, pa.string())
    learn, held = np.flatnonzero(~last), np.flatnonzero(last)
    blocks = [(learn[at : at + len(block)], Lexemes(words_of(block), shape)) for at, block in blocks_of(column.take(pa.array(learn)))]
    released()
    lex, codes_of = _joined([x for _, x in blocks])
    # From here on a block is its texts' places, their words among all, and where each text's begin.
    blocks = [(places, codes.astype(np.int32)[x.code], x.of_text) for (places, x), codes in zip(blocks, codes_of)]
    del codes_of
    released()
    bags = [np.empty(0, np.int32)] * len(texts)
    for places, codes, of_text in blocks:
        for k, place in enumerate(places.tolist()):
            bags[place] = np.unique(codes[of_text[k] : of_text[k + 1]])
    held_by = np.bincount(np.concatenate([bags[k] for k in learn]), minlength=len(lex.hash))
    net = Network(shape, training.seed, lex.hash[held_by >= training.known])
    weights, _ = _learn_embeddings(net, lex, [bags[k] for k in learn], labels[learn], prior, training, rng)
    # The windows to learn from; the words that they hold are numbered among all.
    few = 1 << 14  # words whose n-grams are held at once
    evidence = [net.word_inputs(_only(lex, np.arange(at, min(at + few, len(lex.hash))))) @ weights for at in range(0, len(lex.hash), few)]
    evidence = np.append(np.concatenate([*evidence, np.empty(0, np.float32)]), -np.inf)
    chosen, target = [], []
    for places, codes, of_text in blocks:
        windows, of = net.windows(codes, of_text)
        rank = np.lexsort((-np.logaddexp.reduce(np.maximum(evidence[windows], -50), axis=1), of))
        place = np.arange(len(of)) - np.searchsorted(of[rank], of[rank])
        label = labels[places][of[rank]]
        lucky = rng.random(len(of)) < 1.5 / np.maximum(np.bincount(of)[of[rank]], 1)
        take = np.where(label == 1, place == 0, (place < 2) | lucky)
        chosen.append(windows[rank][take])
        target.append(label[take].astype(np.float32))
    windows, label = np.concatenate(chosen), np.concatenate(target)
    share = np.clip(label.mean(), 0.02, 0.98)
    adam = Adam(net.p, training.rate)
    for _ in range(max(training.epochs, min(40, training.least // max(1, len(texts))))):
        order = rng.permutation(len(label))
        for a in range(0, len(order), training.batch):
            pick = order[a : a + training.batch]
            rows, local = _numbered(windows[pick])
            if not len(rows):
                continue
            few = _only(lex, rows)
            kept: dict = {}
            q = _sigmoid(net.logits(net.word_inputs(few), local, kept))
            slope = ((q - label[pick]) * np.where(label[pick] == 1, 0.5 / share, 0.5 / (1 - share)) / len(pick)).astype(np.float32)
            g, d_inputs = net.gradients(kept, slope)
            adam.step(g | net.embedding_gradients(few, d_inputs))
    if len(set(labels[held].tolist())) == 2:
        found = np.concatenate([net.text_logits(block) for _, block in blocks_of(column.take(pa.array(held)))])
        net.scale, net.shift = fit_logistic(found, labels[held], (prior + 0.5) / 2)
    return net


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that windows hold, and the windows with these words numbered anew; -1 stays."""
    rows, local = np.unique(codes, return_inverse=True)
    local = local.reshape(codes.shape)
    return (rows[1:], local - 1) if len(rows) and rows[0] == -1 else (rows, local)


def _only(lex: Lexemes, rows: np.ndarray) -> Lexemes:
    """Some of the distinct words, without the texts."""
    out = object.__new__(Lexemes)
    n = np.diff(lex.first_gram)[rows]
    at = np.repeat(lex.first_gram[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out.hash, out.gram, out.first_gram = lex.hash[rows], lex.gram[at], np.append(0, np.cumsum(n))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learns: Callable[[Column], Column], sample: int, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> tuple[DataFrame, float]:
    """id, text, label of at most sample labelled ids for which learns holds, and the share of label 1 among all such ids.

    Ids are taken in the order of a hash, up to half of the sample for each label, so the
    choice doesn't depend on how the tables lie; only the ids chosen are sent to the workers. An id that labels has
    several times takes its greatest label, one that docs has several times its least text; so the bound holds for any tables.
    """
    seen = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    seen = seen.filter(learns(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [seen.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("__of"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("__of") == F.col("id"))
    total = sum(counts.values())
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label"), counts.get(1, 0) / total if total else 0.5


def trained(rows: DataFrame, fit: Callable[[list[str], np.ndarray], object]) -> object:
    """What fit makes of the sample's texts and labels, in the order of ids. One task fits, so the driver holds the result alone."""

    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        if held := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("text", "ascending"), ("label", "ascending")])
            texts, labels = table["text"].to_pylist(), table["label"].to_pylist()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(texts, np.array(labels, np.int64)))], pa.binary())})

    return pickle.loads(rows.repartition(1).mapInArrow(tidied(run), "model binary").first()[0])


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the carried columns, score of each row: 0 to 1, higher where label 1 is likelier.

    Whole texts are scored: the score is that of a text's most toxic window. Null and empty texts have
    one window without words. Repeated rows score alike; an empty table gives no rows.
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
