"""The networks: gradients against differences, whole texts, held-out accuracy, edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidlog.llm import quality, toxicity
from braidlog.llm.common import kept_by
from braidlog.llm.words import words_of


def sentence(draw, n):
    return [draw.choice("kltmnrs") + draw.choice("aeiou") + draw.choice("bdgpst") + draw.choice(["", "a", "en", "or"]) for _ in range(n)]


def labelled(seed, n):
    """Toxic texts hold a word with a stem; low quality is a share of marked words."""
    draw, rows = random.Random(seed), []
    for k in range(n):
        w = sentence(draw, draw.randint(5, 160))
        toxic, good = int(draw.random() < 0.4), int(draw.random() < 0.6)
        if toxic:
            for _ in range(draw.randint(1, 3)):
                w.insert(draw.randrange(len(w) + 1), "zwork" + draw.choice(["", "a", "en", "or"]))
        if not good:
            w = [x + draw.choice(["%%%", "&&&"]) if draw.random() < 0.7 else x for x in w]
        rows.append((k, " ".join(w), toxic, good))
    return rows


@pytest.fixture(scope="module")
def nets():
    rows = labelled(1, 700)
    texts = [r[1] for r in rows]
    toxic, good = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    return toxicity.train(texts, toxic, toxic.mean()), quality.train(texts, good, good.mean())


def test_held_out_accuracy(nets):
    rows = labelled(2, 300)
    texts = pa.array([r[1] for r in rows])
    for net, at in zip(nets, (2, 3)):
        label = np.array([r[at] for r in rows])
        assert ((net.scores(texts) >= 0.5) == label).mean() > 0.95


def small_network():
    shape = toxicity.Shape(hidden=3, attention=2, word_dims=2, char_dims=2, char_bits=6, window=5, stride=3)
    lex = toxicity.Lexemes(words_of(pa.array(["aa bb cc dd ee ff gg", "hh aa", ""])), shape)
    net = toxicity.Network(shape, 0, np.sort(lex.hash[::2]))
    rng = np.random.default_rng(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"][:-1] = rng.standard_normal(net.p["word"][:-1].shape)
    net.p["char"][:] = rng.standard_normal(net.p["char"].shape)
    return net, lex


def test_recurrent_gradients():
    net, lex = small_network()
    codes, of = net.windows(lex.code, lex.of_text)
    assert of.tolist() == [0, 0, 1, 2] and (codes[3] == -1).all()
    target = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        q = net.logits(net.word_inputs(lex).astype(np.float64), codes)
        return float(np.logaddexp(0, np.where(target == 1, -q, q)).sum())

    kept = {}
    q = net.logits(net.word_inputs(lex).astype(np.float64), codes, kept)
    g, d_inputs = net.gradients(kept, 1 / (1 + np.exp(-q)) - target)
    for name, (rows, values) in net.embedding_gradients(lex, d_inputs).items():
        assert len(set(rows.tolist())) == len(rows)
        g[name] = np.zeros_like(net.p[name])
        g[name][rows] = values
    rng = np.random.default_rng(1)
    for name, p in net.p.items():
        spots = [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)] if name not in ("word", "char") else [tuple(x) for x in np.argwhere(g[name])[:6]]
        for at in spots:
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3), (name, at)


def test_recurrent_forward_pass_word_by_word():
    """The network's equations, one window and one word at a time."""
    net, lex = small_network()
    codes, _ = net.windows(lex.code, lex.of_text)
    inputs, p, h = net.word_inputs(lex), net.p, net.shape.hidden
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for window in codes:
        words = [c for c in window if c >= 0]
        states = {}
        for side, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                given, fed = inputs[words[t]] @ p[f"W{side}"] + p[f"c{side}"], state @ p[f"U{side}"]
                reset, update = sig(given[:h] + fed[:h]), sig(given[h : 2 * h] + fed[h : 2 * h])
                state = update * state + (1 - update) * np.tanh(given[2 * h :] + reset * fed[2 * h :])
                states[side, t] = state
        both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(words))]).reshape(-1, 2 * h)
        weight = np.exp(np.tanh(both @ p["A"]) @ p["v"])
        pooled = (weight[:, None] * both).sum(0) / max(weight.sum(), 1e-30)
        want.append(pooled @ p["o"] + p["bias"][0])
    assert net.logits(inputs, codes) == pytest.approx(np.array(want), abs=1e-5)


def test_attention_forward_pass_text_by_text():
    """Gated attention over a text's passages, written out."""
    shape = quality.Shape(passage_words=4, encoded=3, gate=2)
    net = quality.Network(shape, 0)
    rows, of = quality.passage_inputs(pa.array(["a B c% d e f", "g", "", "h i j k l m n o p"]), shape)
    p = net.p
    want = []
    for text in range(4):
        coded = np.tanh(rows[of == text] @ p["E"] + p["e"])
        gate = (np.tanh(coded @ p["V"]) * (1 / (1 + np.exp(-(coded @ p["U"]))))) @ p["w"]
        weight = np.exp(gate) / np.exp(gate).sum()
        want.append((weight[:, None] * coded).sum(0) @ p["c"] + p["b"][0])
    assert net.logits(rows, of, 4) == pytest.approx(np.array(want), abs=1e-5)


def test_long_texts_are_read_in_runs():
    """The same score as that of all passages at once, from memory that doesn't follow the text."""
    import tracemalloc

    draw = random.Random(2)
    net = quality.Network(quality.Shape(), 3)
    few = ["word", "Ünï", "x", "9,", "a-b.", "漢字", "\u00a0q", "longer" * 5, "z" * 900]
    for size, gap in ((300, " "), (2000, "\n \t")):
        text = gap + "".join(draw.choice(few) + draw.choice([" ", gap]) for _ in range(1500))
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = list(quality.pieces(data, 40, size))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and len(cuts) > 20
        rows, of = quality.passage_inputs(pa.array([text]), net.shape)
        assert net.long_logit(data, size) == pytest.approx(float(net.logits(rows, of, 1)[0]), abs=1e-5)
    for odd in ("", " " * 50, "w" * 700, "w" * 700 + " x"):
        rows, of = quality.passage_inputs(pa.array([odd]), net.shape)
        assert net.long_logit(np.frombuffer(odd.encode(), np.uint8), 64) == pytest.approx(float(net.logits(rows, of, 1)[0]), abs=1e-5)
    long = pa.array([("several words of a very long text, Again and again. " * 400_000)[: 20 << 20]])
    tracemalloc.start()
    assert 0 <= net.scores(long)[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    mixed = pa.array(["short text", None, long[0].as_py()[: 3 << 20], "", "another"])
    rows, of = quality.passage_inputs(mixed, net.shape)
    assert net.scores(mixed) == pytest.approx(1 / (1 + np.exp(-net.logits(rows, of, 5))), abs=2e-6)
    runs = list(quality.inputs_in_runs(mixed, net.shape))
    assert len(runs) > 5 and np.array_equal(np.concatenate([r for r, _ in runs]), rows) and np.array_equal(np.concatenate([o for _, o in runs]), of)


@pytest.mark.parametrize("name", ["op2_toxicity", "op7_quality"])
def test_registered_rows(spark, tmp_path, name):
    """Fold, threshold and one row for each document; labels of the other fold change nothing."""
    from braidlog.llm.queries import QUERIES

    rows = labelled(3, 160)
    folds, left = {"op2_toxicity": (3, 1), "op7_quality": (4, 2)}[name]
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % folds == left}
    found = []
    for turn in range(2):
        folder = tmp_path / str(turn)
        spark.createDataFrame([(k, t) for k, t, *_ in rows] + [(900, None), (901, "")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        labels = [(k, (1 - good if turn and k in held else good), (1 - toxic if turn and k in held else toxic)) for k, _, toxic, good in rows]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = QUERIES[name](spark, str(folder)).collect()
        assert len(got) == 162 and {r["doc_id"] for r in got if r["held_out"]} == held | {k for k in (900, 901) if zlib.crc32(str(k).encode()) % folds == left}
        assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
        found.append({r["doc_id"]: r["score"] for r in got})
    assert found[0] == found[1]


def test_attention_gradients():
    shape = quality.Shape(passage_words=4, encoded=3, gate=2)
    net = quality.Network(shape, 0)
    rows, of = quality.passage_inputs(pa.array(["a B c% d e f", "g", "", "h i j k l m n o p"]), shape)
    assert of.tolist() == [0, 0, 1, 2, 3, 3, 3] and not rows[3].any()
    rows = rows.astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    target = np.array([1.0, 0.0, 1.0, 0.0])
    loss = lambda: float(np.logaddexp(0, np.where(target == 1, -1, 1) * net.logits(rows, of, 4)).sum())
    kept = {}
    q = net.logits(rows, of, 4, kept)
    g = net.gradients(kept, 1 / (1 + np.exp(-q)) - target)
    rng = np.random.default_rng(1)
    for name, p in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(8)]:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7), (name, at)


def test_windows_cover_all_words_and_overlap(nets):
    net = nets[0]
    for n in (0, 1, 20, 32, 33, 52, 53, 400):
        lex = toxicity.Lexemes(words_of(pa.array([" ".join(f"w{k}" for k in range(n))])), net.shape)
        codes, _ = net.windows(lex.code, lex.of_text)
        seen = [lex.code.tolist().index(c) for c in codes.ravel() if c >= 0]
        assert set(seen) == set(range(n)) and (len(codes) == 1 or set(codes[0]) & set(codes[1]))
    words = sentence(random.Random(5), 900)
    clean, tail = " ".join(words), " ".join([*words, "zworka"])
    assert net.scores(pa.array([tail]))[0] > 0.7 > net.scores(pa.array([clean]))[0]


def test_scores_on_tables(spark, nets):
    rows = [(k, t) for k, t in enumerate(["zworken bad", "kab lat", "", None, "kab lat", " ".join(sentence(random.Random(1), 20_000))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "__text": F.lit(1)})
    for net, module in zip(nets, (toxicity, quality)):
        got = module.score_documents(docs, net, carry=("score",)).collect()
        score = {r["doc_id"]: r["score"] for r in got}
        assert len(score) == 6 and all(0 <= s <= 1 for s in score.values()) and score[1] == score[4] and score[2] == score[3]
        assert module.score_documents(docs.limit(0), net).count() == 0
    kept = kept_by(docs, "text", lambda texts: nets[0].scores(texts) < 0.7)
    assert kept.columns == docs.columns and {1, 2, 3, 4} <= {r["doc_id"] for r in kept.collect()} <= {1, 2, 3, 4, 5}


def test_sample_and_one_label(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    rows, prior = toxicity.labelled_sample(docs, labels, "toxic", lambda i: i % 3 != 1, 40)
    got = rows.collect()
    assert len(got) == 40 and sum(r["label"] for r in got) == 20 and all(r["id"] % 3 != 1 for r in got) and abs(prior - 0.25) < 0.02
    again, _ = toxicity.labelled_sample(docs.unionByName(docs), labels.unionByName(labels), "toxic", lambda i: i % 3 != 1, 40)
    assert sorted(again.collect()) == sorted(got)  # repeated ids don't widen the sample
    for module in (toxicity, quality):
        for texts, y in ((["a b"], [0]), ([], [])):
            net = module.train(texts, np.array(y, int), 0.2)
            assert abs(net.scores(pa.array(["c", ""]))[0] - 0.2) < 0.05
        model = toxicity.trained(rows, lambda texts, labels, m=module: m.train(texts, labels, 0.2))
        assert model.scores(pa.array(["x"])).shape == (1,)
