"""Exchange packing, dual-tree clusters and conversation tries: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidlog.llm import trie
from braidlog.llm.dualtree import assign, cluster_vectors, cover_tree, squared
from braidlog.llm.exchange import Exchange, exchanged, pack_by_exchange
from braidlog.llm.packing import best_fit_decreasing
from braidlog.llm.trie import conversation_trie
from braidlog.plans import segments

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("low,high", [(1, 100), (25, 51), (33, 42), (70, 71), (1, 4)])
def test_exchanges_only_empty_windows(low, high):
    lengths = np.sort(np.random.default_rng(low).integers(low, high, 400))[::-1]
    window = best_fit_decreasing(lengths, 100)[0]
    found = Exchange(lengths, window, 100)
    squares = [int((found.fill**2).sum())]
    swap = found._swap
    found._swap = lambda *a: (swap(*a), squares.append(int((found.fill**2).sum())))
    found.search()
    assert all(a < b for a, b in zip(squares, squares[1:]))
    placed, offset = found.placed()
    assert np.bincount(placed, lengths).max() <= 100 and len(set(placed.tolist())) <= len(set(window.tolist()))
    for w in set(placed.tolist()):
        own = np.flatnonzero(placed == w)
        own = own[np.argsort(offset[own])]
        assert (np.cumsum(lengths[own]) - lengths[own] == offset[own]).all()
    if low == 25:
        assert len(set(placed.tolist())) < len(set(window.tolist()))


def test_one_for_two_empties_a_window():
    # 60 + 40 and 60 + 25 + 15 are full only after one of 40 goes for 25 and 15.
    found = exchanged(np.array([60, 60, 40, 25, 15]), 100)
    assert len(set(found.placed()[0].tolist())) == 2


def test_exchange_packing(spark):
    rows = [(k, words(k, 30 + 25 * k)) for k in range(24)] + [(90, None), (91, ""), (None, "a"), (95, "a b"), (95, "a b"), (92, "x" * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("s"), "sequence_id": F.lit(1), "piece": F.lit(0)})
    got = pack_by_exchange(docs, PATH, capacity=128, group_pieces=8, with_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    whole = {}
    for k, t in rows:
        whole.setdefault(k, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    for k, each in whole.items():
        own = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"])
        if len(each) > 1:
            assert sorted(len(r["ids"]) for r in own) == sorted(len(x) for x in each)
            continue
        (ids,) = each
        assert [i for r in own for i in r["ids"]] == ids and [r["piece"] for r in own] == list(range(len(own)))
        assert [r["length"] for r in own][1:] == [128] * (len(own) - 1) and len(own) == -(-len(ids) // 128)
        for r in own:
            assert r["start"] == sum(x["length"] for x in own[: r["piece"]]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 128
    rests = sorted((r["length"] for r in got if r["length"] < 128), reverse=True)
    # Each of the groups of about eight pieces may leave one window more than lengths ask for; one group leaves no more than best fit.
    assert len(held) <= math.ceil(sum(r["length"] for r in got) / 128) + math.ceil(len(rests) / 8)
    one = pack_by_exchange(docs, PATH, capacity=128).filter("length < 128")
    assert one.count() == len(rests) and one.select("sequence_id").distinct().count() <= len(set(best_fit_decreasing(np.array(rests), 128)[0].tolist()))
    assert pack_by_exchange(docs.limit(0), PATH).count() == 0


def test_repeated_pieces_meet_in_several_tasks(spark):
    same = spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = pack_by_exchange(same, PATH, capacity=16, group_pieces=100)
    assert got.count() == 900 and got.select(F.shiftright("sequence_id", 24)).distinct().count() >= 5


def test_best_fit_deals_repeated_rows_to_several_tasks(spark):
    from braidlog.llm.packing import pack_documents

    same = spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = pack_documents(same, PATH, capacity=16, group_pieces=100)
    assert got.count() == 900 and got.select(F.shiftright("sequence_id", 32)).distinct().count() >= 5


def test_assignment_by_two_trees():
    rng = np.random.default_rng(0)
    for trial in range(120):
        d, n, k = int(rng.integers(1, 6)), int(rng.integers(1, 200)), int(rng.integers(1, 12))
        p, c = rng.integers(-20, 20, (n, d)), rng.integers(-20, 20, (k, d))
        if trial % 3 == 0:
            p[: n // 2] = p[0]
        if trial % 4 == 0 and k > 2:
            c[1] = c[0]
        tree, over = cover_tree(p, int(rng.integers(1, 8))), cover_tree(c, 1)
        assert sorted(tree.order.tolist()) == list(range(n))
        found, distance, _ = assign(p, tree, c, over, 64)
        all_ = squared(p, c)
        assert (found == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    far = np.concatenate([rng.integers(-5, 5, (300, 3)), rng.integers(-5, 5, (300, 3)) + 1000])
    assert assign(far, cover_tree(far), far[[0, 400]], cover_tree(far[[0, 400]], 1))[2] == 0  # whole nodes are settled


def lloyd(rows, dims, k, rounds, scale):
    kept = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), tuple(v)) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((int(a) - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if own := [v for (_, v), o in zip(kept, of) if o == j]:
                centroids[j] = [int(sum(int(x) for x in col)) // len(own) for col in zip(*own)]
    end = [(i, *near(v)[::-1]) for i, v in kept]
    total = lambda c: sum(d for _, o, d in end if c in (None, o))
    return sorted(((i, c, d, total(c), total(None), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in end), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(k % 4, 0.4, 3)]) for k in range(150)] + [(k, [1.0, 1.0, 1.0]) for k in range(200, 260)]
    rows += [(300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 0.0]), (304, [float("inf"), 0.0, 0.0]), (305, [-0.5, -0.0001, 0.0]), (7, [2.0, 2.0, 2.0]), (None, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"cluster": F.lit("x"), "ids": F.lit(1)})
    for k in (3, 8):
        got = [tuple(r) for r in cluster_vectors(df, dims=3, k=k, rounds=4, block=32).collect()]
        assert sorted(got, key=str) == lloyd(rows, 3, k, 4, 1024)
    assert cluster_vectors(df.limit(0), dims=3).count() == 0 == cluster_vectors(df, dims=5).count()
    few = cluster_vectors(df.filter("vec_id IN (1, 2)"), dims=3).collect()
    assert {r["cluster"] for r in few} == {0, 1}
    with pytest.raises(Exception, match="beyond 64 bits"):
        cluster_vectors(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dims=1).count()


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def below(n):
        own = (len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0)
        parts = [below(x) for x in kids.get(n, [])]
        return own + sum(p[0] for p in parts), sum(p[1] for p in parts) or 1

    out = []
    for n, c in members.items():
        saved, leaves = below(n)
        ends = ",".join(map(str, sorted(x for x in c if len(built[x]) == len(n))))
        out.append((min(c), len(n), min(members[n[:-1]]) if n else None, len(c), len(kids.get(n, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_tries(spark, monkeypatch, small):
    if small:  # long conversations are dealt, members are joined in several pieces
        monkeypatch.setattr(trie, "STRETCH", 4)
        monkeypatch.setattr(trie, "JOINED", 2)
        monkeypatch.setattr(segments, "MOST", 20)
        monkeypatch.setattr(segments, "SAMPLED", 2)
    draw = random.Random(2)
    rows = []
    for c in range(70):
        n = draw.choice([1, 2, 3, 5, 6])
        rows += [(c, t, draw.choice(["user", "bot"]), draw.choice(["a b", " c\td ", "", None, "e"])) for t in range(n)]
    for c in (400, 401, 402, 403, 404, 405):  # nested: one path of many runs
        rows += [(c, t, "user", f"same {t}") for t in range(c - 398)]
    rows += [(500 + k, t, "user", "long talk") for k in range(2) for t in range(90)]
    rows += [(600, None, None, "first"), (600, 1, "user", "x"), (601, 3, "bot", "y"), (None, 1, "user", "lost"), (700, 1, "user", "  \n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("x"), "depth": F.lit(0), "node": F.lit(1)})
    assert sorted((tuple(r) for r in conversation_trie(df).collect()), key=str) == brute_trie(rows)


def test_tries_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(4, 1, "user", "a"), (4, 1, "user", "a"), (5, 1, "user", "a")]
    assert sorted((tuple(r) for r in conversation_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == brute_trie(rows)
