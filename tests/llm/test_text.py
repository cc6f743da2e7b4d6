"""Words, fingerprints, packing, URL rules, BPE: brute force and edge cases."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidlog.llm.bpe import Encoder, Merger, Splitter, Transducer, compile_lexicon, decode_documents, encode_documents, frequent_words
from braidlog.llm.fingerprint import SYMBOLS, fingerprint, fingerprint_documents, likeness, likeness_of_signatures
from braidlog.llm.packing import OpenWindows, best_fit_decreasing, pack_documents
from braidlog.llm.tokenizer import Vocabulary, fast_encoder
from braidlog.llm.urlrules import HostIndex, HostRule, MinedRule, TokenIndex, _parts, host_of, judge_urls, labelled_urls, mine_rules, path_of, surely, tokens_of
from braidlog.llm.words import blocks_of, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
ODD = ["", None, "a", "<|endoftext|>", "x<|endoftext|> y", "  \n\n x\t", "\x1c\x1d a", "½²Ⅷ٣ naïve", "हिन्दी 👩‍👩‍👧", "I'll've don't", "ab" * 3000, "é" * 700, " ".join(["word"] * 3000)]


def text(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(n))


def test_words():
    texts = ["a bb", None, "", " \t", "\x0bcc\x0c", "d\x1ce é", "a bb"]
    w = words_of(pa.array(texts))
    got = [[] for _ in texts]
    for s, e, t in zip(w.start, w.end, w.text):
        got[t].append(w.data[s:e].tobytes())
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    h = w.hashes()
    assert h[0] == h[-2] and h[1] == h[-1] and len(set(h.tolist())) == 5
    part = pa.array(texts).slice(2, 4)
    assert words_of(part).texts == 4 and len(words_of(part).start) == 3
    assert [(a, len(b)) for a, b in blocks_of(pa.array(["xx"] * 7), 4)] == [(0, 2), (2, 2), (4, 2), (6, 1)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_fingerprints():
    rng = np.random.default_rng(0)
    sides = [(rng.integers(0, 6, rng.integers(0, 129)).astype(np.uint16), rng.integers(0, 6, rng.integers(0, 129)).astype(np.uint16)) for _ in range(60)]
    want = [2 * lcs(a.tolist(), b.tolist()) / (len(a) + len(b)) if len(a) + len(b) else 1.0 for a, b in sides]
    assert np.allclose(likeness_of_signatures(*map(list, zip(*sides))), want)
    base = text(1, 500)
    changed = base[: len(base) * 3 // 4] + text(2, 500)[: len(base) // 4]
    prints = [fingerprint(x.encode()) for x in (base, base, changed, text(3, 500), "", "Was " * 4000, base * 300)]
    assert all(len(p.fine) <= SYMBOLS and len(p.coarse) <= SYMBOLS for p in prints)
    pairs = likeness([(prints[0], prints[k]) for k in range(1, 7)] + [(prints[4], prints[4])])
    assert pairs[0] == 1 and pairs[1] > 0.55 and pairs[2] < 0.25 and pairs[3] == 0 and pairs[5] == 0 and pairs[6] == 1
    assert str(prints[0]) == str(prints[1]) != str(prints[2])


def slow_fingerprint(data):
    """Byte by byte: block size, and the symbols of the chunks at it and at twice it."""
    mix, whole = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (1 << 64) - 1
    block = 0
    while data and 64 << block < len(data):
        block += 1
    out = [block]
    for k in (block, block + 1):
        symbols, last, total = [], -1, 0
        for at in range(len(data)):
            rolled = sum(data[at - 7 + j] << 8 * j for j in range(8) if at - 7 + j >= 0) * mix[0] & whole
            x = (rolled ^ rolled >> 31) * mix[1] & whole
            total = (total + (x ^ x >> 29)) & whole
            triggers = (rolled >> 24) % (1 << k) == (1 << k) - 1
            ends = at == len(data) - 1
            if at - last == 4 << k or ends or (triggers and at - last >= (1 << k) // 2):
                symbols.append((total * mix[2] & whole) >> 52)
                last, total = at, 0
        out.append(symbols)
    return out


def test_fingerprints_byte_by_byte():
    for data in (b"", b"a", b"abc", bytes(300), b"Was " * 300, *(text(k, n).encode() for k, n in enumerate((3, 12, 60, 200, 700)))):
        got = fingerprint(data)
        assert [got.block, got.fine.tolist(), got.coarse.tolist()] == slow_fingerprint(data), data[:20]


def test_fingerprint_documents(spark):
    rows = [(3 * k, t) for k, t in enumerate([text(k, 40 + k) for k in range(30)] + ["", None, "x", "same", "same"])]
    for n in (len(rows), 1, 0):
        some = rows[:n]
        got = {r["doc_id"]: r for r in fingerprint_documents(spark.createDataFrame(some, DOCS).withColumn("part", F.lit(1)), rows_per_task=7).collect()}
        assert len(got) == n
        for k, (i, t) in enumerate(some):
            t, after = t or "", some[(k + 1) % n][1] or ""
            cut = len(t) // 4
            edited = t[: len(t) - cut] + after[:cut]
            r = got[i]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = (fingerprint(x.encode()) for x in (t, edited, after))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (str(a), str(b))
            assert np.allclose([r["near_edited"], r["near_next"]], likeness([(a, b), (a, c)]))
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], DOCS)
    assert fingerprint_documents(twice).count() == 3


def test_open_windows_and_best_fit():
    free = OpenWindows(10)
    for w, left in enumerate((3, 7, 7, 10)):
        free.put(w, left)
    assert free.tightest(4) == (2, 7) and free.tightest(4) == (1, 7) and free.tightest(8) == (3, 10) and free.tightest(4) is None and free.tightest(1) == (0, 3)
    draw = random.Random(5)
    for _ in range(20):
        lengths = sorted((draw.randint(1, 64) for _ in range(80)), reverse=True)
        got, at = best_fit_decreasing(np.array(lengths), 64)
        lefts, want = [], []
        for x in lengths:
            fits = [k for k, left in enumerate(lefts) if left >= x]
            best = min((lefts[k] for k in fits), default=None)
            want.append(best)
            if best is None:
                lefts.append(64 - x)
            else:
                lefts[lefts.index(best)] -= x
        assert len(set(got.tolist())) == len(lefts)
        for w in set(got.tolist()):
            spans = sorted((a, a + x) for x, a, g in zip(lengths, at.tolist(), got.tolist()) if g == w)
            assert spans[0][0] == 0 and all(b == c for (_, b), (c, _) in zip(spans, spans[1:])) and spans[-1][1] <= 64


def test_packing(spark):
    rows = [(k, t) for k, t in enumerate(ODD + [text(k, 300 + 40 * k) for k in range(20)])]
    got = pack_documents(spark.createDataFrame(rows, DOCS).withColumns({"start": F.lit(1), "ids": F.lit("x")}), PATH, capacity=256, group_pieces=16, with_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    want = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    for k, ids in want.items():
        own = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
        assert [i for r in own for i in r["ids"]] == ids
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"], r["length"]) == (at, len(ids), len(r["ids"]))
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
    assert pack_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], DOCS), PATH).count() == 3


def split_urls(spark, urls):
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["tokens"]) for r in rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens")).collect()}
    return [found[k] for k in range(len(urls))]


def test_urls(spark):
    cases = {"http://A.Com/x?y#z": ("a.com", "/x"), "https://a.b": ("a.b", ""), "a.com/x": ("", ""), None: ("", ""), "": ("", ""), "x://?q": ("", ""), "x://h#/p": ("h", ""), "x://h/a://b/c": ("h", "/a://b/c"), "x://É.Com/İ": ("É.com", "/İ"), "https://a.com\n": ("a.com\n", ""), "x\ny://a\r/\n?": ("a\r", "/\n"), "x://h/p?": ("h", "/p"), "://h/": ("h", "/")}
    assert [x[:2] for x in split_urls(spark, cases)] == list(cases.values())
    rules = [HostRule("com", "/", "allow"), HostRule("example.com", "/en/", "block"), HostRule("www.example.com", "/en/", "allow"), HostRule("net", "/es/", "block")]
    index = HostIndex(rules)
    for host, path, want in (("x.com", "/", "com/"), ("x.com", "", None), ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("a.www.example.com", "/en/", "www.example.com/en/"), ("badexample.com", "/en/", "com/"), ("net", "/es/x", "net/es/"), ("a.net", "/en/", None)):
        brute = max((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(str(r)), default=None)
        found = index.match(host, path)
        assert found == brute and (str(found) if found else None) == want
    assert split_urls(spark, ["http://b.com/b/12?page=2&page=3&ref#?no=1", "http://b.com#x?q=1", "?"]) == [("b.com", "/b/12", ["h0:com", "h1:b", "p:b", "p:0", "q:page", "q:ref"]), ("b.com", "", ["h0:com", "h1:b"]), ("", "", [])]


def test_mining_and_judging(spark):
    draw = random.Random(3)
    rows = []
    for k in range(600):
        host, lang, key = draw.choice(["good", "bad", "meh"]), draw.choice(["en", "fr"]), draw.choice(["page", "ref"])
        rows.append((f"http://{host}.org/{lang}/{k}?{key}=1", int(host == "bad" and lang == "fr" or draw.random() < 0.05)))
    rows += [(None, 1), ("http://bad.org/fr/1", None)]
    table = spark.createDataFrame(rows, "url string, label int")
    sets = [(set(t), y) for (_, _, t), (u, y) in zip(split_urls(spark, [u for u, _ in rows]), rows) if t and y is not None]
    for most in (10, 3):  # few items make sub-sets of the URLs' tokens
        mined = mine_rules(table, min_support=0.02, min_confidence=0.7, most_items=most)
        want = set()
        every = sorted(set().union(*(s for s, _ in sets)))
        stats = {}
        for c in (c for n in (1, 2, 3) for c in combinations(every, n)):
            hit = [y for s, y in sets if s.issuperset(c)]
            if sum(hit) >= max(6, 0.02 * len(sets)) and surely(sum(hit), len(hit)) >= 0.7:
                stats[c] = sum(hit) / len(hit)
        want = {c for c in stats if not any(d != c and set(d) <= set(c) and stats[d] >= stats[c] for d in stats)}
        assert {r.tokens for r in mined} == want and ("h1:bad", "p:fr") in want
        for r in mined:
            hit = [y for s, y in sets if set(r.tokens) <= s]
            assert r.confidence == pytest.approx(sum(hit) / len(hit)) and r.support == pytest.approx(sum(hit) / len(sets))
    tokens = ["a", "b", "c", "d"]
    every = [c for n in (1, 2, 3) for c in combinations(tokens, n)]
    assert [every[k] for k in TokenIndex(every).match(["a", "c", "x"])] == [("a",), ("c",), ("a", "c")]
    pages = spark.createDataFrame([(1, "http://bad.org/fr/9"), (2, "http://bad.org/en/9"), (3, None), (4, "http://x.com/"), (4, "http://x.com/")], "page_id long, url string").withColumn("verdict", F.lit("?"))
    got = judge_urls(pages, [HostRule("com", "/", "allow")], [MinedRule(("h1:bad", "p:fr"), 0.1, 0.9)])
    assert sorted((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in got.fillna("-").collect()) == [(1, "bad.org", "-", "block"), (2, "bad.org", "-", "allow"), (3, "", "-", "allow"), (4, "x.com", "com/", "allow"), (4, "x.com", "com/", "allow")]
    assert judge_urls(pages.limit(0), [], []).count() == 0 and mine_rules(spark.createDataFrame([], "url string, label int")) == []


def test_mining_long_urls(spark):
    """URLs of 60 frequent segments don't make FP-growth exponential."""
    rows = [("http://bad.org/" + "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), 1)] * 50 + [("http://good.org/x", 0)] * 50
    mined = mine_rules(spark.createDataFrame(rows, "url string, label int"))
    assert {r.tokens for r in mined} == {("h1:bad",)} | {(f"p:s{chr(97 + k % 26)}{chr(97 + k // 26)}",) for k in range(60)}
    assert all(len(p) <= 6 for p in _parts(list("abcdefghijk"), 10)) and {c for p in _parts(list("abcdefghijk"), 10) for c in combinations(sorted(p), 3)} == set(combinations("abcdefghijk", 3))


def test_labelled_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, "http://best-casino.org/"), (3, None), (3, "http://b.org"), (None, "http://c.org"), (9, "http://casinos.org")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (None, 1), (9, None)], "doc_id long, bad int")
    got = labelled_urls(pages, labels, F.col("bad"), junk=("casino",)).collect()
    assert sorted(((r["url"] or "", r["label"]) for r in got)) == [("", 0), ("http://a.org/", 1), ("http://b.org", 0), ("http://best-casino.org/", 1)]
    assert labelled_urls(pages, labels, F.col("bad")).count() == 4


def test_registered_url_rules(spark, tmp_path):
    """The query blocks what no fixed rule decides through mined rules; labels that don't depend on URLs make none."""
    from braidlog.llm.queries import op9_url_rules

    rows = [(k, f"http://www.{'spam-farm' if k % 4 == 0 else 'fine'}.example.org/en/{k}") for k in range(80)] + [(100, "http://www.spam-farm.example.com/en/1"), (101, "http://x.net/fr/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(1, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["mined"]) for r in op9_url_rules(spark, str(tmp_path)).collect()}
    assert got[100][:2] == ("example.com/en/", "block") and got[101][:2] == ("net/fr/", "block")
    assert all(got[k] == ((None, "block", "h2:spam-farm") if k % 4 == 0 else (None, "allow", None)) for k in range(80))


def test_transducer():
    draw = random.Random(2)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 6))).encode(): [k % 50, k] for k in range(300)} | {b"\xc3\xa9s": [7]}
    machine = Transducer.mapped(Transducer.compile(words))
    order = sorted(words)
    assert machine.numbers(order).tolist() == list(range(len(order)))
    assert [machine.ids_of(k).tolist() for k in range(len(order))] == [words[w] for w in order]
    others = [w for w in (b"", b"abcabcabc", b"zz", b"\xc3") if w not in words]
    assert machine.numbers(others).tolist() == [-1] * len(others)

    def least(items):  # states of the minimal automaton: distinct sets of endings
        endings = {}
        for w in items:
            for k in range(len(w) + 1):
                endings.setdefault(w[:k], set()).add(w[k:])
        return len({frozenset(e) for e in endings.values()})

    assert len(machine.final) - 1 == least(words)
    none = Transducer.mapped(Transducer.compile({}))
    assert none.numbers([b"a", b""]).tolist() == [-1, -1]


def test_bpe_is_the_library(spark):
    library, vocabulary = Tokenizer.from_file(PATH), Vocabulary(PATH)
    draw = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(draw.choice(" \n\t'sabcé½0Ⅷ३　<|endoftext>\x1f_-!我😀ßª٠") for _ in range(draw.randint(1, 60))) for _ in range(400)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for memo in (1 << 18, 1):
        encoder = Encoder(vocabulary, Transducer.mapped(compile_lexicon([" word", "word", "ab"], PATH)), memo)
        assert [x.tolist() for k in range(0, len(texts), 50) for x in encoder.encode(texts[k : k + 50])] == want
    assert [fast_encoder(PATH)(t).tolist() for t in texts] == want
    merger = Merger(vocabulary)
    for w in (b"abcabcabcabc" * 9, b"a" * 200, b"hello"):
        assert merger._short([merger.byte[b] for b in w]) == merger._long([merger.byte[b] for b in w])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], DOCS).withColumn("ids", F.lit(1))
    encoded = encode_documents(docs, PATH)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    for k, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[k]["ids"], "<u4").tolist() == ids and rows[k]["n_tokens"] == len(ids)
    back = {r["doc_id"]: r["decoded"] for r in decode_documents(encoded, PATH).collect()}
    assert back == {k: t or "" for k, t in enumerate(ODD)}
    assert encode_documents(docs.limit(0), PATH).count() == 0
    broken = spark.createDataFrame([(1, bytearray(np.array([vocabulary.id_of[b"\xc3"]], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: r["decoded"] for r in decode_documents(broken, PATH).collect()} == {1: "\ufffd", 2: ""}
    assert frequent_words(spark.createDataFrame([(1, "a b a b c a")], DOCS), PATH, lexicon=2) == [" a", " b"]
    assert frequent_words(spark.createDataFrame([(1, f"a{'x' * 70} b\n" * 3)], DOCS), PATH) == ["\n", " b"]
    assert Splitter().words("don't") == ["don", "'t"]
