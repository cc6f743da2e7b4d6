"""Exact dedup, sharding and chat formatting: brute force, edge cases, and no Python in their plans."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from braidlog.llm.chat import format_conversations, parse_conversations
from braidlog.llm.common import attach, without
from braidlog.llm.dedup import drop_exact_duplicates, exact_groups
from braidlog.llm.sharding import assign_shards

DOCS = "doc_id long, text string, lang string"
TEXTS = ["a b c", "abc", "ab\tc ", "abd", "", None, " \n\x0b\x0c\r", "é é", "éé", "x" * 5000 + " y", "x" * 5000 + "y", "x" * 5000 + "z", "a\x1cb", "ab"]


def docs(spark, texts=TEXTS, first=0):
    return spark.createDataFrame([(k + first, t, "en") for k, t in enumerate(texts)], DOCS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_groups_against_brute_force(spark):
    texts = TEXTS + ["abc"] * 40 + [" " * (k % 3) + f"t{k % 7}" for k in range(60)]
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k))
    want = {k: (min(g)[1], len(g)) for g in groups.values() for _, k in g}
    for bits in (1 << 25, 32768):  # a small bitmap only costs more full hashes
        for limit in (1, 1000):
            got = exact_groups(docs(spark, texts), filter_bits=bits, prefix_chars=limit)
            assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got.collect()} == want
            assert got.filter("kept <> (doc_id = keep_id)").isEmpty()
    assert {r["doc_id"] for r in drop_exact_duplicates(docs(spark, texts)).collect()} == {k for k, _ in want.values()}
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)


def test_exact_groups_edges(spark):
    assert exact_groups(docs(spark).limit(0)).count() == 0 and drop_exact_duplicates(docs(spark).limit(0)).count() == 0
    twice = docs(spark, ["q", "q"]).union(docs(spark, ["q"]))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(twice).collect()) == [(0, 0, 3, False), (0, 0, 3, True), (1, 0, 3, False)]
    assert [r["doc_id"] for r in drop_exact_duplicates(twice).collect()] == [0]
    named = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", "z"), (None, "x y"), (None, "q"), (None, "q")], "doc_id string, text string")
    assert sorted(((r["doc_id"] or "", r["keep_id"] or "", r["group_size"], r["kept"]) for r in exact_groups(named).collect())) == [("", "", 2, False), ("", "", 2, True), ("", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False), ("c", "c", 1, True)]
    assert sorted((r["doc_id"] or "") for r in drop_exact_duplicates(named).collect()) == ["", "a", "c"]
    odd = docs(spark, ["q", "q"]).withColumns({"kept": F.lit(1), "__len": F.lit(2), "keep_id": F.lit(3)}).union(spark.createDataFrame([(None, "q", None, 1, 2, 3)], "doc_id long, text string, lang string, kept int, `__len` int, keep_id int"))
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [0]
    assert set(exact_groups(odd, carry=("lang", "kept")).columns) == {"doc_id", "lang", "keep_id", "group_size", "kept"}


def test_attach_with_hot_keys(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"))
    groups = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = attach(rows, groups, "k", "n", 5000, F.col("id"), hot_keys=100)
    assert got.count() == 5000 and got.filter("k = 0 AND n <> 1667").isEmpty() and got.filter("k IS NULL AND n IS NOT NULL").isEmpty() and got.filter("k > 0 AND n <> 1").isEmpty()


def test_without(spark):
    table = docs(spark, ["x"] * 500).union(spark.createDataFrame([(None, "n", "en")], DOCS))
    dropped = spark.range(0, 500, 5).withColumnRenamed("id", "d")
    for bits in (1 << 25, 32768):
        assert {r["doc_id"] for r in without(table, "doc_id", dropped, bits).collect()} == {k for k in range(500) if k % 5} | {None}
    assert without(table, "doc_id", dropped.limit(0)).count() == 501


def bid(key, shard):
    first = xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), first) >> 11


def test_rendezvous(spark):
    keep = {"size": F.octet_length(F.coalesce("text", F.lit(""))) + 16, "crc": F.crc32(F.coalesce("text", F.lit("")))}
    texts = ["é" * (k % 9) for k in range(3000)]
    got = {r["doc_id"]: r for r in assign_shards(docs(spark, texts), keep=keep).collect()}
    for k in range(0, 3000, 97):
        bids = [bid(k, s) for s in range(41)]
        assert got[k]["shard"] == bids[:40].index(max(bids[:40])) and got[k]["grown_shard"] == (40 if bids[40] > max(bids[:40]) else got[k]["shard"])
        assert got[k]["size"] == len(texts[k].encode()) + 16 and got[k]["crc"] == zlib.crc32(texts[k].encode())
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 40 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    more = {r["doc_id"]: r["shard"] for r in assign_shards(docs(spark, texts), weights=(1.0,) * 41).collect()}
    assert all(more[k] == r["grown_shard"] for k, r in got.items())
    fewer = {r["doc_id"]: r["shard"] for r in assign_shards(docs(spark, texts), weights=(1.0,) * 39).collect()}
    assert all(fewer[k] == r["shard"] for k, r in got.items() if r["shard"] < 39)


def test_weights_and_edges(spark):
    got = assign_shards(docs(spark, ["x"] * 4000), weights=(1.0, 3.0)).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 4000 for r in got}
    assert abs(share[1] - 0.75) < 0.04
    same = docs(spark, ["x"]).union(docs(spark, ["x"])).union(spark.createDataFrame([(None, None, None)], DOCS))
    rows = assign_shards(same).collect()
    assert len(rows) == 3 and len({r["shard"] for r in rows if r["doc_id"] == 0}) == 1
    assert assign_shards(same.limit(0)).count() == 0
    for bad in ({"weights": ()}, {"weights": (1.0, 0.0)}, {"keep": {"slot": F.lit(1)}}):
        with pytest.raises(ValueError):
            assign_shards(same, **bad)


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = ["</turn>", "<turn>user<text>", r"\### Assistant: </turn> ok", "\\l\\b<and>", "", None, "a\nb", "é<and>\\", "x" * 3000]
    rows = [(c, k, ("user", "assistant", "assistant", "<sys\\")[(c + k) % 4], hard[(c * 3 + k) % len(hard)]) for c in range(12) for k in range(c)]
    formatted = format_conversations(spark.createDataFrame(rows, CHAT), chunk=3)
    got = {r["conv_id"]: r for r in parse_conversations(formatted).collect()}
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == dict(want)
    assert all(t["loss"] == (t["role"] == "assistant") for r in got.values() for t in r["turns"])
    assert {r["conv_id"]: len(r["formatted"]) for r in formatted.collect()} == {c: r["formatted_chars"] for c, r in got.items()}
    two = format_conversations(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], CHAT)).first()["formatted"]
    assert two == "<turn>user<text>a<and>b</turn><turn>assistant<text>c</turn>"
    assert "Python" not in plan_of(parse_conversations(formatted))


def test_chat_edges(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "z"), (1, 5, "user", "a")]
    extra = spark.createDataFrame(rows + [rows[0]], CHAT).withColumns({"__conv": F.lit(1), "formatted": F.lit("x")})
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in parse_conversations(format_conversations(extra)).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "b"), ("user", "b"), ("user", "a")], None: [("assistant", "z")]}
    assert format_conversations(extra.limit(0)).count() == 0


def test_registered_digests(spark, tmp_path):
    from braidlog.llm.queries import op8_chat_format

    rows = [(4, 0, "user", "q"), (4, 1, "assistant", "r"), (4, 2, "assistant", "s")]
    spark.createDataFrame(rows, CHAT).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op8_chat_format(spark, str(tmp_path)).collect()}
    assert got[4]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\nr\nassistant\ns\n").hexdigest()
    assert (got[4]["n_turns"], got[4]["loss_chars"], got[4]["loss_sha256"]) == (3, 2, hashlib.sha256(b"rs").hexdigest())
    said = r"\### Assistant: </turn> ok"
    assert got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-7]["n_turns"] == 2
