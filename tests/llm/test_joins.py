"""N-gram Jaccard join and components against brute force, on groups, ties and edges; the pipeline against its stages."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlog.llm.components import connected
from braidlog.llm.jaccard import Join, Signatures, jaccard_components, shingle_sets

DOCS = "doc_id long, text string"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """n, component of each id, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in rows if k is not None}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            met = len(sets[a] & sets[b])
            if met and 100 * met >= 80 * (len(sets[a]) + len(sets[b]) - met):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def corpus(seed):
    draw = random.Random(seed)
    words = lambda n: [draw.choice("abcdefghijklmnop") + draw.choice("qrstuvwxyz") + draw.choice("aeiou") for _ in range(n)]
    passage = words(55)
    texts = []
    for g in range(14):
        base = words(draw.choice([5, 6, 9, 20, 40, 90, 160]))
        for _ in range(draw.choice([1, 1, 2, 3, 30])):
            t = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                t[draw.randrange(len(t))] = words(1)[0]
            texts.append(" ".join(t) if draw.random() < 0.8 else "\t".join(t).upper())
    for _ in range(30):
        own = words(draw.choice([20, 60, 200]))
        at = draw.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += ["", None, " \n", "one", "ONE", "one two", "a b c d", "a b c d e", "A B C D E", "é É", "é é"]
    draw.shuffle(texts)
    return [(3 * k + 5, t) for k, t in enumerate(texts)]


SMALL = Join(frequent=400, short=4, run=16, block=8, blocks=3, chunk=512, filter_bits=1 << 16)


@pytest.mark.parametrize("join", [Join(), SMALL])
def test_components_against_all_pairs(spark, join):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"n": F.lit(1), "sig": F.lit("x"), "component_id": F.lit(0)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, join=join).collect()}
    assert got == brute(rows)
    assert any(c != k for k, (_, c) in got.items())


def test_jaccard_edges(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None), (8, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (9, 0, 9), (8, 0, 8)], key=str)


def test_rows_of_a_long_list_are_copied_linearly(spark):
    from pyspark.sql import functions as F

    from braidlog.llm.jaccard import _dealt

    join, copies = Join(block=100, blocks=4), []
    for length in (500, 2000, 8000):
        rows = spark.range(length).select(F.lit(1).alias("sig"), F.col("id").alias("doc"), (F.lit(90) + F.col("id") % 20).cast("int").alias("n"), F.lit(80).alias("reach"), F.col("id").alias("comp"), F.lit(length).alias("length"))
        sets = spark.range(length).select(F.col("id").alias("doc"), F.array(F.lit(0).cast("long")).alias("sketch"))
        copies.append(_dealt(rows, sets, join).count() / length)
    assert max(copies) <= 2 * join.blocks


def test_every_link_shares_a_signature():
    """Over random sets and tables of frequent tokens: sets at or over the threshold share a signature that both reach."""
    rng, join = np.random.default_rng(1), Join()
    for _ in range(300):
        n = int(rng.integers(1, 140))
        pool = rng.integers(1, 1 << 60, n + 60).astype(np.uint64)
        base = np.unique(pool[:n])
        gone, new = rng.integers(0, n // 6 + 1), rng.integers(0, n // 6 + 1)
        other = np.unique(np.concatenate([rng.permutation(base)[gone:], pool[n : n + new]]))
        met = len(np.intersect1d(base, other))
        if not met or 100 * met < 80 * (len(base) + len(other) - met):
            continue
        often = np.sort(rng.choice(pool, int(rng.integers(0, len(pool))), replace=False))
        often = np.unique(often)
        index = Signatures(join, often, rng.integers(4, 60, len(often)))
        (a, _, ra), (b, _, rb) = (index.of(s, index.counts(s)) for s in (base, other))
        sizes, reach = np.array([len(base), len(other)]), {}
        shared = np.intersect1d(a, b)
        assert len(shared)
        for s in shared:
            x, y = ra[a == s].max(), rb[b == s].max()
            reach[s] = join.meet(sizes, np.array([x, y]), np.array([0]), np.array([1]))[0]
        assert any(reach.values())


def test_shingle_sets():
    import pyarrow as pa

    texts = ["a b c d e f", "A B C D E F", "a b", "", None, "x"]
    got = [len(s) for s in shingle_sets(pa.array(texts), 5)]
    assert got == [2, 2, 1, 0, 0, 1]


def test_connected(spark):
    draw = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 80)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: find(k) for a, b in links for k in (a, b)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark, tmp_path):
    """Its first two stages by their networks' scores, the next two by brute force, the last by its pieces."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from braidlog.llm.queries import quality_network, toxicity_network

    source = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{source}/documents.parquet")
    docs = table
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.orderBy("doc_id").collect()
        after = stage(spark, docs, source)
        assert after.columns == table.columns
        kept = {r["doc_id"] for r in after.collect()}
        texts = [r["text"] for r in before]
        import pyarrow as pa

        if name == "toxicity":
            want = {r["doc_id"] for r, s in zip(before, toxicity_network(spark, docs, source).scores(pa.array(texts))) if s < pipeline.TOXIC_FROM}
        elif name == "quality classifier":
            want = {r["doc_id"] for r, s in zip(before, quality_network(spark, docs, source).scores(pa.array(texts))) if s >= pipeline.GOOD_FROM}
        elif name == "exact dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
            want = {min(g)[1] for g in groups.values()}
        else:
            want = {k for k, (_, c) in brute([(r["doc_id"], r["text"]) for r in before]).items() if k == c}
        assert kept == want and 0 < len(kept) <= len(before)
        path = str(tmp_path / name.replace(" ", "_"))
        after.write.parquet(path)
        docs = spark.read.parquet(path)
    pieces = pipeline.STAGES[-1][1](spark, docs, source)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Repeated rows, null ids, null texts and columns with names that the stages use; an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    odd = table.withColumns({"__row": F.lit("x"), "sig": F.lit(1), "component": F.lit(2), "__hash": F.lit(None).cast("string")})
    nameless = odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.concat("text", F.lit(" another end of a text that has no id"))})
    odd = odd.unionByName(odd).unionByName(nameless).unionByName(odd.limit(2).withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.lit(None).cast("string")}))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == odd.columns
        path = f"{tmp_path}/{_.replace(' ', '_')}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() == docs.dropDuplicates(["text"]).count() > 0
    last = {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert last == {r["doc_id"] for r in docs.collect()}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
