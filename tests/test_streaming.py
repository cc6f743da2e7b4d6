import random

import pytest

from braidlog.plans.features import endogenous_features
from braidlog.streaming.features import DYAD, TriadSink, dyad_state, ready, stream_degree, stream_dyad_features

SCHEMA = "sender string, receiver string, time double, rid long"


@pytest.fixture(scope="module")
def log():
    draw = random.Random(4)
    return [(f"a{draw.randrange(5)}", f"a{draw.randrange(5)}", float(k), k) for k in range(80)]


def played(spark, tmp_path, rows, batches, make, name):
    """Runs make over the rows as a stream of batches; gives the sink's table."""
    ready(spark)
    source = tmp_path / f"in-{name}"
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.parquet(str(source / f"b{k}"))
        import os
        import time

        for f in (source / f"b{k}").glob("*.parquet"):  # read in this order
            os.utime(f, (time.time() - 1000 + k, time.time() - 1000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"select * from {name}")


def close(a, b, stats):
    a, b = ({r["rid"]: r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for s in stats:
            x, y = a[k][s], b[k][s]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (k, s, x, y)


def test_stream_equals_batch(spark, tmp_path, log):
    whole = endogenous_features(spark.createDataFrame(log, SCHEMA), [*DYAD, "sender_outdegree"], 6.0)
    close(played(spark, tmp_path, log, 4, lambda s: stream_dyad_features(s, 6.0), "dyads"), whole, DYAD)
    close(played(spark, tmp_path, log, 4, stream_degree, "degrees"), whole, ["sender_outdegree"])


def test_initial_state(spark, tmp_path, log):
    whole = endogenous_features(spark.createDataFrame(log, SCHEMA), DYAD, 6.0).filter("rid >= 40")
    before = dyad_state(spark.createDataFrame(log[:40], SCHEMA), 6.0)
    close(played(spark, tmp_path, log[40:], 2, lambda s: stream_dyad_features(s, 6.0, before), "warm"), whole, DYAD)


def test_many_pairs_share_a_call(spark, tmp_path):
    """State is read and written by buckets of pairs: 20,000 pairs in two batches, from few buckets and blocks, equal one run."""
    rows = [(f"s{k % 20_000}", f"r{k % 20_000}", float(k), k) if k % 40_000 < 20_000 else (f"r{k % 20_000}", f"s{k % 20_000}", float(k), k) for k in range(60_000)]
    got = played(spark, tmp_path, rows, 2, lambda s: stream_dyad_features(s, 5e4, buckets=16), "shared")
    whole = endogenous_features(spark.createDataFrame(rows, SCHEMA), DYAD, 5e4)
    close(got, whole, DYAD)


def test_late_rows_are_given_without_statistics(spark, tmp_path):
    rows = [("a", "b", 1.0, 0), ("b", "a", 5.0, 1), ("a", "b", 3.0, 2), ("b", "a", 5.0, 3), ("a", "b", 6.0, 4), ("c", "a", 2.0, 5)]
    got = {r["rid"]: r for r in played(spark, tmp_path, rows, 3, stream_dyad_features, "late_dyads").collect()}
    assert [got[k]["late"] for k in range(6)] == [False, False, True, False, False, False]
    assert got[2]["reciprocity_count"] is None and got[4]["reciprocity_count"] == 2.0 and got[4]["recency"] == 5.0
    got = {r["rid"]: (r["sender_outdegree"], r["late"]) for r in played(spark, tmp_path, rows, 3, stream_degree, "late_degrees").collect()}
    assert got == {0: (0.0, False), 1: (0.0, False), 2: (1.0, False), 3: (1.0, False), 4: (2.0, False), 5: (0.0, False)}
    back = [("a", "b", 1.0, 0), ("a", "c", 5.0, 1), ("a", "b", 3.0, 2), ("a", "b", 5.0, 3)]
    got = {r["rid"]: (r["sender_outdegree"], r["late"]) for r in played(spark, tmp_path, back, 2, stream_degree, "late_again").collect()}
    assert got == {0: (0.0, False), 1: (1.0, False), 2: (None, True), 3: (2.0, False)}


def test_two_paths_by_batches(spark, tmp_path, log):
    stats = ["transitivity_count", "cyclic_count_ordered", "sending_balance_time_recent_interrupted"]
    sink = TriadSink(str(tmp_path / "kept"), stats)
    # Strict order within a batch is the order of the whole, since times differ.
    for k in range(4):
        sink(spark.createDataFrame(log[k * 20 : k * 20 + 20], SCHEMA), k)
    sink(spark.createDataFrame(log[60:], SCHEMA), 3)  # given again
    got = spark.read.parquet(str(tmp_path / "kept" / "features"))
    frame = spark.createDataFrame(log, SCHEMA)
    close(got, endogenous_features(frame, stats, history=frame), stats)


def test_segments_of_two_paths():
    sink = TriadSink("unused", ["cyclic_count"])
    for n in range(1, 300):
        held = sink._segments(n)
        assert held[0][0] == 0 and held[-1][1] == n and all(a[1] == b[0] for a, b in zip(held, held[1:]))
        assert len(held) <= 3 * 5
        # Each was written by a batch before: alone, or by folding smaller ones.
        assert all(b - a == 1 or (a, b) in sink._folded(b) for a, b in held)
    assert sink._folded(16) == [(12, 16), (0, 16)] and sink._folded(17) == []


def test_a_batch_reads_its_own_actors_events(spark, tmp_path):
    """The past of a batch follows its actors, not the past: folded segments, replayed batches and late rows included."""
    draw = random.Random(9)
    rows = [(f"a{draw.randrange(9)}", f"a{draw.randrange(9)}", float(k), k) for k in range(60)]
    rows += [(f"x{k}", f"y{k % 7}", float(k % 50), 100 + k) for k in range(400)]
    rows.sort(key=lambda r: (r[2], r[3]))
    stats = ["receiving_balance_time_first_ordered"]
    sink = TriadSink(str(tmp_path / "many"), stats, buckets=5)
    cuts = [r for r in range(0, len(rows) + 1, 92)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    assert len(batches) == 5
    for k, batch in enumerate(batches):
        sink(spark.createDataFrame(batch, SCHEMA), k)
        if k == 3:
            sink(spark.createDataFrame(batch, SCHEMA), k)
    asked = spark.createDataFrame([("a1", "a2", 60.0, 999)], SCHEMA)
    own = sorted((s, r, t) for s, r, t, _ in rows if {s, r} & {"a1", "a2"})
    assert sorted(map(tuple, sink.past(asked, 5).collect())) == own
    # Four segments of one batch are one now, and the last stands alone.
    kept = {p.name for p in (tmp_path / "many" / "events").iterdir()}
    assert kept == {"segment=0-4", "segment=4-5"}
    plan = sink.past(asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    got = {r["rid"]: r for r in spark.read.parquet(str(tmp_path / "many" / "features")).collect()}
    assert len(got) == len(rows)
    # Rows of one batch with equal times see each other's past only, as one strict run does.
    for k, batch in enumerate(batches):
        past = [r for b in batches[:k] for r in b]
        frame = spark.createDataFrame(batch, SCHEMA)
        want = endogenous_features(frame, stats, prior_log=spark.createDataFrame(past, SCHEMA).drop("rid") if past else spark.createDataFrame([], SCHEMA).drop("rid"))
        for r in want.collect():
            assert all(r[s] == got[r["rid"]][s] for s in stats)


def test_empty_batches_and_nulls_of_two_paths(spark, tmp_path):
    sink = TriadSink(str(tmp_path / "nulls"), ["transitivity_count"])
    sink(spark.createDataFrame([], SCHEMA), 0)
    sink(spark.createDataFrame([("a", "k", 1.0, 0), (None, "k", 1.0, 1), ("k", "b", None, 2), ("k", "b", 2.0, 3), ("c", "c", 2.0, 4)], SCHEMA), 1)
    sink(spark.createDataFrame([("a", "b", 3.0, 5), ("c", "c", 4.0, 6)], SCHEMA), 2)
    got = {r["rid"]: r["transitivity_count"] for r in spark.read.parquet(str(tmp_path / "nulls" / "features")).collect()}
    assert got.keys() == set(range(7)) and {k: got[k] for k in (0, 3, 4, 5, 6)} == {0: 0.0, 3: 0.0, 4: 0.0, 5: 1.0, 6: 0.0}
