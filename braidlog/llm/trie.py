"""Prefix tries of conversations: nodes by hashes of prefixes, totals of subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. Nodes that the same conversations pass are a run; runs
branch at their ends only, so there are at most twice as many as different conversations. Each run's
largest child (by members) continues its path, and any other child begins a path of its own. Between the
root and a leaf at most log2(members) paths begin, so that many rounds pass what light paths hold up to
the runs that they hang from; sums from the end of each path give every subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlog.llm.common import WHITE, attach, discard, tidied, written
from braidlog.plans.segments import dealt

#: Turns of a conversation that one window takes; longer ones are dealt by place.
STRETCH = 1 << 16
#: Members' numbers that are joined by one task before they are hashed.
JOINED = 4096


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, c1, c2, words: a turn as two hashes of role and text and the words of its text. Null roles and texts are empty; rows without a conversation go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.size(F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != ""))
    return conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("c1"), F.xxhash64(F.lit(2), role, text).alias("c2"), words.alias("words")
    ).filter("conv IS NOT NULL")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, place (from 1), c1, c2, words, by turn (null first) and, at equal turns, by the hashes. A long conversation is dealt by ranges of that order."""
    order = ["turn", "c1", "c2"]
    parts = dealt(turns, ["conv"], order)
    rows, keys = parts.rows, ["conv"]
    if parts.cut:
        rows, keys = parts.with_begun(parts.begun({"n": F.count(F.lit(1))}, lambda s: [{"begun": sum(r["n"] for r in s[:k])} for k in range(len(s))])), ["conv", "__seg"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return rows.select("conv", (place + F.coalesce(F.col("begun"), F.lit(0)) if parts.cut else place).alias("place"), "c1", "c2", "words")


def _xor_before(rows: DataFrame, longest: int) -> DataFrame:
    """rows (conv, depth, t1, t2, ...) with k1, k2: the xor of t1 and of t2 up to the row."""
    rows = rows.withColumn("__part", F.floor(F.col("depth") / STRETCH))
    upto = Window.partitionBy("conv", "__part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({k: F.bit_xor(t).over(upto) for k, t in (("k1", "t1"), ("k2", "t2"))})
    if longest >= STRETCH:
        parts = rows.groupBy("conv", "__part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
        before = Window.partitionBy("conv").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("conv", "__part", F.bit_xor("x1").over(before).alias("b1"), F.bit_xor("x2").over(before).alias("b2"))
        out = out.join(parts, ["conv", "__part"]).withColumns({k: F.col(k).bitwiseXOR(F.coalesce(F.col(b), F.lit(0).cast("long"))) for k, b in (("k1", "b1"), ("k2", "b2"))}).drop("b1", "b2")
    return out.drop("__part")


def _placed_hash(number: int, c1: Column, c2: Column, depth: Column) -> Column:
    return F.xxhash64(F.lit(number), depth.cast("long"), c1, c2)


def rebuilt_prefixes(turns: DataFrame, head: Column, donor: Column) -> DataFrame:
    """conv, depth, k1, k2, p1, p2, words, last for every prefix of every rebuilt conversation, from depth 0.

    turns: as turns_of gives them. A conversation becomes the first head turns of its donor (all if it has
    fewer, none if there is no such conversation) and then its own turns after its first head; head and
    donor are expressions over conv, head small. k1, k2 stand for the prefix, p1, p2 for the one before it.
    """
    rows = written(numbered_turns(turns), "turns")
    convs = rows.groupBy("conv").agg(F.max("place").alias("n")).withColumns({"head": head.cast("long"), "donor": donor})
    total, most, longest = convs.agg(F.sum("n"), F.max("head"), F.max("n")).first()
    if total is None:
        most, total, longest = 0, 0, 0
    given = convs.select(F.col("donor").alias("conv")).distinct()
    given = rows.filter(F.col("place") <= most).join(given, "conv", "left_semi").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "c1", "c2", "words"))).alias("first"))
    convs = convs.join(given.select(F.col("conv").alias("donor"), "first"), "donor", "left")
    convs = convs.withColumn("first", F.slice(F.coalesce("first", F.array().cast(given.schema["first"].dataType)), F.lit(1), F.col("head").cast("int")))
    convs = convs.withColumn("given", F.size("first").cast("long")).withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    hashed = F.transform("first", lambda x: F.struct(_placed_hash(1, x["c1"], x["c2"], x["place"]).alias("t1"), _placed_hash(2, x["c1"], x["c2"], x["place"]).alias("t2"), x["words"].alias("words")))
    convs = written(convs.select("conv", "n", "head", "given", "length", hashed.alias("first")), "conversations")
    xor = lambda items, t: F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[t]))
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), F.lit(0).alias("words"), (F.col("length") == 0).alias("last"))
    heads = convs.select("conv", "length", "first", F.posexplode("first").alias("at", "x")).withColumns({"depth": (F.col("at") + 1).cast("long"), "k1": xor(F.slice("first", F.lit(1), F.col("at") + 1), "t1"), "k2": xor(F.slice("first", F.lit(1), F.col("at") + 1), "t2")})
    heads = heads.select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x.t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x.t2")).alias("p2"), F.col("x.words").alias("words"), (F.col("length") == F.col("depth")).alias("last"))
    known = convs.select("conv", "n", "head", "given", "length", xor(F.col("first"), "t1").alias("h1"), xor(F.col("first"), "t2").alias("h2"))
    own = attach(rows, known, "conv", "n", total, F.col("place")).filter("place > head").withColumn("depth", F.col("place") - F.col("head") + F.col("given"))
    own = own.select("conv", "depth", "words", "length", "h1", "h2", _placed_hash(1, F.col("c1"), F.col("c2"), F.col("depth")).alias("t1"), _placed_hash(2, F.col("c1"), F.col("c2"), F.col("depth")).alias("t2"))
    own = _xor_before(own, longest + most).withColumns({"k1": F.col("k1").bitwiseXOR(F.col("h1")), "k2": F.col("k2").bitwiseXOR(F.col("h2"))})
    own = own.select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "words", (F.col("length") == F.col("depth")).alias("last"))
    return root.unionByName(heads).unionByName(own)


def _node(depth: str | Column, *keys: str) -> Column:
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.struct(depth.alias("depth"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _ends(prefixes: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes at which conversations end. Numbers are joined by ranges of (node, number) first, so the task that hashes a node reads few rows of its."""
    kind = _node("depth", "k1", "k2")
    ended = prefixes.filter("last").select(kind.alias("node"), "conv")
    joined_schema = T.StructType([ended.schema["node"], T.StructField("first", T.LongType()), T.StructField("text", T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(convs):
                end = at + 1
                while end < len(convs) and end < at + JOINED and nodes[end] == nodes[at]:
                    end += 1
                out.append((nodes[at], convs[at], ",".join(map(str, convs[at:end])).encode()))
                at = end
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["node", "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != now:
                    if now is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = node, hashlib.sha256(text)
                else:
                    hashed.update(b"," + text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([hashed.hexdigest()])], ["node", "ends_sha256"])

    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = ended.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(tidied(join), joined_schema)
    return chunks.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(tidied(digest), T.StructType([ended.schema["node"], T.StructField("ends_sha256", T.StringType())]))


def _heads(runs: DataFrame, rounds: int = 64) -> DataFrame:
    """run, path: the run at the top of each run's path. Pointers to the parent double until all stand at a top; what is settled isn't read again."""
    heavy = runs.filter("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct(-F.col("run.n"), F.col("run.conv"))).alias("m")).select("parent", F.struct(F.col("m.conv").alias("conv"), (-F.col("m.col1")).alias("n")).alias("run"))
    heavy = written(heavy, "heavy")
    light = runs.select("run").join(heavy.select("run"), "run", "left_anti").select("run", F.col("run").alias("path"))
    # up: the run that is 1, 2, 4, ... steps above a run of a path; done: whether that is the path's top.
    tops = light.select(F.col("run").alias("parent"), F.lit(True).alias("top"))
    moving = written(heavy.select("run", F.col("parent").alias("up")).join(tops.withColumnRenamed("parent", "up"), "up", "left").select("run", "up", F.coalesce("top", F.lit(False)).alias("done")), "ups")
    for _ in range(rounds):
        if moving.filter("NOT done").isEmpty():
            break
        to = moving.select(F.col("run").alias("up"), F.col("up").alias("__up"), F.col("done").alias("__done"))
        ahead = moving.filter("NOT done").join(to, "up").select("run", F.col("__up").alias("up"), F.col("__done").alias("done"))
        last, moving = moving, written(moving.filter("done").unionByName(ahead), "ups")
        discard(last)
    return light.unionByName(moving.select("run", F.col("up").alias("path")))


def prefix_trie(prefixes: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node.

    prefixes: conv, depth, k1, k2, p1, p2, words, last, a row for each prefix of each conversation, the empty one too.
    A node's conv_id is its smallest member, whose turn at that depth is the node's last. 128 bits of hashes
    stand for a prefix. saved_tokens sums (n_convs - 1) * words over a subtree; ends_sha256 is the hash of the
    members that end at the node. Groups of any size are summed before they are shuffled, or dealt.
    """
    prefixes = written(prefixes, "prefixes")
    node, up = _node("depth", "k1", "k2"), F.when(F.col("depth") > 0, _node(F.col("depth") - 1, "p1", "p2"))
    nodes = prefixes.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").cast("long").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = written(nodes.select(node.alias("node"), up.alias("up"), F.struct(F.col("conv_id").alias("conv"), F.col("n_convs").alias("n")).alias("run"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "depth"), "nodes")
    total = nodes.count()
    children = nodes.filter("up IS NOT NULL").groupBy("up").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children.withColumnRenamed("up", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tops = nodes.select(F.col("node").alias("up"), F.col("run").alias("parent"), F.col("n_children").alias("siblings")).filter("siblings > 0")
    nodes = written(attach(nodes, tops, "up", "siblings", total, F.col("node")).drop("siblings"), "family")
    runs = nodes.groupBy("run").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.count(F.lit(1)).alias("length"), F.sum("saved").alias("saved"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.min_by("parent", "depth").alias("parent"), F.min_by("n_children", -F.col("depth")).alias("kids"))
    runs = written(runs, "runs")
    placed = runs.join(_heads(runs), "run")
    # The path of what a path hangs from.
    above = placed.filter("kids > 0").select(F.col("run").alias("parent"), F.col("path").alias("above"), "kids")
    placed = written(placed, "placed")
    hung = attach(placed.filter("run = path AND parent IS NOT NULL").select("path", "parent"), above, "parent", "kids", total, F.col("path")).select("path", "parent", "above")
    hung = written(hung, "hung")
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    message = placed.groupBy("path").agg(*sums)
    passed = []
    for _ in range(64):  # at most log2(members) rounds have a message
        message = written(message.join(hung, "path"), "message")
        if message.isEmpty():
            break
        passed.append(message.groupBy(F.col("parent").alias("run")).agg(*sums))
        message = message.groupBy(F.col("above").alias("path")).agg(*sums)
    held = placed.select("run", "path", "top", "length", "leaves", "saved", F.col("saved").alias("own"))
    for part in passed:
        more = part.select("run", F.col("leaves").alias("__leaves"), F.col("saved").alias("__saved"))
        held = held.join(more, "run", "left").withColumns({c: F.col(c) + F.coalesce(f"__{c}", F.lit(0).cast("long")) for c in ("leaves", "saved")}).drop("__leaves", "__saved")
    below = Window.partitionBy("path").orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, 0)
    held = held.select("run", "length", F.sum("leaves").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("__all"), "own")
    out = attach(nodes, held, "run", "length", total, F.col("node"))
    # Within a run: what its nodes up to the end have, and what hangs below the run.
    out = out.withColumn("__part", F.floor(F.col("depth") / STRETCH))
    rest = F.sum("saved").over(Window.partitionBy("run", "__part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__rest", rest)
    deepest = runs.agg(F.max("bottom")).first()[0] or 0
    if deepest >= STRETCH:
        later = Window.partitionBy("run").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
        parts = nodes.groupBy("run", F.floor(F.col("depth") / STRETCH).alias("__part")).agg(F.sum("saved").alias("s")).select("run", "__part", F.sum("s").over(later).alias("__later"))
        out = out.join(parts, ["run", "__part"]).withColumn("__rest", F.col("__rest") + F.coalesce("__later", F.lit(0).cast("long")))
    out = out.join(_ends(prefixes), "node", "left")
    return out.select(
        F.col("run.conv").alias("conv_id"), "depth", F.col("parent.conv").alias("parent_conv_id"), F.col("run.n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("__all") - F.col("own") + F.col("__rest")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 20, heads: int = 4) -> DataFrame:
    """The trie of rebuilt conversations: the first h turns of conversation c - c % every, then c's own after its first h; h is crc32(c as text) % heads.

    Turns are ordered by turn, null first, and at equal turns by hashes of role and text, so repeated rows
    are turns of their own in a defined order. Null roles and texts are empty; rows without a conversation
    are left out; for a negative c, % has its sign. A very long text is hashed where it is read, and a very long
    conversation is dealt by ranges of its turns. An empty table gives no rows; other columns aren't read.
    """
    turns = turns_of(conversations, conv_col, turn_col, role_col, text_col)
    return prefix_trie(rebuilt_prefixes(turns, F.crc32(F.col("conv").cast("string").cast("binary")) % heads, F.col("conv") - F.col("conv") % every))
