"""Centroid clustering by dual-tree Lloyd rounds on whole numbers: a cover tree over each block of vectors, a tree over the centroids.

A block's tree is made once and kept with the block. In each round pairs of a tree node and a centroid
node are taken down together: a pair goes when its least possible distance exceeds the greatest that the
node's vectors can have to another centroid, and a node that one centroid is left for is settled with all
its vectors. What reaches leaves is compared exactly, on whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.llm.common import bounded_batches, tidied, written

#: What float bounds are widened by; they are square roots of exact whole numbers.
_SLACK = 1e-9


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows (whole numbers) to all others, points x others."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(others).max(initial=0)))
    if 4 * points.shape[1] * most * most < 1 << 53:  # every sum is a whole number that a double holds
        p, o = points.astype(np.float64), others.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ o.T) + (o * o).sum(1)).astype(np.int64)
    return np.stack([((points - o) ** 2).sum(1) for o in others], 1) if len(others) else np.empty((len(points), 0), np.int64)


def paired(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the other of the same place."""
    d = points - others
    return np.einsum("ij,ij->i", d, d)


def farthest(dims: int) -> int:
    """How far from 0 components may be, so that squared distances fit 64 bits."""
    return min(math.isqrt((1 << 62) // dims) // 2, (1 << 31) - 1)


def spread(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs that begin at first, one after another, and the run that each is of."""
    of = np.repeat(np.arange(len(first)), length)
    return np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + first[of], of


class Tree(NamedTuple):
    """Nodes in depth-first order, so a node's points are a run of `order`.

    point: the row that stands for a node. radius: distance from it to the farthest of the node's rows, at least.
    first, end: the run. child, at: children of all nodes, one after another, and where each node's begin, with the end.
    """

    order: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    end: np.ndarray
    child: np.ndarray
    at: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = 16) -> Tree:
    """A cover tree: a node of scale s has children of scale s / 2 that are more than s / 2 apart and hold its points within s / 2.

    A node of at most leaf points, or whose points are all equal, is a leaf. Points are whole numbers.
    """
    order: list[int] = []
    point, radius, first, end, parent = [], [], [], [], []
    reach = np.sqrt(squared(points, points[:1])[:, 0].astype(np.float64))
    # Frames: a point, its rows, their distances to it, the scale and the parent; a number closes that node.
    stack: list = [(0, np.arange(len(points)), reach, float(reach.max(initial=0.0)), -1)]
    while stack:
        frame = stack.pop()
        if isinstance(frame, int):
            end[frame] = len(order)
            continue
        top, rows, distance, scale, above = frame
        node, most = len(point), float(distance.max(initial=0.0))
        for column, value in zip((point, radius, first, end, parent), (top, most * (1 + _SLACK), len(order), 0, above)):
            column.append(value)
        stack.append(node)
        if len(rows) <= leaf or most == 0:
            order.extend(rows.tolist())
            continue
        half, own = min(scale, most) / 2, []
        # The node's point is its first child's too; the next child is a point that none covers yet.
        while len(rows):
            near = distance <= half
            own.append((top, rows[near], distance[near], half, node))
            rows = rows[~near]
            if len(rows):
                top = int(rows[0])
                distance = np.sqrt(squared(points[rows], points[top][None])[:, 0].astype(np.float64))
        stack.extend(reversed(own))
    above = np.array(parent, np.int64)
    child = np.argsort(above, kind="stable")[1:]  # the root, whose parent is -1, comes first
    at = np.append(0, np.cumsum(np.bincount(above[1:], minlength=len(above))))
    return Tree(np.array(order, np.int64), np.array(point, np.int64), np.array(radius), np.array(first, np.int64), np.array(end, np.int64), child, at)


def assign(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree, together: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest centroid (ties: the smaller number) and the squared distance to it; how many rows met a centroid one by one.

    tree: over points; over: over centroids. All pairs of a depth are looked at at once.
    """
    found = np.full(len(points), -1, np.int64)
    node, group, compared = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    while len(node):
        d = np.sqrt(paired(points[tree.point[node]], centroids[over.point[group]]).astype(np.float64))
        least = d * (1 - _SLACK) - tree.radius[node] - over.radius[group]
        most = d * (1 + _SLACK) + tree.radius[node]  # a group's point is a centroid, and no row is farther from it
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
        keep = least <= np.minimum.reduceat(most, starts)[of]
        node, group = node[keep], group[keep]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        count = np.diff(np.append(starts, len(node)))
        of = np.repeat(np.arange(len(starts)), count)
        # One centroid is left: all rows of the node are its.
        settled = (count[of] == 1) & (over.end[group] - over.first[group] == 1)
        rows, run = spread(tree.first[node[settled]], (tree.end - tree.first)[node[settled]])
        found[tree.order[rows]] = over.order[over.first[group[settled]]][run]
        leaf, last = tree.at[node + 1] == tree.at[node], over.at[group + 1] == over.at[group]
        exact = np.logical_and.reduceat(leaf & last, starts)[of] & ~settled
        for a, b in _portions(starts, count, exact, (tree.end - tree.first)[node] * (over.end - over.first)[group], together):
            n, g = node[a:b][exact[a:b]], group[a:b][exact[a:b]]
            row, pair = spread(tree.first[n], (tree.end - tree.first)[n])
            some, which = spread(over.first[g[pair]], (over.end - over.first)[g[pair]])
            row, some = tree.order[row[which]], over.order[some]
            met = paired(points[row], centroids[some])
            best = np.lexsort((some, met, row))
            best = best[np.append(True, row[best][1:] != row[best][:-1])]
            found[row[best]] = some[best]
            compared += len(row)
        # The wider side goes down, for all pairs of a node alike: a node and what is below it are never open together.
        go = ~(settled | exact)
        node, group, leaf, last = node[go], group[go], leaf[go], last[go]
        if not len(node):
            break
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
        widest, ended = np.maximum.reduceat(over.radius[group], starts)[of], np.logical_and.reduceat(last, starts)[of]
        down = ~leaf & (ended | (tree.radius[node] >= widest))
        below, pair = spread(np.where(down, tree.at[node], over.at[group]), np.where(down, np.diff(tree.at)[node], np.where(last, 1, np.diff(over.at)[group])))
        node, group, down, last = node[pair], group[pair], down[pair], last[pair]
        node[down] = tree.child[below[down]]
        group[~down & ~last] = over.child[below[~down & ~last]]
        order = np.lexsort((group, node))
        node, group = node[order], group[order]
    return found, paired(points, centroids[found]), compared


def _portions(starts: np.ndarray, count: np.ndarray, wanted: np.ndarray, size: np.ndarray, together: int) -> Iterator[tuple[int, int]]:
    """Runs of whole nodes with about `together` wanted comparisons each."""
    begin, held = None, 0
    for a, n in zip(starts.tolist(), count.tolist()):
        if wanted[a]:
            begin = a if begin is None else begin
            held += int(size[a : a + n].sum())
            if held >= together:
                yield begin, a + n
                begin, held = None, 0
    if begin is not None:
        yield begin, len(wanted)


def _blocks(kept: DataFrame, dims: int, scale: int, rows: int) -> DataFrame:
    """ids, vectors (whole numbers) and tree of each block of rows; a block is what one task reads next to each other."""
    kind = kept.schema.fields[0].dataType
    names = [*Tree._fields]
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType()), *(T.StructField(n, T.BinaryType()) for n in names)])
    arrow = to_arrow_schema(schema)
    limit = farthest(dims)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in table.column(1).chunks])
            whole = np.floor(values * scale).reshape(-1, dims)
            if np.abs(whole).max(initial=0) > limit:
                raise ValueError(f"components of {limit / scale:.6g} or more have squared distances beyond 64 bits")
            whole = whole.astype(np.int64)
            tree = cover_tree(whole)
            columns = [table.column(0).combine_chunks().to_pylist()], [whole.astype("<i4").tobytes()], *([x.tobytes()] for x in tree)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                whole = table.num_rows // rows * rows
                for at in range(0, whole, rows):
                    yield block(table.slice(at, rows))
                held = table.slice(whole).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield block(table)

    return kept.mapInArrow(tidied(make), schema)


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for k in range(batch.num_rows):
        raw = [batch.column(c)[k].as_buffer() for c in range(1, batch.num_columns)]
        parts = [np.frombuffer(x, np.float64 if n == "radius" else np.int64) for x, n in zip(raw[1:], Tree._fields)]
        yield batch.column(0)[k].values, np.frombuffer(raw[0], "<i4").astype(np.int64).reshape(-1, dims), Tree(*parts)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dim, n, total over all vectors: one array of sums leaves each task."""
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("totals", T.ArrayType(T.LongType()))])
    over = cover_tree(centroids, 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, points, tree in _read(batch, centroids.shape[1]):
                found = assign(points, tree, centroids, over)[0]
                order = np.argsort(found, kind="stable")
                starts = np.flatnonzero(np.append(True, found[order][1:] != found[order][:-1]))
                totals[found[order][starts]] += np.add.reduceat(points[order], starts)
                n += np.bincount(found, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(totals[some]), pa.list_(pa.int64()))], ["cluster", "n", "totals"])

    each = blocks.mapInArrow(tidied(add), schema).select("cluster", "n", F.posexplode("totals").alias("dim", "total"))
    return each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _assigned(blocks: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    schema = T.StructType([T.StructField(id_col, blocks.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    arrow = to_arrow_schema(schema)
    over = cover_tree(centroids, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, tree in _read(batch, centroids.shape[1]):
                found, distance, _ = assign(points, tree, centroids, over)
                yield pa.RecordBatch.from_arrays([ids.cast(arrow[0].type), pa.array(found, pa.int32()), pa.array(distance)], schema=arrow)

    return blocks.mapInArrow(tidied(place), schema)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, block: int = 1024) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that is kept.

    Kept are vectors of dims components, none null, NaN or infinite; a component x becomes floor(scale * x).
    Centroids start as the k kept vectors with the smallest sha256 of `<seed>:<id>` (fewer vectors: as many;
    equal ids: the smaller vector first; null ids last). A round assigns every vector to the nearest centroid
    (squared distance; ties: the smaller number) and replaces each centroid that has vectors by their mean,
    rounded down; after the last one they are assigned again. All of it is exact. Rows that repeat an id or a vector are vectors of
    their own. A component so large that squared distances leave 64 bits is an error (131,072 with 64 components
    and scale 1,024). No kept vector gives no rows; other columns aren't read.

    Vectors aren't shuffled: a block is what a task reads, with a tree that is written with it once. Each round
    sends k * dims sums to the driver, however many vectors there are, and rounds end when no centroid moves.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col), F.col(vector_col).alias("__vector"))
    odd = F.exists("__vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter((F.size("__vector") == dims) & ~odd)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "__vector").limit(k).collect()
    centroids = np.array([[math.floor(float(x) * scale) for x in r["__vector"]] for r in first], np.int64).reshape(-1, dims)
    schema = T.StructType([vectors.schema[id_col], *(T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())))])
    if not first:
        return spark.createDataFrame([], schema)
    blocks = written(_blocks(kept, dims, scale, block), "blocks")
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(blocks, centroids).collect():
            moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():
            break
        centroids = moved
    found = written(_assigned(blocks, centroids, id_col), "assigned")
    each = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    known = [(c, each.get(c, 0), sum(each.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    known = spark.createDataFrame(known, "__cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), F.col("cluster") == F.col("__cluster")).select(*[f.name for f in schema])
