"""Connected components of links, by alternating star operations on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from braidlog.llm.common import attach, discard, written


def _least_neighbours(edges: DataFrame, total: int) -> DataFrame:
    """edges with the least neighbour of u; a node may have a third of all edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("edges"))
    return attach(edges, least, "u", "edges", total, F.col("v"))


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: for each node of the links (u, v: long), the smallest node that it is connected with.

    Large star: a node's larger neighbours move to the least of its neighbourhood; small star: so do
    its smaller ones and it itself. After few rounds each node points at its component's smallest.
    Each round's links are a table in the shared folder, so lineage doesn't grow.
    """
    def settled(df: DataFrame) -> tuple[DataFrame, dict]:
        """df as a table, with the number and a hash of its links, which the write observes."""
        seen = Observation()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("hash")), "edges")
        return out, seen.get

    edges, now = settled(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        total, before = now["n"], now
        if not total:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbours(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        small = _least_neighbours(large, total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct(F.col("u").alias("u"), F.col("least").alias("v")))).alias("e"))
        last = edges
        edges, now = settled(small.select("e.*").filter("u <> v").distinct())
        discard(last)
        if now == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
