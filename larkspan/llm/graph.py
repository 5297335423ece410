"""Connected components over narrow edges: forests of bounded chunks, then alternating stars while what is left is more than a task may hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, map_arrow, release

#: Edges that a task holds at most; while no more are left, one pass ends the search.
EDGES = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that edges touch, in order, and of each the smallest one that these edges reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame, whole: bool = False) -> DataFrame:
    """u, v: in place of the edges of a chunk, from each node an edge to the smallest one that they reach; whole: from these ones to themselves too."""

    def made(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = forest(u, v)
        keep = whole | (nodes != roots)
        return nodes[keep], roots[keep]

    def run(batches):
        held, k = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            k += batch.num_rows
            if k > 2 * EDGES:
                u, v = made(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, k = [(u, v)], len(u)
                if k > EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    held, k = [], 0
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["u", "v"])

    return durable(map_arrow(edges.select(*edges.columns[:2]), run, "u bigint, v bigint"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that is reachable) of all nodes that edges (a, b) touch.

    Edges of a chunk are replaced by a forest, which is as connected. At most `EDGES` of these are ended by one task. Of more,
    each round points the larger neighbours of each node, then its smaller ones and itself, to the smallest
    (Kiveris et al. 2014). Minima combine on the map side, so hubs aren't gathered; rounds are written down.
    """
    edges = contracted(edges.select("a", "b"))
    if edges.count() <= EDGES:
        out = contracted(edges.coalesce(1), whole=True)
        release(edges)
        return out.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, edges = edges, durable(stars)
        release(before)
        # done when every node points to one other, and that to none
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out > 1 OR out > 0 AND in > 0").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
