"""Near duplicates by chosen paths: a set similarity join over independent trees of minwise tokens.

A tree's node holds documents. A node that is too large to compare chooses a place or two of its level (`BRANCH` on average, by the node's own hash), and
every document goes to a child for the minwise token of its set under the place's hash function. Documents of similarity s stay together in a child
with probability s, so with more choices than 1 / s a pair has a common leaf in a tree with a probability that depth doesn't bring
to nothing, while unlike documents part at every level. Trees are independent; there are as many as it takes for the recall aimed at
(`trees_for`), of a link at exactly the threshold; links above are found more often, and a component stands by many.

Level by level: what a document's path is follows from its signature alone once it is known which nodes are large, so no documents are
moved. One pass over signatures counts the nodes of a level, added up within tasks; the large ones go into a Bloom filter of fixed size,
which the next pass has by broadcast (a false positive lets a small node branch, for all of its documents alike). Leaves are posted to the
lists of the n-gram join, which compares every two classes of equal sets of a node of at most `SMALL`, and of what is still larger, at the
greatest depth or because nearly all of a node goes to one child (copies, which no token parts), each class with the first ones, then all that these don't link, across components and without a cap. Candidates are confirmed on whole sets.

Numpy on Arrow batches. Defined cases: documents without words or text have empty sets and link to nothing; those of fewer words than n have
one element; null ids take part (their component is the smallest id in it that isn't null, else null) and aren't kept as the first of anything; repeated rows agree;
other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import jaccard_join
from larkspan.llm.arrays import mix
from larkspan.llm.common import durable, map_arrow, release, scratch

#: Words of a shingle, least similarity in percent, and the recall aimed at for links at just that.
WORDS, PERCENT, RECALL = 2, 80, 0.999
#: Levels at most, places to choose from at each, choices of a node on average, and the classes of a node that is compared as it is.
DEPTH, POOL, BRANCH, SMALL = 6, 16, 1.5, jaccard_join.HUBS + 1
#: A node whose documents go to one child to this share holds documents that are alike.
ALIKE = 0.9
#: Bits of each of the filters.
FILTER = 1 << 26
_seed = mix(np.arange(1, 2 * DEPTH * POOL + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
A, B = _seed[: DEPTH * POOL] | np.uint64(1), _seed[DEPTH * POOL :]
_K = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407), np.uint64(0x8CB92BA72F3D8DD7))


def trees_for(recall: float, percent: int, depth: int = DEPTH) -> int:
    """Trees that find a pair at the threshold with this probability, if all of its nodes are large."""
    s, kept = percent / 100, 1.0
    for _ in range(depth):
        one = 1 - s * kept
        kept = 1 - ((2 - BRANCH) * one + (BRANCH - 1) * one * one)
    return ceil(log(1 - recall) / log(1 - kept))


def signed(sets: list[np.ndarray], _) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each set the minwise tokens by place, half of their bits."""
    if not sets:
        return [], []
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), DEPTH * POOL), np.uint64)
    for p in range(DEPTH * POOL):
        out[:, p] = np.minimum.reduceat(every * A[p] + B[p], starts)
    out >>= np.uint64(32)
    return list(out), [np.zeros(DEPTH * POOL, np.int32)] * len(sets)


def children(node: np.ndarray, of: np.ndarray, signatures: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the next level that follow from nodes, the row of each, and the nodes they follow from; a node chooses alike for all rows."""
    first = (mix(node ^ _K[0]) % np.uint64(POOL)).astype(np.int64)
    step = (mix(node ^ _K[1]) % np.uint64(POOL - 1)).astype(np.int64) + 1
    two = np.flatnonzero(mix(node ^ _K[2]) < np.uint64(int((BRANCH - 1) * 2.0**64)))
    place = np.concatenate([first, (first + step)[two] % POOL])
    parent, of = np.concatenate([node, node[two]]), np.concatenate([of, of[two]])
    token = signatures[of, level * POOL + place]
    return mix(mix(parent + np.uint64((level + 1) * int(_K[1]) & (1 << 64) - 1)) ^ (token << np.uint64(8)) ^ place.astype(np.uint64)), of, parent


def bit(words: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = (node & np.uint64(FILTER - 1)).astype(np.int64)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def descend(signatures: np.ndarray, trees: int, large: np.ndarray, alike: np.ndarray, levels: int):
    """Level, nodes, their rows and parents, level by level, as long as nodes branch."""
    node = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64) * _K[0]), len(signatures))
    of = np.tile(np.arange(len(signatures)), trees)
    for level in range(levels):
        node, of, parent = children(node, of, signatures, level)
        yield level + 1, node, of, parent
        down = branches(large, alike, node)
        node, of = node[down], of[down]


def branches(large: np.ndarray, alike: np.ndarray, node: np.ndarray) -> np.ndarray:
    return bit(large, node) & ~bit(alike, node)


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("keys").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, DEPTH * POOL)


def _slices(batch: pa.RecordBatch, most: int = 2000):
    for a in range(0, batch.num_rows, most):
        yield batch.slice(a, most)


def counted(classes: DataFrame, trees: int, large: np.ndarray, alike: np.ndarray, level: int) -> DataFrame:
    """h, parent, n: the nodes of a level that several classes of equal sets share. Written down."""
    hold = classes.sparkSession.sparkContext.broadcast((large, alike))

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                for at, node, _, parent in descend(_signatures(part), trees, *hold.value, level):
                    if at == level:
                        h, first, n = np.unique(node, return_index=True, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(parent[first].view(np.int64)), pa.array(n)], ["h", "parent", "n"])

    return durable(map_arrow(classes.select("keys"), run, "h bigint, parent bigint, n bigint").groupBy("h").agg(F.first("parent").alias("parent"), F.sum("n").alias("n")).where("n > 1"))


def unparted(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes (h) one level up of which one child holds nearly all. Their documents are alike, so more tokens would repeat the group and part nobody."""
    held = above.select(F.col("h").alias("parent"), F.col("n").alias("of"))
    return nodes.join(held, "parent").where((F.col("of") > SMALL) & (F.col("n") >= ALIKE * F.col("of"))).select(F.col("parent").alias("h"))


def filters_of(nodes: DataFrame, *kinds: Column) -> list[np.ndarray]:
    """Of the column h where each of kinds holds, in words of 64 bits; a row for each is gathered at most. One pass."""
    bit_ = F.expr("shiftleft(1L, cast(h & 63 as int))")
    one = [F.coalesce(F.bit_or(F.when(k, bit_)), F.lit(0).cast("long")).alias(f"b{i}") for i, k in enumerate(kinds)]
    t = nodes.groupBy(F.expr(f"shiftright(h & {FILTER - 1}, 6)").alias("w")).agg(*one).toArrow()
    out = [np.zeros(FILTER // 64, np.uint64) for _ in kinds]
    for i, words in enumerate(out):
        words[t.column("w").to_numpy()] = t.column(f"b{i}").to_numpy().view(np.uint64)
    return out


def leaves(classes: DataFrame, trees: int) -> DataFrame:
    """h, sid, n: of each class of equal sets the nodes at which it is compared, those that others share."""
    spark = classes.sparkSession
    large = shared = alike = np.zeros(FILTER // 64, np.uint64)
    depth, above = 0, None
    for level in range(1, DEPTH + 1):
        nodes = counted(classes, trees, large, alike, level)
        known, more = filters_of(nodes, F.lit(True), F.col("n") > SMALL)
        shared = shared | known
        if above is not None:
            alike = alike | filters_of(unparted(nodes, above), F.lit(True))[0]
            release(above)
        depth, above = level, nodes
        if not more.any():
            break
        large = large | more
    release(above)
    hold = spark.sparkContext.broadcast((large, alike, shared))

    def run(batches):
        large, alike, shared = hold.value
        for batch in batches:
            for part in _slices(batch):
                sid, n = part.column("sid").to_numpy(), part.column("n").to_numpy()
                for at, node, of, _ in descend(_signatures(part), trees, large, alike, depth):
                    ends = bit(shared, node)
                    if at < DEPTH:
                        ends &= ~branches(large, alike, node)
                    yield pa.RecordBatch.from_arrays([pa.array(node[ends].view(np.int64)), pa.array(sid[of[ends]]), pa.array(n[of[ends]])], ["h", "sid", "n"])

    return map_arrow(classes.select("keys", "sid", "n"), run, "h bigint, sid bigint, n bigint")


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (whether that is its own)."""
    with scratch() as keep:
        sets = jaccard_join.posted_sets(docs, n, signed)
        # sets of one element link to their equals only, which are one class
        classes = sets.where((F.size("keys") > 0) & (F.col("n") > 1)).select("sid", "n", "keys").dropDuplicates(["sid"])
        classes = durable(classes, hashes=["keys.list.element"])
        lists = leaves(classes, trees_for(recall, percent)).select("h", "sid", F.shiftleft("n", 32).bitwiseOR(F.col("n")).alias("size"))
        roots = jaccard_join.link_classes(docs, sets, n, percent, lists)
        out = jaccard_join.with_least(sets, roots)
        return keep(durable(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)).alias("kept"))))
