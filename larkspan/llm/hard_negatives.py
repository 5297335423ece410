"""Hard negatives of embeddings by one-dimensional distance keys, exact.

Vectors are whole numbers, and inner product is the score. With a further component, sqrt(M - |x|^2) where M is the greatest squared length, all
vectors have one length, and for a query (with 0 there) a higher score is a smaller distance. Every vector is stored under the key (pivot, distance): the nearest of a
few pivots and how far it is from that, in a written table that is sorted by key. By the triangle inequality, a vector within r of a
query lies under each pivot in the interval of keys within r of the query's own distance from that pivot.

A query asks for the first k rows, by score, then by smaller id, among those whose label is (or isn't) its own and whose score lies in a window, so it starts at the sphere
of the window's upper end and goes outward. In rounds each query scans an annulus of intervals: the first is wide enough for some
thousands of rows by the sampled distances, the next reach as far as the k-th row found so far, or where fewer are found, twice as far. A query is
done when the bound on the distance of all that it hasn't scanned is beyond its k-th row, its window or the last key, so results are those of a scan of
everything, however well keys prune.

Queries are numbered in the order of their keys and go in blocks of at most `BLOCK`, each broadcast against the whole table, from which key intervals
are read by filters on the sorted files. A task keeps the k best rows of each query and hands on these alone.

Numpy on Arrow batches; the sample bounds and pivots come from is of `SAMPLE` rows and decides cost, never results. Defined cases: rows with a null label, a null vector or
null or non-finite components take no part; null ids are neither anchors nor divisible, and come last among equals; rows of one id are separate
rows, and each is an anchor if its id says so; equal vectors are ordered by id, then by the row's place; vectors of different lengths raise ValueError, components too large for 64-bit products
OverflowError; columns other than the id, the vector and the label are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import durable, map_arrow, prefix_sums, release, scratch
from larkspan.llm.vectors import matrix, products, whole_vectors

#: Sampled rows, pivots, queries of a block, rows that a first annulus is meant to hold, and rows that are compared with a block at once.
SAMPLE, PIVOTS, BLOCK, FIRST, STEP = 4096, 32, 4096, 4096, 1024
ANCHORS, FACTOR, K = 100, 256, 5
#: What rounding in doubles may move a distance by, relative to the length of vectors.
SLACK = 1e-6


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: str, factor: int, relabel: Column | None = None) -> DataFrame:
    """id, label, v (whole numbers), row (unique), written down."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").alias("v"))
    rows = whole_vectors(rows.where("label IS NOT NULL"), "v", factor)
    if relabel is not None:
        rows = rows.withColumn("label", relabel)
    return durable(rows.withColumn("row", F.monotonically_increasing_id()))


class Index:
    """Vectors sorted by key (pivot, far), and what a driver needs to plan scans: pivots, the greatest squared length, sampled keys."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
        self.most = rows.agg(F.max(square)).first()[0]
        # the same rows in each run: those of the smallest hashes
        taken = rows.orderBy(F.xxhash64("id", "v"), "row").limit(SAMPLE).select("v").collect()
        self.dim = len(taken[0]["v"])
        if any(len(r["v"]) != self.dim for r in taken):
            raise ValueError("vectors have to be of one length")
        sample = self.augmented(np.array([r["v"] for r in taken], np.int64).reshape(len(taken), self.dim))
        self.pivots = spread(sample, PIVOTS)
        near, far = self.key(sample)
        self.count = rows.count()
        #: Sampled rows stand for so many rows each.
        self.sampled = [np.sort(far[near == p]) for p in range(len(self.pivots))]
        self.share = self.count / len(sample)
        hold, dim, key, augmented = spark.sparkContext.broadcast(self.pivots), self.dim, key_of, augmented_of
        most = self.most

        def run(batches):
            for batch in batches:
                pivot, far = key(augmented(matrix(batch.column("v"), dim), most), hold.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], [*batch.schema.names, "pivot", "far"])

        keyed = map_arrow(rows.select("id", "label", "v", "row"), run, "id bigint, label bigint, v array<bigint>, row bigint, pivot int, far double")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # with the row in the order, a vector that many rows have spreads over partitions
        self.table = durable(keyed.repartitionByRange(parts, "pivot", "far", "row").sortWithinPartitions("pivot", "far", "row"))

    def augmented(self, v: np.ndarray) -> np.ndarray:
        return augmented_of(v, self.most)

    def key(self, augmented: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return key_of(augmented, self.pivots)


def augmented_of(v: np.ndarray, most: int) -> np.ndarray:
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]))


def key_of(augmented: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = distances(augmented, pivots)
    near = far.argmin(1)
    return near.astype(np.int32), far[np.arange(len(far)), near]


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots of a sample: each the row that is furthest from those before, distinct."""
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def first_k(query: np.ndarray, score: np.ndarray, none: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k candidates of each query: by score, null ids last, smaller id, row."""
    order = np.lexsort((row, ident, none, -score, query))
    q = query[order]
    at = np.arange(len(q))
    start = np.maximum.accumulate(np.where(np.concatenate(([True], q[1:] != q[:-1])), at, 0)) if len(q) else at
    return order[at - start < k]


def scanned(index: Index, block: dict, k: int) -> DataFrame:
    """query, id, row, score: of each task the first k rows of each query of a block among those in the query's annulus.

    block: arrays by query: v, label, own (its row), same (whether its label or others are wanted), lo and hi (scores), inner and outer (the annulus: what it
    reaches beyond inner and up to outer), start, the distance at which its window begins, and far, its distances from the pivots, the same numbers in each round.
    """
    spark = index.table.sparkSession
    own = block["far"]
    slack = SLACK * np.sqrt(float(index.most) + 1)
    # under each pivot, the keys that any query of the block can want
    wanted = F.lit(False)
    for p in range(len(index.pivots)):
        low, high = float((own[:, p] - block["outer"]).min()) - slack, float((own[:, p] + block["outer"]).max()) + slack
        wanted = wanted | ((F.col("pivot") == p) & F.col("far").between(low, high))
    distinct, of = np.unique(block["v"], axis=0, return_inverse=True)
    hold = spark.sparkContext.broadcast((block, distinct, of.ravel()))
    dim = index.dim

    def run(batches):
        block, distinct, of = hold.value
        own = block["far"]
        best = [np.empty(0, np.int64)] * 5
        floor = np.full(len(of), np.iinfo(np.int64).min)  # scores below which a query needs nothing any more
        for batch in batches:
            pivot, far = batch.column("pivot").to_numpy(), batch.column("far").to_numpy()
            label, row = batch.column("label").to_numpy(), batch.column("row").to_numpy()
            none = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            ident = batch.column("id").fill_null(0).to_numpy()
            v = matrix(batch.column("v"), dim)
            cuts = np.flatnonzero(np.diff(pivot)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pivot)], strict=True):
                for a_ in range(a, b, STEP):
                    part = slice(a_, min(a_ + STEP, b))
                    d, lo, hi = own[:, pivot[a_]], far[part].min(), far[part].max()
                    reach = np.maximum(0.0, np.maximum(d - hi, lo - d))  # nothing here is nearer
                    q = np.flatnonzero((reach <= block["outer"]) & (np.maximum(hi - d, d - lo) > block["inner"]) & (d + hi + slack >= block["start"]))
                    if not len(q):
                        continue
                    # row by row, so that annuli of different rounds meet exactly wherever batches begin
                    away = np.abs(d[q][:, None] - far[part][None])
                    u, inverse = np.unique(of[q], return_inverse=True)
                    score = products(distinct[u], v[part])[inverse]
                    fit = (score >= np.maximum(block["lo"][q], floor[q])[:, None]) & (score <= block["hi"][q][:, None])
                    fit &= (away > block["inner"][q][:, None]) & (away <= block["outer"][q][:, None])
                    fit &= ((label[part][None] == block["label"][q][:, None]) == block["same"][q][:, None]) & (row[part][None] != block["own"][q][:, None])
                    # beyond the k highest scores, but for ties with the lowest of them, nothing counts
                    if score.shape[1] > k:
                        masked = np.where(fit, score, np.iinfo(np.int64).min)
                        fit &= score >= np.partition(masked, score.shape[1] - k, 1)[:, score.shape[1] - k][:, None]
                    i, j = np.nonzero(fit)
                    if not len(i):
                        continue
                    found = [q[i], score[i, j], none[part][j].astype(np.int64), ident[part][j], row[part][j]]
                    best = [np.concatenate(x) for x in zip(best, found, strict=True)]
                    at = first_k(*best, k)
                    best = [x[at] for x in best]
                    n = np.bincount(best[0], minlength=len(of))
                    full = np.flatnonzero(n[best[0]] == k)
                    floor[best[0][full]] = np.iinfo(np.int64).max
                    np.minimum.at(floor, best[0][full], best[1][full])
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(block["query"][best[0]]), pa.array(best[3], mask=best[2] > 0), pa.array(best[4]), pa.array(best[1])], ["query", "id", "row", "score"])

    return map_arrow(index.table.where(wanted).select("id", "label", "v", "row", "pivot", "far"), run, "query bigint, id bigint, row bigint, score bigint")


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the first k of each query."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query, id, row, score, rank of the first k rows of each query, written down.

    queries: query (unique), own (the row that isn't to be found), v, label, same (whether rows of that label are wanted, or of others), lo, hi (scores; null: none), and
    that row's key (pivot, far).
    """
    numbered = queries.withColumn("one", F.lit(1).cast("long"))
    numbered = prefix_sums(numbered, [], ["pivot", "far", "query"], "one")
    numbered = durable(numbered.withColumn("block", F.expr(f"rank div {BLOCK}")).select(*queries.columns, "block"))
    blocks = (numbered.agg(F.max("block")).first()[0] or 0) + 1
    parts = []
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).drop("block").toArrow()  # at most BLOCK
        if not rows.num_rows:
            continue
        parts += block_rounds(index, asked(index, rows), k)
    release(numbered)
    if not parts:
        return durable(index.table.sparkSession.createDataFrame([], "query bigint, id bigint, row bigint, score bigint, rank int"))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    out = durable(first_rows(found, k))
    release(*parts)
    return out


def asked(index: Index, rows: pa.Table) -> dict:
    """A block of queries as arrays; `start` and `limit` are the distances of the window's ends."""
    whole = lambda c, none: rows.column(c).combine_chunks().fill_null(none).to_numpy()
    v = matrix(rows.column("v").combine_chunks(), index.dim)
    extremes = np.iinfo(np.int64)
    block = {"query": whole("query", 0), "own": whole("own", -1), "v": v, "label": whole("label", 0), "same": rows.column("same").combine_chunks().to_numpy(zero_copy_only=False), "lo": whole("lo", extremes.min), "hi": whole("hi", extremes.max)}
    square = (v.astype(np.float64) ** 2).sum(1) + index.most
    block["start"] = np.where(block["hi"] == extremes.max, 0.0, np.sqrt(np.maximum(0.0, square - 2.0 * block["hi"])))
    block["limit"] = np.where(block["lo"] == extremes.min, np.inf, np.sqrt(np.maximum(0.0, square - 2.0 * block["lo"])))
    block["square"] = square
    return block


def block_rounds(index: Index, block: dict, k: int) -> list[DataFrame]:
    """Rounds of annuli until every query of a block is done; what each round has found, written down."""
    slack = SLACK * np.sqrt(float(index.most) + 1)
    own = distances(np.concatenate([block["v"].astype(np.float64), np.zeros((len(block["v"]), 1))], 1), index.pivots)
    # a first radius: as far as the sample has FIRST rows within reach that aren't inside the window's start
    first = np.empty(len(own))
    for i, d in enumerate(own):
        reach = np.concatenate([np.abs(f - d[p])[f + d[p] >= block["start"][i] - slack] for p, f in enumerate(index.sampled)])
        at = int(FIRST / index.share)
        first[i] = np.partition(reach, at)[at] if at < len(reach) else (reach.max() if len(reach) else 0.0)
    last = 2 * np.sqrt(float(index.most)) + 2 * slack  # nothing is as far away
    block = block | {"far": own, "inner": np.full(len(own), -np.inf), "outer": np.minimum(np.maximum(first, block["start"]), last)}
    found: list[DataFrame] = []
    while len(block["query"]):
        found.append(durable(scanned(index, block, k)))
        everything = found[0]
        for more in found[1:]:
            everything = everything.union(more)
        # for each query of the block its k-th score
        kth = first_rows(everything, k).where(F.col("rank") == k).select("query", "score").toArrow()
        have = dict(zip(kth.column("query").to_pylist(), kth.column("score").to_pylist(), strict=True))
        score = np.array([have.get(q, 0) for q in block["query"].tolist()], np.float64)
        full = np.array([q in have for q in block["query"].tolist()])
        need = np.where(full, np.sqrt(np.maximum(0.0, block["square"] - 2.0 * score)), last)
        need = np.minimum(need, block["limit"]) + slack
        done = (block["outer"] >= need) | (block["outer"] >= last)
        wider = np.where(full, need, np.minimum(need, 2 * block["outer"] + slack))
        block = {c: x[~done] for c, x in (block | {"inner": block["outer"], "outer": np.minimum(wider, last)}).items()}
    return found


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", factor: int = FACTOR, anchors: int = ANCHORS, k: int = K, relabel: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for every row whose id is divisible by `anchors`.

    An anchor's positives are its first k other rows of its label; a positive's negatives the first k rows of other labels whose score is 80 to 100 % of the positive's.
    """
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    with scratch() as keep:
        rows = prepared(vectors, vec_id, vector, label, factor, relabel)
        if rows.isEmpty():
            return keep(durable(vectors.sparkSession.createDataFrame([], schema)))
        index = Index(rows)
        chosen = index.table.where(F.col("id") % anchors == 0).select("id", "row", "v", "label", "pivot", "far")
        none = F.lit(None).cast("bigint")
        first = search(index, chosen.select(F.col("row").alias("query"), F.col("row").alias("own"), "v", "label", F.lit(True).alias("same"), none.alias("lo"), none.alias("hi"), "pivot", "far"), k)
        # one query for each anchor and positive; a window of scores above 0 only
        pairs = first.select(F.col("query").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("query") * k + F.col("rank") - 1).alias("query")).where("positive_score >= 0")
        pairs = durable(pairs.join(chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "v", "label", "pivot", "far"), "anchor"))
        window = pairs.select("query", F.col("anchor").alias("own"), "v", "label", F.lit(False).alias("same"), F.expr("positive_score - positive_score div 5").alias("lo"), F.col("positive_score").alias("hi"), "pivot", "far")
        second = search(index, window, k)
        out = second.select("query", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        out = pairs.select("query", "anchor_id", "positive_id", "positive_score").join(out, "query")
        return keep(durable(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives with some labels moved on by one: those of rows whose id is divisible by 7."""
    return hard_negatives(vectors, relabel=F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
