"""MinHash fingerprints of documents, and near duplicates by bands.

A text's shingles (five words, hashed to 64 bits) go through `PERMUTATIONS` universal hashes (a x + b mod 2^64,
upper half), whose minima over the text make its signature; 16 bits of each minimum are kept. The share of
equal places of two signatures estimates the Jaccard similarity of their shingle sets.

Numpy on Arrow batches, in chunks that fit a cache. Near duplicates: bands of signatures of distinct texts are joined in Spark,
and candidates are verified by the Jaccard similarity of whole shingle sets.

Defined cases: a null text is empty; texts without words have the fingerprint "" and are like each other (1) and
nothing else (0); texts of fewer words than five are one shingle; ids of null come last in descending order,
ties are ordered by a hash of the text; a single document is its own next one; other columns are ignored, whatever their
names; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm import jaccard_join
from larkspan.llm.arrays import chunks, mix, words_of
from larkspan.llm.common import durable, fewer, map_arrow, scratch

WORDS, PERMUTATIONS, ROWS = 5, 128, 6
_seed = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
A, B = _seed[:PERMUTATIONS] | np.uint64(1), _seed[PERMUTATIONS:]
_FACTORS = [pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64) for k in range(WORDS)]


def signatures(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """uint16[texts, PERMUTATIONS], and whether a text has words."""
    hashes, at = words_of(texts)
    n = np.diff(at)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(WORDS):
        rolled[: len(hashes) - k] += hashes[k:] * np.uint64(_FACTORS[k])
    # a text of fewer words: the sum over its own
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        rolled[at[i]] = (sum(int(hashes[at[i] + k]) * _FACTORS[k] for k in range(n[i])) + int(n[i])) & (1 << 64) - 1
    size = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    inside = np.arange(len(hashes)) - np.repeat(at[:-1], n) < np.repeat(size, n)
    shingles = mix(rolled[inside])
    has = size > 0
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, np.uint16)
    if len(shingles):
        starts = np.concatenate(([0], np.cumsum(size[has])))[:-1]
        for p in range(PERMUTATIONS):
            v = ((shingles * A[p] + B[p]) >> np.uint64(32)).astype(np.uint32)
            out[has, p] = np.minimum.reduceat(v, starts) & np.uint32(0xFFFF)
    return out, has


def likeness(x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray) -> np.ndarray:
    return np.where(has_x & has_y, (x == y).mean(1), (has_x == has_y).astype(float))


def text_of(signature: np.ndarray, has: np.ndarray) -> list[str]:
    return [s.astype(">u2").tobytes().hex() if h else "" for s, h in zip(signature, has, strict=True)]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Kinds of rows in the order in which those of one id stand; ends stand last in their range.
NOTE, TEXT, END = 0, 1, 2


def ranges(docs: DataFrame, parts: int):
    """The number of ranges of rows in descending order of (doc_id, text's hash), and place(doc_id, share): the range of a row whose hash is at this
    share of all hashes, or with share None all ranges of an id.

    Ids are cut at about `parts` quantiles. An id that more than one quantile falls on has several ranges by hash, and so do null ids.
    """
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("cuts"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    cuts = sorted(found["cuts"] or [])
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")] if cuts else [-float("inf"), 0.0, float("inf")]
    times = {c: cuts.count(c) for c in set(cuts)}
    # by bucket: the id that takes several ranges, of those that a double can't tell apart the most frequent one
    heavy: dict[int, tuple[int, int]] = {}
    for c, k in times.items():
        b = splits.index(float(c))
        if k > 1 and k > heavy.get(b, (0, 0))[1]:
            heavy[b] = (c, k)
    base, at = {}, 0
    for b in range(len(splits) - 2, -1, -1):
        base[b] = at
        at += 2 + heavy[b][1] if b in heavy else 1
    nulls = max(1, -(-(found["n"] - found["ids"]) * parts // max(1, found["n"])))
    bucket = Bucketizer(splits=splits, inputCol="_id", outputCol="_b", handleInvalid="keep")
    of = lambda values, kind: F.get(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(len(splits) - 1)]), F.col("_b").cast("int"))

    def place(df: DataFrame, share: Column | None) -> DataFrame:
        known = bucket.transform(df.withColumn("_id", F.col("doc_id").cast("double")))
        id_, times = of({b: h[0] for b, h in heavy.items()}, "long"), of({b: h[1] for b, h in heavy.items()}, "int")
        part = lambda k: F.sequence(F.lit(0), k - 1) if share is None else F.array(F.least(k - 1, F.floor(share * k).cast("int")))
        one = lambda k: F.array(F.lit(k))
        within = F.when(id_.isNull() | (F.col("doc_id") > id_), one(0)).when(F.col("doc_id") == id_, F.transform(part(times), lambda k: k + 1)).otherwise(F.array(1 + times))
        start = F.when(F.col("doc_id").isNull(), F.lit(at)).otherwise(of(base, "int"))
        return known.withColumn("_b", F.explode(F.transform(F.when(F.col("doc_id").isNull(), part(F.lit(nulls))).otherwise(within), lambda k: start + k))).drop("_id")

    return at + nulls, place


def with_next(docs: DataFrame, notes: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Rows of doc_id and text in descending order within partitions, so that the next document's row follows each.

    Each partition is one range and ends with a copy of the next range's first row. Rows of
    notes (doc_id, note), one for an id, come along, each ahead of its documents, so that these needn't be joined.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    n, place = ranges(docs.select("doc_id"), parts)
    ranged = place(docs, F.col("th") / 2.0**64 + 0.5)
    down = F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("d"), "th")
    # a row for each range
    heads = durable(fewer(ranged.groupBy("_b").agg(F.min(down).alias("f")).select(F.col("_b").alias("_p"), F.bitwise_not("f.d").alias("_d"), F.col("f.th").alias("_t"))))
    first = ranged.join(F.broadcast(heads), (F.col("_b") == F.col("_p")) & (F.coalesce("doc_id", F.lit(0)) == F.col("_d")) & (F.col("th") == F.col("_t")))
    first = durable(fewer(first.groupBy("_b", "doc_id", "th").agg(F.min("text").alias("text"))))
    around = Window.orderBy("_b")
    # which range's first row ends a range: that of the next one, of the first one at the end
    ends = first.select("_b").withColumn("_n", F.coalesce(F.lead("_b").over(around), F.first("_b").over(around))).select(F.col("_b").alias("_e"), "_n")
    ends = first.join(F.broadcast(ends), F.col("_b") == F.col("_n")).select("doc_id", "text", "th", F.col("_e").alias("_b"))
    none = F.lit(None).cast("long").alias("note")
    rows = ranged.select("doc_id", "text", "th", none, F.lit(TEXT).alias("_kind"), "_b").union(ends.select("doc_id", "text", "th", none, F.lit(END).alias("_kind"), "_b"))
    if notes is not None:
        own = place(notes.where(F.col("doc_id").isNotNull()).select("doc_id", "note"), None)
        rows = rows.union(own.select("doc_id", F.lit("").alias("text"), F.lit(0).cast("long").alias("th"), "note", F.lit(NOTE).alias("_kind"), "_b"))
    # for each range a number that hashing deals to a partition of its own
    number = fewer(spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("k")).agg(F.min("id").alias("id")))
    number = {r["k"]: r["id"] for r in number.collect()}
    dealt = rows.withColumn("_b", F.get(F.array(*[F.lit(number.get(k, k)).cast("long") for k in range(n)]), F.col("_b")))
    order = [F.col("_b"), F.col("_kind") == END, F.desc_nulls_last("doc_id"), F.col("_kind"), F.col("th"), F.col("text")]
    return dealt.repartition(n, "_b").sortWithinPartitions(*order).select("doc_id", "text", "note", "_kind")


def fingerprint_documents(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    class_id is what classes (doc_id, class_id; one row for an id) has, the smallest doc_id of near duplicates; else null.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]

    def made(rows: list) -> pa.RecordBatch:
        """rows: (id, text, class, next text)."""
        ids, texts, notes, nexts = zip(*rows, strict=True)
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        # next texts are mostly the following rows' own
        own, has = signatures([*texts, nexts[-1]])
        follow = np.arange(1, len(texts) + 1)
        other, other_has = own[follow], has[follow]
        strange = [i for i in range(len(texts) - 1) if nexts[i] is not texts[i + 1]]
        if strange:
            other, other_has = other.copy(), other_has.copy()
            other[strange], other_has[strange] = signatures([nexts[i] for i in strange])
        new, new_has = signatures(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
                pa.array(text_of(own[:-1], has[:-1])),
                pa.array(text_of(new, new_has)),
                pa.array(likeness(own[:-1], new, has[:-1], new_has)),
                pa.array(likeness(own[:-1], other, has[:-1], other_has)),
                pa.array(notes, pa.int64()),
            ],
            names,
        )

    def run(batches):
        rows, size, last, note = [], 0, None, (None, None)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                for i, text, n, kind in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if kind == NOTE:
                        note = (i, n)
                        continue
                    if last is not None:
                        rows.append((*last, text))
                        size += len(last[1])
                    last = None if kind == END else (i, text, note[1] if note[0] == i else None)
                    if size > 1 << 19:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id bigint"
    notes = classes.select("doc_id", F.col("class_id").alias("note")) if classes is not None else None
    return map_arrow(with_next(docs.withColumn("doc_id", F.col("doc_id").cast("long")), notes), run, schema)


def bands(_, texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text, which has words: the values of its bands, under which its set is posted; sets of any overlap meet there."""
    if not texts:
        return [], []
    n_bands = PERMUTATIONS // ROWS
    values = signatures(texts)[0][:, : n_bands * ROWS].astype(np.uint64).reshape(len(texts), n_bands, ROWS)
    hashes = np.broadcast_to(np.arange(n_bands, dtype=np.uint64), values.shape[:2])
    for k in range(ROWS):
        hashes = mix(hashes * np.uint64(0x100000001B3) + values[:, :, k])
    return list(hashes), [np.full(n_bands, np.iinfo(np.int32).max)] * len(texts)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, class_id: the smallest doc_id that verified candidates reach; texts without words are alone.

    Sets that share a band are candidates; all links between them count, found without all pairs of a band.
    """
    with scratch() as keep:
        sets = jaccard_join.posted_sets(docs, WORDS, bands)
        roots = jaccard_join.link_classes(docs, sets, WORDS, percent)
        return keep(durable(fewer(jaccard_join.with_least(sets, roots).select("doc_id", F.col("least").alias("class_id")))))
