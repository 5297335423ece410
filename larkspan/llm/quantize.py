"""Vector code compression: product codes by Lloyd's rounds in whole numbers, maintained by differences.

Vectors are cut into equal parts, and each part position has a codebook. Assignments live in a written table; a round
reads it, assigns every part to the nearest entry, and writes the new assignments. Only parts whose assignment has changed contribute to
what is shuffled: their components are added to the sums of the new entry and taken from those of the old one, added up within a task first, so a
task hands on no more rows than there are entries, and fewer as the rounds settle. The sums and counts of all entries, whose number is fixed, go on from round to
round; an entry becomes the floor of its sum by its count. All of it is whole numbers, so the order of additions changes nothing, and retried
tasks add nothing twice, since contributions are rows of the table that a round writes.

Numpy on Arrow batches. Defined cases: rows whose vector is null or holds null or non-finite components are dropped; null ids are
kept and count as the largest; repeated rows are rows like others; with fewer rows than entries, codebooks have as many entries as there
are rows; an empty table gives no rows; columns other than the id, the vector and the label are ignored, whatever their names. Vectors of
different lengths, or whose length the parts don't divide, raise ValueError, components too large for 64-bit sums OverflowError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, map_arrow, release, scratch
from larkspan.llm.vectors import matrix, products, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are compared with the codebooks at once.
STEP = 4096


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of components the nearest entry of each part's codebook (parts, entries, width), the lower of equals, and the sum of squared distances."""
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), np.int16), np.zeros(len(x), np.int64)
    for a in range(0, len(x), STEP):
        rows = x[a : a + STEP]
        for p in range(parts):
            part = rows[:, p * width : (p + 1) * width]
            far = (books[p] * books[p]).sum(1) - 2 * products(part, books[p])
            at = far.argmin(1)
            codes[a : a + STEP, p] = at
            error[a : a + STEP] += far[np.arange(len(rows)), at] + (part * part).sum(1)
    return codes, error


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    """Assignments of a batch; -1 where there was none."""
    return np.frombuffer(b"".join(c if c is not None else b"\xff" * 2 * parts for c in column.to_pylist()), "<i2").reshape(-1, parts)


def reassigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The table of the next round: rows (id, label, v, code) with new codes, and for each task and entry that gained or lost, a row with part,
    entry, n and sums, what is to be added to its count and to its components."""
    parts, entries, width = books.shape
    hold = state.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int64())), ("code", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), parts * width)
            old = _codes(batch.column("code"), parts)
            new, _ = nearest(x, hold.value)
            for p in range(parts):
                moved = np.flatnonzero(old[:, p] != new[:, p])
                part = x[moved, p * width : (p + 1) * width]
                np.add.at(n[p], new[moved, p], 1)
                np.add.at(sums[p], new[moved, p], part)
                left = old[moved, p] >= 0
                np.add.at(n[p], old[moved[left], p], -1)
                np.add.at(sums[p], old[moved[left], p], -part[left])
            code = pa.array([c.tobytes() for c in new.astype("<i2")], pa.binary())
            columns = [batch.column("id"), batch.column("label"), batch.column("v"), code]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(x), t) for t in schema.types[4:]]], schema=schema)
        p, e = np.nonzero((n != 0) | (sums != 0).any(2))
        if len(p):
            columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(p), t) for t in schema.types[:4]], *columns], schema=schema)

    return durable(map_arrow(state, run, "id bigint, label string, v array<bigint>, code binary, part int, entry int, n bigint, sums array<bigint>"))


def changes(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contributions that a round has written, added up: counts (parts, entries) and sums (parts, entries, width)."""
    parts, entries, width = books.shape
    rows = table.where("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for r in rows.collect():  # a row for each entry of the codebooks at most
        n[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"]] = r["sums"]
    return n, sums


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label as string, code as int16s, error), written down, and the final codebooks (parts, entries, width)."""
    spark = vectors.sparkSession
    with scratch() as keep:
        rows = whole_vectors(vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("v")), "v", scale)
        first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # as many as entries
        if not first:
            return keep(durable(spark.createDataFrame([], "vec_id bigint, label string, code binary, error bigint"))), np.zeros((parts, 0, 0), np.int64)
        dim = len(first[0]["v"])
        if dim % parts or any(len(r["v"]) != dim for r in first):
            raise ValueError(f"{parts} equal parts need vectors of one length that they divide")
        width = dim // parts
        books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
        state, table = rows.withColumn("code", F.lit(None).cast("binary")), None
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _ in range(rounds):
            before, table = table, reassigned(state, books)
            if before is not None:
                release(before)
            state = table.where("part IS NULL").select("id", "label", "v", "code")
            dn, dsums = changes(table, books)
            n += dn
            sums += dsums
            books = np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], books)
        hold = spark.sparkContext.broadcast(books)

        def run(batches):
            for batch in batches:
                codes, error = nearest(matrix(batch.column("v"), dim), hold.value)
                code = pa.array([c.tobytes() for c in codes.astype("<i2")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])

        return keep(durable(map_arrow(state, run, "vec_id bigint, label string, code binary, error bigint"))), books


def digest(books: np.ndarray) -> str:
    """Hexadecimal sha256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hexadecimal digits for each part), error, label_error (errors of equal labels, nulls together), codebooks_sha256."""
    rows, books = compress(vectors)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    # entries stay below 256, so the low byte of each number is the entry
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.lower(F.substring(F.hex("code"), p * 4 + 1, F.lit(2)))), "")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
