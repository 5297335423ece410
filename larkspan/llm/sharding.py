"""Contiguous shards of nearly equal bytes, by global prefix sums.

Documents are ordered by a hash of their text, then of their id, so equal texts stand together. Rows
are range-partitioned in that order; each partition's total of bytes, summed over the partitions ahead,
makes a document's global offset, and the axis of bytes is cut at equal targets. A group of equal texts
that a cut would part goes whole to the shard of its middle if it is small beside a shard
(`group_tolerance`); a larger one is parted, as shards could not be equal otherwise.

Where the rows have an order of their own (the pipeline's curriculum), `shard_in_order` cuts the axis of bytes along it instead;
copies then stay where the order has them.

Native; a hot group of texts spreads over range partitions, since the id's hash is part of the order.
Collected or broadcast: one row for each partition or shard, never one for each document.

Defined cases: a null text has no bytes and groups with empty texts; null ids and repeated rows are
placed like others (rows that agree in everything are interchangeable); other columns come along where texts do, whatever
their names, but for `shard` and `slot`, which are replaced; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, fresh, prefix_sums, scratch, with_places, with_rows

#: Bytes that a document takes besides its text.
OVERHEAD = 8


def assign_shards(keys: DataFrame, shards: int, group_tolerance: float = 0.02, order: Sequence[str] = ()) -> DataFrame:
    """Adds shard and slot to rows with size, text_hash, id_hash and doc_id. Other columns come along.

    order: columns to follow in place of the hashes; groups of equal texts aren't kept together then.
    """
    by_hash = not order
    order = list(order) or ["text_hash", "id_hash", "doc_id"]
    at = durable(prefix_sums(keys, [], order, "size"))
    whole = at.agg(F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("_whole"))
    cut = lambda middle2: F.least(F.lit(shards - 1), F.expr(f"cast(({middle2}) * {shards} div greatest(2 * _whole, 1) as int)"))
    # one row, the total of all bytes
    placed = at.join(F.broadcast(whole)).withColumn("shard", cut("2 * before + size"))
    if by_hash:
        # a group that spans shards holds one of the cuts, so there are fewer of these than shards
        parted = (
            placed.groupBy("text_hash", "_whole")
            .agg(F.min("shard").alias("_a"), F.max("shard").alias("_b"), F.sum("size").alias("_g"), F.min("before").alias("_from"))
            .where((F.col("_a") < F.col("_b")) & (F.col("_g") * shards <= group_tolerance * F.col("_whole")))
            .select(F.col("text_hash").alias("_h"), cut("2 * _from + _g").alias("_to"))
        )
        placed = placed.join(F.broadcast(parted), F.col("text_hash") == F.col("_h"), "left").withColumn("shard", F.coalesce("_to", "shard"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("_first")).withColumnRenamed("shard", "_shard")
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("_shard"))
    return out.select(*keys.columns, "shard", (F.col("rank") - F.col("_first")).alias("slot"))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """What sharding needs of each document; texts are read once and not shuffled."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # orders that any engine has
        F.md5(text.cast("binary")).alias("text_hash"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("id_hash"),
        *extra,
    )


def shard_documents(docs: DataFrame, shards: int = 24, group_tolerance: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    with scratch() as keep:
        placed = assign_shards(durable(keyed(docs)), shards, group_tolerance)
        return keep(durable(placed.select("doc_id", "size", "text_crc32", "shard", "slot")))


def shard_with_texts(docs: DataFrame, shards: int = 24, group_tolerance: float = 0.02) -> DataFrame:
    """All columns of `docs` with shard and slot, which replace columns of these names; texts are shuffled once."""
    row = fresh(docs, "_row")
    rows = with_rows(docs, row)
    with scratch() as keep:
        where = assign_shards(durable(keyed(rows.select("doc_id", "text", F.col(row).alias("_row")), "_row")), shards, group_tolerance)
        where = keep(durable(where.select(F.col("_row").alias(row), "shard", "slot")))
    return rows.drop("shard", "slot").join(where, row).select(*_others(docs), "shard", "slot")


def _others(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]


def shard_in_order(docs: DataFrame, shards: int = 24) -> DataFrame:
    """As shard_with_texts, along the order in which the rows of `docs` stand: shards follow each other in it, and slots within them.

    Rows of files stand by the files' names (part files are numbered, with more digits beyond 99999) and by place in them, others by partition.
    A shard is one run of places in each file that it touches, so texts aren't shuffled: the runs, at most a row for each file and shard, are broadcast.
    """
    file, place = fresh(docs, "_file"), fresh(docs, "_place")
    rows = with_places(docs, file, place)
    with scratch() as keep:
        path = F.col(file)
        name = F.substring_index(path, "/", -1)
        # files of one name in several folders stand one after the other
        order = {"_o0": F.length(name), "_o1": name, "_o2": path, "_o3": F.col(place)}
        size = (F.octet_length(F.coalesce("text", F.lit(""))) + OVERHEAD).cast("long")
        where = assign_shards(durable(rows.select(size.alias("size"), *[c.alias(n) for n, c in order.items()])), shards, 0.0, list(order))
        spans = where.groupBy("_o2", "shard").agg(F.min("_o3").alias("_first"), F.max("_o3").alias("_last"), F.min("slot").alias("_slot"))
        spans = keep(durable(spans.select(F.col("_o2").alias("_path"), F.col("shard").alias("_shard"), "_first", "_last", "_slot")))
    columns = [*[c.alias(f"_c{i}") for i, c in enumerate(_others(docs))], F.col(file).alias("_at_file"), F.col(place).alias("_at")]
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    found = rows.select(*columns).join(F.broadcast(spans), (F.col("_at_file") == F.col("_path")) & F.col("_at").between(F.col("_first"), F.col("_last")))
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_shard").alias("shard"), (F.col("_at") - F.col("_first") + F.col("_slot")).alias("slot"))
