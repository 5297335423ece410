"""A training corpus from the documents: five stages, each written as Parquet and read again by the next.

Language identification drops documents whose language can't be told, the similarity join keeps one document of
each group of near copies (five words, 0.8), decontamination drops documents that hold benchmark items, mixing
draws documents to the sources' target weights in the order of the curriculum (a document may come more
than once), and sharding cuts them in that order, which the written table keeps, into shards of equal bytes.

Defined cases: documents of null or letterless text go in the first stage; null and repeated ids are rows like others, and of equal texts one
row stays; empty tables give none; further columns come along unchanged, but for `shard` and `slot`, which the last stage replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import decontam, jaccard_join, langid, mixing, sharding
from larkspan.llm.common import delete, owned, scratch, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_in_order(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Language ID, the join and the hash orders of mixing and sharding have no SQL equivalent; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Between stages stand tables in the shared folder; each goes when the next one is
    written, and so does all that the stage has written for itself. The last goes as the process ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(before)
        docs, before = spark.read.parquet(path), path
    owned(path)
    return docs
