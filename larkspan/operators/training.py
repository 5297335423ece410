"""The training table of a dataset: texts of the train split within the token limit, in a shuffled order that stands in the files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.prompts import MAX_TOKENS, formatted, words
from larkspan.functions.ranking import seeded
from larkspan.sources.cluster import staging
from larkspan.sources.dataset_io import read_dataset


def shuffled(rows: DataFrame, key: str, seed: int, parts: int | None = None) -> DataFrame:
    """All rows in the order of a keyed hash: ranges of it follow each other over partitions, so the files of a written table are a global shuffle.

    Ties, which are repeated keys, stand by side in any order."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.withColumn("_order", seeded(seed, key))
    return made.repartitionByRange(parts, "_order").sortWithinPartitions("_order").drop("_order")


def prepare_dataset(spark: SparkSession, folder: str, path: str, tokenize: Callable[[Column], Column] = words, limit: int = MAX_TOKENS, seed: int = 0, text: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """Writes the training table (id, text, n_tokens) of the dataset in a folder and returns it with the numbers of rows kept and skipped. text: as read_dataset has it.

    Both are counted while the rows are written, so the input is read and tokenized once.
    """
    seen = Observation()
    made = formatted(read_dataset(spark, folder, ("train",), text=text), tokenize)
    counted = made.observe(seen, F.count_if(F.col("n_tokens") <= limit).alias("kept"), F.count_if(F.col("n_tokens") > limit).alias("skipped"))
    rows = counted.where(F.col("n_tokens") <= limit).select("id", F.col("training_text").alias("text"), "n_tokens")
    # ranges are cut by a sample, which reads its input too: it reads what is written here
    with staging(spark) as folder_:
        rows.write.parquet(folder_)
        shuffled(spark.read.parquet(folder_), "id", seed).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), {k: int(v) for k, v in seen.get.items()}
