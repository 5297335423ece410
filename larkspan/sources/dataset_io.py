"""Datasets of examples as JSON lines, one folder or file for each split, written whole or not at all.

A dataset folder has a folder of JSON-lines files for each split, and a log of commits. A write goes in one pass over its input into a folder of its
own, by split; its files are then moved beside the others under the name of the write, and a commit that lists the writes which count makes it
visible. Readers see the last commit only: a write that fails on the way leaves the dataset as it was. Folders without a log, which others
have written, are read as they are, and an append takes their files over first. A dataset has one writer at a time; of two commits of one number the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from larkspan.functions.invariants import require_valid
from larkspan.functions.schema import EXAMPLE, NUMBERED_ID, SPLITS
from larkspan.sources.cluster import delete, files
from larkspan.sources.journal import names, put

LOG = "_commits"


def commits(spark: SparkSession, folder: str) -> tuple[int, list[str]] | None:
    """The number of the last commit and the writes that count; None without a log."""
    found = [n for n in names(spark, f"{folder}/{LOG}") if n.endswith(".json")]
    if not found:
        return None
    text = spark.read.text(f"{folder}/{LOG}/{found[-1]}", wholetext=True).first()[0]
    return int(found[-1].removesuffix(".json")), json.loads(text)["writes"]


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _split(spark: SparkSession, folder: str, split: str, state: tuple[int, list[str]] | None) -> DataFrame | None:
    path = f"{folder}/{split}.jsonl"
    if state is None:
        return _lines(spark, path)
    have = {n.split("-")[0] for n in names(spark, path)}
    writes = [w for w in state[1] if w in have]
    return _lines(spark, f"{path}/{{{','.join(writes)}}}-*") if writes else spark.createDataFrame([], EXAMPLE)


def read_dataset(spark: SparkSession, folder: str, splits: tuple[str, ...] = SPLITS, check: bool = True, text: bool = True) -> DataFrame:
    """The examples of those splits that are there; fails if none is. Only the asked splits' files are listed and read. text: whether the check asks for one."""
    state = commits(spark, folder)
    found = [df for s in splits if (df := _split(spark, folder, s, state)) is not None]
    if not found:
        raise ValueError(f"no dataset in {folder}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    out = out.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "rationale": F.coalesce("rationale", F.lit(""))})
    return require_valid(out, ids=NUMBERED_ID, text=text) if check else out


def _staged(examples: DataFrame, path: str) -> bool:
    """Writes all splits in one pass under a path; whether there were rows."""
    rows = examples.withColumn("labels", F.array_sort("labels")).select(*EXAMPLE.names, F.col("split").alias("_split"))
    rows.write.partitionBy("_split").option("ignoreNullFields", "false").json(path)
    return any(n.startswith("_split=") for n in names(examples.sparkSession, path))


def _move(spark: SparkSession, staged: str, folder: str, write: str) -> None:
    """Moves the files of a finished write beside those of others; nobody reads them before its commit."""
    fs, _ = files(spark, folder)
    for split in SPLITS:
        _, target = files(spark, f"{folder}/{split}.jsonl")
        fs.mkdirs(target)
        for n in names(spark, f"{staged}/_split={split}"):
            if n.startswith("part-"):
                _, source = files(spark, f"{staged}/_split={split}/{n}")
                _, place = files(spark, f"{folder}/{split}.jsonl/{write}-{n}")
                if not fs.rename(source, place):
                    raise OSError(f"{source} couldn't be moved")


def _adopt(spark: SparkSession, folder: str) -> list[str]:
    """Gives the files of a dataset without a log the name of a write; a single file moves into a folder of its name."""
    fs, _ = files(spark, folder)
    found = []
    for split in SPLITS:
        _, target = files(spark, f"{folder}/{split}.jsonl")
        if not fs.exists(target):
            continue
        if not fs.getFileStatus(target).isDirectory():
            _, aside = files(spark, f"{folder}/.{split}-{uuid.uuid4().hex}")
            _, place = files(spark, f"{folder}/{split}.jsonl/w0-{split}.json")
            if not (fs.rename(target, aside) and fs.mkdirs(target) and fs.rename(aside, place)):
                raise OSError(f"{target} couldn't be taken over")
        for n in names(spark, f"{folder}/{split}.jsonl"):
            if not n.startswith(("_", ".", "w0-")):
                fs.rename(files(spark, f"{folder}/{split}.jsonl/{n}")[1], files(spark, f"{folder}/{split}.jsonl/w0-{n}")[1])
        found.append(split)
    return ["w0"] if found else []


def _write(examples: DataFrame, folder: str, append: bool) -> bool:
    """Whether there was anything to write."""
    spark = examples.sparkSession
    state = commits(spark, folder)
    write = f"w{uuid.uuid4().hex}"
    staged = f"{folder}/_staged-{write}"
    try:
        some = _staged(examples, staged)
        if some:
            if state is None:
                state = (0, _adopt(spark, folder) if append else [])
            _move(spark, staged, folder, write)
            writes = [*(state[1] if append else []), write]
            if not put(spark, f"{folder}/{LOG}/{state[0] + 1:08d}.json", json.dumps({"writes": writes})):
                raise RuntimeError(f"another write to {folder} was committed meanwhile")
            if not append:
                _sweep(spark, folder, write)
        return some
    finally:
        delete(spark, staged)


def _sweep(spark: SparkSession, folder: str, keep: str) -> None:
    """Deletes what a committed write has replaced."""
    for split in SPLITS:
        for n in names(spark, f"{folder}/{split}.jsonl"):
            if not n.startswith(f"{keep}-"):
                delete(spark, f"{folder}/{split}.jsonl/{n}")


def write_dataset(examples: DataFrame, folder: str) -> None:
    """Replaces all splits, empty ones too; an empty dataset is refused, and leaves the folder as it was."""
    if not _write(examples, folder, False):
        raise ValueError("an empty dataset isn't written")


def append_dataset(examples: DataFrame, folder: str) -> None:
    """Adds to the splits that have examples; nothing to add is no error."""
    _write(examples, folder, True)
