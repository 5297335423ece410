"""Helpers that the operators of this subpackage share: durable tables, columns, distributed prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Durable tables by the scope that owns them, the innermost last; those of the first go as the process ends.
_scopes: list[list[str]] = [[]]
#: Words as the contracts define them: runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, which is any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of this machine, if all of Spark runs on it (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if folder is None:
            folder = tempfile.mkdtemp(prefix="larkspan-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow on executors that needn't have this package: Spark hands it to them, once for each context."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_larkspan_sent", False):
        package = Path(__file__).resolve().parent.parent
        # the driver serves this file to executors as long as it lives
        folder = tempfile.mkdtemp(prefix="larkspan-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = f"{folder}/larkspan-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(target)
        sc._larkspan_sent = True
    return df.mapInArrow(function, schema)


def durable(df: DataFrame, hashes: Sequence[str] = ()) -> DataFrame:
    """`df` as a written table in the shared folder: its lineage ends there, and no lost executor costs its rows.

    hashes: columns of few equal values, for which no dictionary is tried.

    What isn't a function of the input alone (partition ids, generated ids, samples) gets fixed by this. The innermost
    open scope owns the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    owned(path)
    df.write.options(compression="zstd", **{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspan_path = path
    return out


def fewer(df: DataFrame) -> DataFrame:
    """`df`, of narrow rows that a shuffle has dealt, in an eighth of its partitions, but two for each core at least: tasks of few rows cost more than these."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, parts // 8, min(parts, 2 * df.sparkSession.sparkContext.defaultParallelism)))


def owned(path: str) -> None:
    """Makes the innermost open scope the owner of a folder."""
    if not _scopes[0] and len(_scopes) == 1:
        atexit.register(_end)
    _scopes[-1].append(path)


def _end() -> None:
    # the JVM may be gone by now
    with contextlib.suppress(Exception):
        while _scopes[0]:
            delete(_scopes[0].pop())


def delete(path: str) -> None:
    jvm = SparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    sc = SparkContext._active_spark_context
    conf = sc._jsc.hadoopConfiguration() if sc is not None else jvm.org.apache.hadoop.conf.Configuration()
    target.getFileSystem(conf).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Deletes durable tables that nothing reads any more."""
    for path in [t._larkspan_path for t in tables]:
        next(s for s in reversed(_scopes) if path in s).remove(path)
        delete(path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Owns the durable tables that are written inside and deletes them at its end, but for those that are handed to the
    function it yields: the scope around this one owns these. Tables that others have written are left alone."""
    own: list[str] = []
    _scopes.append(own)

    def keep(table: DataFrame) -> DataFrame:
        own.remove(table._larkspan_path)
        around = _scopes[_scopes.index(own) - 1] if own in _scopes else _scopes[0]
        if around is _scopes[0] and not around:
            atexit.register(_end)
        around.append(table._larkspan_path)
        return table

    try:
        yield keep
    finally:
        _scopes[:] = [s for s in _scopes if s is not own]
        for path in own:
            delete(path)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done, which it does as the driver forgets them."""
    for _ in range(2):  # what the first frees can hold more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores ahead until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def _only_scan(plan, through: Sequence[str]) -> bool:
    """Whether a plan reads one table of files and drops or computes columns and rows, so that no row of a file comes twice."""
    name = plan.getClass().getSimpleName()
    if name == "LogicalRelation":
        return True
    return name in through and _only_scan(plan.children().head(), through)


def only_scan(docs: DataFrame, whole: bool = False) -> bool:
    """whole: whether it also has all rows of the files."""
    return _only_scan(docs._jdf.queryExecution().analyzed(), ("Project", "SubqueryAlias") if whole else ("Project", "Filter", "SubqueryAlias"))


def with_rows(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a string column `name` that is unique and the same in each reading, so that what is found on narrow
    rows can be joined back to them: file and place in it, or where docs isn't a scan of files, a number that is written down with them."""
    if only_scan(docs):
        with contextlib.suppress(AnalysisException):
            return docs.select("*", F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(name))
    return durable(docs.withColumn(name, F.monotonically_increasing_id().cast("string")))


def with_places(docs: DataFrame, file: str, place: str) -> DataFrame:
    """`docs` with columns `file` and `place`, the path of a row's file and its place in it, from 0 without gaps; what isn't a scan of whole files is written down first."""
    at = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)]
    if only_scan(docs, whole=True):
        with contextlib.suppress(AnalysisException):
            return docs.select("*", *at)
    return durable(docs).select("*", *at)


def numbered(df: DataFrame) -> DataFrame:
    """`df`, written down, with a unique `_row`, so that what is found on narrow rows can be joined back to them."""
    return durable(df.withColumn("_row", F.monotonically_increasing_id()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running(numbers: Column, block: int = 64) -> Column:
    """Of an array of longs: for each element the sum of those before it.

    Sums of whole blocks come first, so the work per element is bounded by `block` and no array
    is copied once per element.
    """
    n = F.size(numbers)
    blocks = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda k: total(F.slice(numbers, k * block + 1, F.lit(block))),
    )
    before = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"]).alias("all")),
        lambda a: a["all"],
    )
    return let(
        before,
        lambda b: F.transform(
            numbers,
            lambda x, i: F.get(b, (i / block).cast("int")) + total(F.slice(numbers, (i / block).cast("int") * block + 1, i % block)),
        ),
    )


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a Java pattern, as array<struct<start, end, value>>.

    Offsets count code points, `end` is exclusive. What lies between the matches gives the offsets.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = let(gaps, lambda g: F.transform(found, lambda m, i: (F.length(F.get(g, i)) + F.length(m)).cast("long")))
        return let(
            lengths,
            lambda n: let(
                running(n),
                lambda b: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(b, i) + F.get(n, i) - F.length(m)).alias("start"),
                        (F.get(b, i) + F.get(n, i)).alias("end"),
                        m.alias("value"),
                    ),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def prefix_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """Adds `before` and `rank`: within each group, the sum of `value` and the number of rows ahead in `order`.

    Rows are range-partitioned by groups and order, so no group, however large, has to fit a task. The
    placement is written down (it samples its input); each partition's totals, a row for each
    partition and group in it, are summed and joined back.
    """
    spark = df.sparkSession
    keys = [*groups, *order]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    of = lambda *c: Window.partitionBy(*groups, *c)
    ahead = (
        placed.groupBy("_part", *groups)
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_w", F.lit(0))
    )
    w = (of() if groups else Window.partitionBy("_w")).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.coalesce(F.sum("_sum").over(w), F.lit(0).cast("long")).alias("_sum"),
        F.coalesce(F.sum("_rows").over(w), F.lit(0).cast("long")).alias("_rows"),
    )
    here = of("_part").orderBy(*order)
    local = placed.withColumns(
        {
            "_s": F.coalesce(F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
            "_r": F.row_number().over(here) - 1,
        }
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(ahead, on)
    return joined.select(*df.columns, (F.col("_s") + F.col("_sum")).alias("before"), (F.col("_r") + F.col("_rows")).alias("rank"))
