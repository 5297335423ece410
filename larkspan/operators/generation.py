"""The dataset generator: templates and a model make examples, a second model checks them, hard negatives are added.

A driver loop over Spark jobs. Each round plans from what there is, makes the missing rows, validates and keeps them; what a round has made, and every
answer of a model, is a table of a journal (`sources/journal.py`) before the next step reads it. Rows have keys from round, origin and
ordinal, so a lost executor or a restart with the same configuration goes on from the last table and comes to the same dataset; the journal goes once
the dataset is written. Model calls are the only Python on executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import prompts
from larkspan.functions import quotas as shares
from larkspan.functions.ranking import ranked, seeded
from larkspan.functions.scalars import OVER_REQUEST, batch_size
from larkspan.functions.schema import DOMAINS, SPLITS
from larkspan.operators import datasets, templates, validation
from larkspan.sources import dataset_io
from larkspan.sources.answers import FAILURES, answered, one_pass
from larkspan.sources.journal import Journal
from larkspan.sources.templates import load_templates

RAW = ("text", "labels", "risk", "rationale", "is_hard_negative", "domain", "source")


@dataclass(frozen=True)
class GenerationConfig:
    templates_dir: str
    output_dir: str
    total_count: int = 20000
    template_fraction: float = 0.5
    hard_negative_ratio: float = 0.1
    seed: int | None = None
    rounds: int = 3
    #: The model's name sets how many examples a call asks for; batch overrides that for the checks.
    model: str = ""
    batch: int | None = None

    def __post_init__(self) -> None:
        if self.total_count <= 0:
            raise ValueError("total_count must be positive")
        if not 0 < self.template_fraction < 1:
            raise ValueError("template_fraction must lie between 0 and 1")
        if not 0 <= self.hard_negative_ratio < 1:
            raise ValueError("hard_negative_ratio must be at least 0 and below 1")

    def size(self, kind: str) -> int:
        """Examples of a call."""
        return batch_size(self.model, kind)


def plan(config: GenerationConfig, have: int) -> tuple[int, int]:
    """Template and model rows that are missing. Python's round is half-even."""
    goal = round(config.total_count * (1 - config.hard_negative_ratio))
    left = max(0, goal - have)
    template = round(left * config.template_fraction)
    return template, left - template


def over(n: int) -> int:
    """What is asked for to get n."""
    return -(-n * round(10 * OVER_REQUEST) // 10)


def calls(spark: SparkSession, wanted: list[tuple[str, int]], size: int) -> DataFrame:
    """call, name, size: for each (name, number) as many calls as it takes, of at most `size` each."""
    rows = spark.createDataFrame([(n, k, -(-k // size)) for n, k in wanted if k > 0], "name string, wanted bigint, calls bigint")
    rows = rows.select("name", "wanted", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("calls") - 1)).alias("nth"))
    return rows.select(F.format_string("%s-%06d", "name", "nth").alias("call"), "name", F.least(F.lit(size).cast("bigint"), F.col("wanted") - F.col("nth") * size).alias("size"))


def from_model(spark: SparkSession, count: int, client: Callable[[str], str], journal: Journal, name: str, size: int) -> DataFrame:
    """`count` examples with origin and ordinal, in equal shares of the domains, asked for in calls of at most `size`.

    Each pass asks for what is missing by domain; one that brings nothing is left out from then on, so that the others make up for it. Passes go on until there
    are enough, or until `FAILURES` in a row bring nothing, which raises if there is nothing at all.
    """
    parts: list[DataFrame] = []
    have = {d: 0 for d in DOMAINS}
    turn = in_row = 0
    dry: set[str] = set()
    while sum(have.values()) < count and in_row < FAILURES:
        open_ = [d for d in DOMAINS if d not in dry] or list(DOMAINS)
        shared = count - sum(have[d] for d in DOMAINS if d not in open_)
        goal = {d: shared // len(open_) + (i < shared % len(open_)) for i, d in enumerate(open_)}
        missing = count - sum(have.values())
        short = {d: max(0, goal.get(d, 0) - have[d]) for d in DOMAINS}
        whole = sum(short.values())
        # no more than is missing altogether, by domain in proportion to what each lacks
        wanted = [(d, over(-(-short[d] * missing // whole))) for d in DOMAINS if short[d]]
        asked = calls(spark, wanted, size)
        prompt = asked.select(F.concat(F.lit(f"{turn}-"), "call").alias("call"), prompts.generation_prompt(F.col("size"), F.col("name")).alias("prompt"))
        replies = journal.table(f"{name}-{turn}", lambda: one_pass(prompt, client))  # noqa: B023
        items = replies.select("call", F.posexplode(F.transform(F.try_variant_get(F.try_parse_json("response"), "$", "array<variant>"), lambda x: F.to_json(x))).alias("place", "entry"))
        made = validation.generated_examples(items).withColumn("asked_for", F.element_at(F.split("call", "-"), 2))
        made = journal.table(f"{name}-{turn}-examples", lambda: made.select("call", "place", "asked_for", *RAW))  # noqa: B023
        got = {r["asked_for"]: r["n"] for r in made.groupBy("asked_for").agg(F.count("*").alias("n")).collect()}
        dry = (dry | {d for d, _ in wanted}) - set(got)
        if not got:
            journal.drop(f"{name}-{turn}")
            journal.drop(f"{name}-{turn}-examples")
            in_row += 1
            continue
        in_row, turn = 0, turn + 1
        parts.append(made)
        have = {d: have[d] + got.get(d, 0) for d in DOMAINS}
    if not parts:
        raise RuntimeError(f"{FAILURES} passes in a row brought no example")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    # a row for each domain
    quota = shares.apportion(spark.createDataFrame([(d, 1, have[d]) for d in DOMAINS], "group string, weight bigint, cap bigint"), count)
    hashed = rows.withColumn("_h", seeded(name, "call", "place"))
    taken = shares.first_of(hashed, "asked_for", "_h", ["call", "place"], quota)
    return taken.select(*RAW, F.lit("model").alias("origin"), F.concat_ws("-", "call", "place").alias("ordinal"))


def validated(examples: DataFrame, client: Callable[[str], str], journal: Journal, name: str, size: int) -> DataFrame:
    """A verdict on each example that isn't from a template. Batches without an answer are asked again; answers that are there are kept."""

    def check(rows: DataFrame) -> DataFrame:
        numbered = ranked(rows.withColumns({"_h": seeded("batches", "id"), "_all": F.lit(1)}), ["_all"], "_h", ["id"])
        numbered = numbered.withColumn("_o", F.col("position") - 1).drop("position", "group_size", "_h", "_all")
        grouped = journal.table(f"{name}-batches", lambda: validation.batches(numbered, "_o", size).drop("_o"))
        asked = grouped.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "id", "text", "labels", "risk", "rationale"))).alias("b"))
        asked = asked.select(F.col("batch").cast("string").alias("call"), prompts.validation_prompt(F.transform("b", lambda x: x.dropFields("place"))).alias("prompt"))
        replies = answered(asked, client, journal, name)
        return validation.match(grouped, replies.select(F.col("call").cast(grouped.schema["batch"].dataType).alias("batch"), "response"))

    return validation.through(examples, check)


def negatives_of(spark: SparkSession, count: int, client: Callable[[str], str], journal: Journal, name: str, size: int) -> DataFrame:
    """text and ordinal of usable hard-negative texts, asked for in calls of at most `size`. Passes go on until there are as many as are asked for, or `FAILURES` in a row bring none."""
    parts: list[DataFrame] = []
    have = turn = in_row = 0
    wanted = over(count)
    while have < wanted and in_row < FAILURES:
        asked = calls(spark, [("texts", wanted - have)], size)
        prompt = asked.select(F.concat(F.lit(f"{turn}-"), "call").alias("call"), prompts.hard_negative_prompt(F.col("size")).alias("prompt"))
        replies = journal.table(f"{name}-{turn}", lambda: one_pass(prompt, client))  # noqa: B023
        items = replies.select("call", F.posexplode(F.from_json("response", "array<string>")).alias("place", "text"))
        usable = validation.usable_texts(items.where("text IS NOT NULL"))
        usable = usable.select("text", F.format_string("%06d-%s-%06d", F.lit(turn), "call", "place").alias("ordinal"))
        made = usable.count()
        if not made:
            journal.drop(f"{name}-{turn}")
            in_row += 1
            continue
        in_row, turn, have = 0, turn + 1, have + made
        parts.append(usable)
    if not parts:
        raise RuntimeError(f"{FAILURES} passes in a row brought no hard negative")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    return rows


def _run(config: GenerationConfig, stats: dict) -> str:
    """The name of a run: the same configuration over the same dataset goes on with the same journal."""
    state = {s: (r["n"], r["max_id"]) for s, r in sorted(stats.items())}
    return hashlib.sha256(json.dumps([asdict(config), state], sort_keys=True).encode()).hexdigest()[:24]


def generate_dataset(spark: SparkSession, config: GenerationConfig, writer: Callable[[str], str] | None = None, checker: Callable[[str], str] | None = None, negatives: Callable[[str], str] | None = None) -> DataFrame:
    """Brings the dataset in the output folder up to the configured size and returns its statistics.

    Without a writer all rows come from templates; without a checker none is checked; without negatives none is added. RuntimeError if `rounds` rounds
    don't reach the size; what they have made stays in the journal. Ids go on after the largest there is, and hard negatives are in proportion to what this
    call has added.
    """
    seed = 0 if config.seed is None else config.seed
    table = load_templates(spark, config.templates_dir)
    try:
        stats = {r["split"]: r for r in datasets.dataset_stats(dataset_io.read_dataset(spark, config.output_dir)).collect()}
    except ValueError:
        stats = {}
    at_start = sum(r["n"] - r["hard_negatives"] for r in stats.values())
    if sum(plan(config, at_start)) == 0:
        return datasets.dataset_stats(dataset_io.read_dataset(spark, config.output_dir))
    journal = Journal(spark, f"{config.output_dir.rstrip('/')}-journal/{_run(config, stats)}")
    offsets = {s: (stats[s]["max_id"] or 0) if s in stats else 0 for s in SPLITS}
    have, added = at_start, []
    for attempt in range(config.rounds):
        n_template, n_model = plan(config, have)
        if writer is None:
            n_template, n_model = n_template + n_model, 0
        if n_template + n_model == 0:
            break
        parts = []
        if n_template:
            parts.append(templates.generate(spark, table, n_template, f"{seed}-{attempt}").select(*RAW, F.lit("template").alias("origin"), F.format_string("%012d", "row").alias("ordinal")))
        if n_model:
            parts.append(from_model(spark, n_model, writer, journal, f"{attempt}-model", config.size("structured")))
        raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        keyed = raw.withColumn("key", F.concat_ws(":", F.lit(str(attempt)), "origin", "ordinal")).drop("origin", "ordinal")
        before = dict(offsets)
        examples = journal.table(f"{attempt}-raw", lambda: datasets.assign_ids(datasets.assign_splits(keyed, "key", seed), "key", seed, before).drop("key"))  # noqa: B023
        if checker is not None:
            checked = validated(examples, checker, journal, f"{attempt}-check", config.batch or config.size("validation"))
            examples = journal.table(f"{attempt}-checked", lambda: checked)  # noqa: B023
        now = datasets.dataset_stats(examples).collect()
        added.append(examples)
        have += sum(r["n"] for r in now)
        offsets |= {r["split"]: max(offsets[r["split"]], r["max_id"]) for r in now}
    goal = at_start + sum(plan(config, at_start))
    if have < goal:
        raise RuntimeError(f"{config.rounds} rounds made {have - at_start} of {goal - at_start} examples")
    new = added[0]
    for more in added[1:]:
        new = new.unionByName(more)
    if negatives is not None and config.hard_negative_ratio > 0:
        need = datasets.hard_negative_counts(datasets.dataset_stats(new), config.hard_negative_ratio).agg(F.sum("needed")).first()[0] or 0
        if need:
            texts = negatives_of(spark, int(need), negatives, journal, "negatives", config.size("simple"))
            own = datasets.dataset_stats(new).drop("max_id").join(spark.createDataFrame(list(offsets.items()), "split string, max_id bigint"), "split")
            new = new.unionByName(datasets.hard_negatives(own, texts, config.hard_negative_ratio, "ordinal").select(*new.columns))
    (dataset_io.append_dataset if stats else dataset_io.write_dataset)(new, config.output_dir)
    journal.remove()
    return datasets.dataset_stats(dataset_io.read_dataset(spark, config.output_dir))
