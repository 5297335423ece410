"""The query catalogue over the driver's tables, each with SQL that another engine can run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import jsonx, prompts, scalars
from larkspan.functions.features import ENTITIES, FEATURE_ORDER, PATTERNS, features, flags
from larkspan.functions.invariants import report_violations, violations
from larkspan.functions.prompts import AFTER, BEFORE, COMPLETION_END, MAX_TOKENS
from larkspan.functions.quotas import apportion, first_of
from larkspan.functions.ranking import file_places, seeded
from larkspan.functions.schema import LABELS
from larkspan.functions.subwords import counted
from larkspan.operators import baseline, datasets, hook, metrics, recogniser, templates, tfidf, validation
from larkspan.operators.training import prepare_dataset
from larkspan.plans import derived
from larkspan.plans.derived import SQL_EXAMPLES, SQL_PAIRS, examples, predictions, preds_b, table
from larkspan.sources.cluster import new_folder
from larkspan.sources.dataset_io import read_dataset, write_dataset
from larkspan.sources.reports import read_report, write_report
from larkspan.sources.templates import label_support, missing_labels, shipped_templates, template_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def joined(c: str | Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


def six(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


# --- text features ---------------------------------------------------------------------------------------------

_FLAGS_SQL = {n: f"CAST(regexp_matches(text, '{p}') AS BIGINT)" for n, p in PATTERNS.items()}


@query(
    f"""SELECT doc_id, {", ".join(f"{s} AS {n}" for n, s in _FLAGS_SQL.items())}, token_count, sentence_count, round(token_count / sentence_count, 6) AS avg_sentence_length,
  CAST(0 AS BIGINT) AS "ent_PERSON", CAST(0 AS BIGINT) AS "ent_ORG", CAST(0 AS BIGINT) AS "ent_GPE", CAST(0 AS BIGINT) AS "ent_DATE"
FROM (SELECT *, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS token_count,
  CAST(greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '\\S')))) AS BIGINT) AS sentence_count FROM documents)"""
)
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[(F.round(c, 6) if n == "avg_sentence_length" else c).alias(n) for n, c in f.items()])


@query(f"""SELECT lang, count(*) AS n, {", ".join(f"CAST(sum({s}) AS BIGINT) AS {n}" for n, s in _FLAGS_SQL.items())} FROM documents GROUP BY lang""")
def pattern_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in flags(F.col("text")).items()])


# --- metrics ---------------------------------------------------------------------------------------------------


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair(predictions(spark, sf_dir), examples(spark, sf_dir), "doc_id")


def _confusion_sql(source: str, name: str) -> str:
    one = lambda x: f"SELECT '{x}' AS label, count(*) FILTER (list_contains(pred, '{x}') AND list_contains(gold, '{x}')) AS tp, count(*) FILTER (list_contains(pred, '{x}') AND NOT list_contains(gold, '{x}')) AS fp, count(*) FILTER (NOT list_contains(pred, '{x}') AND list_contains(gold, '{x}')) AS fn FROM {source}"
    return f"{name} AS ({' UNION ALL '.join(map(one, LABELS))})"


def _f1_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM {source}))"""


def _report_sql(source: str, f1: str, name: str) -> str:
    return f"""{name} AS (SELECT (SELECT avg(f1) FROM {f1}) AS multilabel_f1, (SELECT f1 FROM {f1} WHERE label = 'QUASI-ID') AS quasi_id_f1, count(*) AS test_set_size,
  avg(CAST(pred_risk = gold_risk AS DOUBLE)) AS risk_accuracy, coalesce(avg(CAST(len(pred) = 0 AS DOUBLE)) FILTER (len(gold) > 0), 0) AS false_negative_rate,
  coalesce(avg(CAST(len(pred) = 0 AS DOUBLE)) FILTER (is_hard_negative), 1) AS hard_negative_precision, avg(CAST((len(pred) > 0) = (len(gold) > 0) AS DOUBLE)) AS gate_accuracy FROM {source})"""


_METRIC_SQL = f"{SQL_PAIRS}, {_confusion_sql('pairs', 'conf')}, {_f1_sql('conf', 'f')}, {_report_sql('pairs', 'f', 'report')}"
_BOTH_SQL = f"{_METRIC_SQL}, {_confusion_sql('pairs_b', 'conf_b')}, {_f1_sql('conf_b', 'f_b')}, {_report_sql('pairs_b', 'f_b', 'report_b')}"


@query(f"{_METRIC_SQL} SELECT * FROM conf")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_confusion(pairs(spark, sf_dir))


@query(f"{_METRIC_SQL} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_f1(pairs(spark, sf_dir)).withColumns(six("precision", "recall", "f1"))


_REPORT = ("multilabel_f1", "risk_accuracy", "false_negative_rate", "quasi_id_f1", "hard_negative_precision", "gate_accuracy")


@query(f"{_METRIC_SQL} SELECT 'a' AS model_name, test_set_size, {', '.join(f'round({m}, 6) AS {m}' for m in _REPORT)}, '' AS violations FROM report")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.evaluation_report(pairs(spark, sf_dir), "a").withColumn("violations", F.array_join(report_violations(), ","))
    return out.drop("f1_by_label").withColumns(six(*_REPORT))


@query(
    f"""{_BOTH_SQL} SELECT metric, round(a, 6) AS finetuned, round(b, 6) AS baseline, round(a - b, 6) AS delta FROM (
  {" UNION ALL ".join(f"SELECT '{m}' AS metric, r.{m} AS a, q.{m} AS b FROM report r, report_b q" for m in metrics.METRICS)}
  UNION ALL SELECT 'f1:' || f.label, f.f1, f_b.f1 FROM f JOIN f_b USING (label))"""
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = examples(spark, sf_dir)
    a, b = (metrics.evaluation_report(metrics.pair(p(spark, sf_dir), truth, "doc_id"), n) for n, p in (("a", predictions), ("b", preds_b)))
    return metrics.compare(a, b).withColumns(six("finetuned", "baseline", "delta"))


@query(f"""{_METRIC_SQL}, targets(metric, target, less) AS (VALUES {", ".join(f"('{m}', CAST({t} AS DOUBLE), {less})" for m, t, less in metrics.TARGETS)}),
v AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM report" for m in metrics.METRICS)})
SELECT metric, round(value, 6) AS value, CASE WHEN less THEN '<=' ELSE '>=' END AS op, target, CASE WHEN less THEN value <= target ELSE value >= target END AS passed FROM v JOIN targets USING (metric)""")
def targets_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.check_targets(metrics.evaluation_report(pairs(spark, sf_dir), "a")).withColumns(six("value"))


@query(f"""{SQL_PAIRS}, r(x) AS (VALUES ('LOW'), ('MEDIUM'), ('HIGH'))
SELECT g.x AS gold_risk, p.x AS pred_risk, count(doc_id) AS n FROM r g CROSS JOIN r p LEFT JOIN pairs ON gold_risk = g.x AND pred_risk = p.x GROUP BY ALL""")
def risk_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_matrix(pairs(spark, sf_dir))


@query(f"{_METRIC_SQL} SELECT test_set_size AS n, round(gate_accuracy, 6) AS gate_accuracy FROM report")
def gate_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gate_accuracy(pairs(spark, sf_dir)).withColumns(six("gate_accuracy"))


@query(f"{SQL_PAIRS} SELECT doc_id, a.risk AS risk_a, b.risk AS risk_b FROM preds_a a JOIN preds_b b USING (doc_id) WHERE a.risk <> b.risk")
def risk_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_disagreements(predictions(spark, sf_dir), preds_b(spark, sf_dir), "doc_id")


# --- datasets --------------------------------------------------------------------------------------------------

_SPLIT_SQL = f"""{SQL_EXAMPLES}, placed AS (SELECT *, row_number() OVER (PARTITION BY domain, risk ORDER BY md5('42:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY domain, risk) AS n FROM examples),
splits AS (SELECT * EXCLUDE (p, n), CASE WHEN p <= round_even(n * 0.8, 0) THEN 'train' WHEN p <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'test' END AS split FROM placed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42-ids:' || doc_id), doc_id) AS k FROM splits),
dataset AS (SELECT * EXCLUDE (k), printf('%s-%05d', split, k) AS id FROM numbered)"""


def with_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.assign_splits(examples(spark, sf_dir), "doc_id", 42)


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.assign_ids(with_splits(spark, sf_dir), "doc_id", 42)


@query(f"{_SPLIT_SQL} SELECT doc_id, domain, risk, split FROM splits")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_splits(spark, sf_dir).select("doc_id", "domain", "risk", "split")


@query(f"{_SPLIT_SQL} SELECT doc_id, id FROM dataset")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir).select("doc_id", "id")


@query(f"{_SPLIT_SQL} SELECT doc_id, printf('%s-%05d', split, k + CASE split WHEN 'train' THEN 500 WHEN 'test' THEN 20 ELSE 0 END) AS id FROM numbered")
def assign_ids_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.assign_ids(with_splits(spark, sf_dir), "doc_id", 42, {"train": 500, "test": 20}).select("doc_id", "id")


_STATS_SQL = "SELECT split, count(*) AS n, max(CAST(split_part(id, '-', 2) AS BIGINT)) AS max_id, count(*) FILTER (is_hard_negative) AS hard_negatives FROM dataset GROUP BY split"


@query(f"{_SPLIT_SQL} {_STATS_SQL}")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.dataset_stats(dataset(spark, sf_dir))


@query(f"{_SPLIT_SQL} SELECT split, n AS existing, max_id, CAST(round_even(n * 0.1 / (1 - 0.1), 0) AS BIGINT) AS needed FROM ({_STATS_SQL})")
def hard_negative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.hard_negative_counts(datasets.dataset_stats(dataset(spark, sf_dir)), 0.1)


@query(
    f"""{_SPLIT_SQL}, s AS ({_STATS_SQL}), need AS (SELECT *, CAST(round_even(n * 0.1 / (1 - 0.1), 0) AS BIGINT) AS needed, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS r FROM s),
b AS (SELECT *, coalesce(sum(needed) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM need),
rows AS (SELECT *, unnest(range(needed)) AS i FROM b), t AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS m FROM benchmark WHERE trim(text) <> '')
SELECT printf('%s-%05d', split, max_id + 1 + i) AS id, md5(text) AS text_md5, 'LOW' AS risk, split, (['medical', 'scheduling', 'workplace', 'personal'])[i % 4 + 1] AS domain, 'hard-negative' AS source
FROM rows JOIN t ON (before + i) % m = k UNION ALL SELECT id, md5(text), risk, split, domain, source FROM dataset"""
)
def inject_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = dataset(spark, sf_dir).drop("doc_id")
    texts = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return datasets.inject_hard_negatives(data, texts, 0.1, "item_id").select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "risk", "split", "domain", "source")


@query(
    f"""{_SPLIT_SQL}, p AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY md5('7:' || id), id) AS k, count(*) OVER (PARTITION BY split) AS n FROM dataset)
SELECT id, split FROM p WHERE k <= greatest(1, round_even(n * 0.05, 0))"""
)
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.review_sample(dataset(spark, sf_dir), 0.05, 7).select("id", "split")


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with doc_id % 50 = 0 get a risk and a reason, every second of them a reason again; three ids are unknown."""
    base = dataset(spark, sf_dir).where("doc_id % 50 = 0").select("id", "doc_id")
    none = F.lit(None)
    one = base.select("id", F.lit(1).alias("ord"), F.array(F.lit("LOCATION"), F.lit("ROUTINE")).alias("labels"), F.lit("HIGH").alias("risk"), F.lit("first look").alias("rationale"), none.cast("boolean").alias("is_hard_negative"), none.cast("string").alias("source"))
    two = base.where("doc_id % 100 = 0").select("id", F.lit(2).alias("ord"), none.cast("array<string>").alias("labels"), none.cast("string").alias("risk"), F.lit("second look").alias("rationale"), none.cast("boolean").alias("is_hard_negative"), none.cast("string").alias("source"))
    return one.unionByName(two)


@query(
    f"""{_SPLIT_SQL} SELECT id, array_to_string(CASE WHEN doc_id % 50 = 0 THEN ['LOCATION', 'ROUTINE'] ELSE labels END, ',') AS labels, CASE WHEN doc_id % 50 = 0 THEN 'HIGH' ELSE risk END AS risk,
  CASE WHEN doc_id % 100 = 0 THEN 'second look' WHEN doc_id % 50 = 0 THEN 'first look' ELSE rationale END AS rationale, is_hard_negative, '' AS violations FROM dataset"""
)
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.apply_corrections(dataset(spark, sf_dir).drop("doc_id"), _corrections(spark, sf_dir))
    return out.select("id", joined("labels").alias("labels"), "risk", "rationale", "is_hard_negative", F.array_join("violations", ",").alias("violations"))


@query("SELECT printf('train-%05d', 90000 + i) AS id FROM range(3) t(i)")
def unknown_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = spark.range(3).select(F.format_string("train-%05d", 90000 + F.col("id")).alias("id"))
    return datasets.unknown_corrections(_corrections(spark, sf_dir).select("id").union(unknown), dataset(spark, sf_dir))


def _responses(data: DataFrame, shift: bool) -> tuple[DataFrame, DataFrame]:
    """Batches of the model's examples with responses: by doc_id % 5 confirmed, relabelled, refused, mislabelled or left out; shift: no id is right."""
    rows = data.where("source = 'llm-augmented'").withColumn("batch", F.expr("doc_id div 80")).withColumn("place", F.expr("(doc_id % 80) div 2"))
    kind = F.col("doc_id") % (F.lit(1) if shift else F.lit(5))
    ident = F.concat(F.lit("x" if shift else ""), "id")
    entry = (
        F.when(kind == 0, F.to_json(F.struct(ident.alias("id"), "labels", "risk", "rationale")))
        .when(kind == 1, F.to_json(F.struct(ident.alias("id"), F.array(F.lit("CREDENTIAL")).alias("labels"), F.lit("HIGH").alias("risk"), F.lit("checked").alias("rationale"), F.lit(True).alias("valid"))))
        .when(kind == 2, F.to_json(F.struct(ident.alias("id"), "labels", F.lit(False).alias("valid"))))
        .when(kind == 3, F.to_json(F.struct(ident.alias("id"), F.array(F.lit("PHONE")).alias("labels"))))
    )
    # places within a batch are gapless, since all of its odd documents but hard negatives take part
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("doc_id")) - 1)
    replies = numbered.withColumn("e", entry).where("e IS NOT NULL").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "e"))).alias("l"))
    return numbered, replies.select("batch", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]")).alias("response"))


def written(df: DataFrame) -> DataFrame:
    """A table that a query reads more than once, in the shared folder; it goes as the process ends."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _match(spark: SparkSession, sf_dir: str, shift: bool) -> DataFrame:
    base = written(dataset(spark, sf_dir))
    data, replies = (written(t) for t in _responses(base, shift))
    rows = data.drop("batch", "place").unionByName(base.where("source = 'template'"))
    out = validation.through(rows, lambda _: validation.match(data, replies))
    return out.select("id", joined("labels").alias("labels"), "risk", "rationale")


_STRICT = "NOT (risk <> 'LOW' AND rationale = '') AND NOT (len(labels) = 0 AND risk <> 'LOW') AND NOT (risk = 'LOW' AND rationale <> '')"


@query(
    f"""{_SPLIT_SQL}, m AS (SELECT id, CASE doc_id % 5 WHEN 1 THEN ['CREDENTIAL'] ELSE labels END AS labels, CASE doc_id % 5 WHEN 1 THEN 'HIGH' ELSE risk END AS risk, CASE doc_id % 5 WHEN 1 THEN 'checked' ELSE rationale END AS rationale
  FROM dataset WHERE source = 'llm-augmented' AND doc_id % 5 IN (0, 1)), u AS (SELECT id, labels, risk, rationale FROM dataset WHERE source = 'template' UNION ALL SELECT * FROM m)
SELECT id, array_to_string(list_sort(labels), ',') AS labels, risk, rationale FROM u WHERE {_STRICT}"""
)
def validation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, False)


@query(f"{_SPLIT_SQL} SELECT id, array_to_string(list_sort(labels), ',') AS labels, risk, rationale FROM dataset WHERE source IN ('template', 'llm-augmented')")
def validation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, True)


@query(
    f"""{_SPLIT_SQL}, c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'train-1' ELSE id END AS id, CASE WHEN doc_id % 9 = 1 THEN ['PHONE'] ELSE labels END AS labels, CASE WHEN doc_id % 9 = 2 THEN 'SEVERE' ELSE risk END AS risk,
  CASE WHEN doc_id % 9 = 3 THEN '' ELSE text END AS text, CASE WHEN doc_id % 9 = 4 THEN 'legal' ELSE domain END AS domain, CASE WHEN doc_id % 9 = 5 THEN 'web' ELSE source END AS source,
  CASE WHEN doc_id % 9 = 6 THEN 'dev' ELSE split END AS split, CASE WHEN doc_id % 9 = 7 THEN true ELSE is_hard_negative END AS is_hard_negative, CASE WHEN doc_id % 9 = 8 THEN '' ELSE rationale END AS rationale FROM dataset),
v AS (SELECT doc_id, list_sort(list_filter([
  CASE WHEN NOT regexp_full_match(id, '(train|validation|test)-[0-9]{{5}}') THEN 'id' END,
  CASE WHEN len(list_filter(labels, lambda x: NOT list_contains(['{"', '".join(LABELS)}'], x))) > 0 THEN 'labels' END,
  CASE WHEN risk NOT IN ('LOW', 'MEDIUM', 'HIGH') THEN 'risk' END, CASE WHEN text = '' THEN 'text' END,
  CASE WHEN domain = 'legal' THEN 'domain' END, CASE WHEN source = 'web' THEN 'source' END, CASE WHEN split = 'dev' THEN 'split' END,
  CASE WHEN len(labels) = 0 AND risk <> 'LOW' THEN 'unlabelled_risk' END, CASE WHEN risk = 'LOW' AND rationale <> '' THEN 'low_rationale' END,
  CASE WHEN risk IN ('MEDIUM', 'HIGH') AND rationale = '' THEN 'risk_rationale' END,
  CASE WHEN is_hard_negative AND NOT (len(labels) = 0 AND risk = 'LOW' AND rationale = '' AND source = 'hard-negative') THEN 'hard_negative' END], lambda x: x IS NOT NULL)) AS v FROM c)
SELECT doc_id, array_to_string(v, ',') AS violations FROM v WHERE len(v) > 0"""
)
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 9
    d = dataset(spark, sf_dir)
    bad = {"id": "train-1", "risk": "SEVERE", "text": "", "domain": "legal", "source": "web", "split": "dev", "rationale": ""}
    at = {"id": 0, "risk": 2, "text": 3, "domain": 4, "source": 5, "split": 6, "rationale": 8}
    d = d.withColumns({c: F.when(k == at[c], F.lit(v)).otherwise(F.col(c)) for c, v in bad.items()} | {"labels": F.when(k == 1, F.array(F.lit("PHONE"))).otherwise(F.col("labels")), "is_hard_negative": F.when(k == 7, True).otherwise(F.col("is_hard_negative"))})
    return d.select("doc_id", F.array_join(violations(), ",").alias("violations")).where("violations <> ''")


# --- JSON, prompts, hooks --------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output: predictions as JSON, damaged in ten ways."""
    jsonx.configure(spark)
    j = F.to_json(F.struct("labels", "risk", "rationale"))
    k = F.col("doc_id") % 10
    fenced = F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```\nDone."))
    raw = (
        F.when(k == 0, j).when(k == 1, fenced).when(k == 2, F.concat(F.lit("The result is "), j, F.lit(" as asked.")))
        .when(k == 3, F.regexp_replace(j, r"\}$", ",}")).when(k == 4, F.replace(j, F.lit('"'), F.lit("'"))).when(k == 5, F.regexp_replace(j, r"\}$", ""))
        .when(k == 6, F.lit("no answer")).when(k == 7, F.concat(F.lit("[1] "), F.lit("{}"))).when(k == 8, F.regexp_replace(j, '"risk":"[A-Z]+"', '"risk":"SEVERE"')).otherwise(F.regexp_replace(j, r'"labels":\[', '"labels":["PHONE",7,'))
    )
    return predictions(spark, sf_dir).withColumn("raw", F.when((k == 9) & (F.size("labels") == 0), j).otherwise(raw))


@query(
    f"""{SQL_PAIRS} SELECT doc_id, CASE WHEN doc_id % 10 IN (6, 7) THEN '' ELSE array_to_string(labels, ',') END AS labels,
  CASE WHEN doc_id % 10 IN (6, 7, 8) THEN 'LOW' WHEN len(labels) = 0 THEN 'LOW' ELSE risk END AS risk,
  CASE WHEN doc_id % 10 IN (6, 7, 8) OR risk = 'LOW' THEN '' ELSE rationale END AS rationale, true AS is_valid FROM preds_a"""
)
def parse_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _raw(spark, sf_dir).select("doc_id", jsonx.parse_output(F.col("raw")).alias("p"))
    return p.select("doc_id", F.array_join("p.labels", ",").alias("labels"), "p.risk", "p.rationale", "p.is_valid")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[' || doc_id || ']' WHEN 1 THEN '[' || doc_id || ',2]' ELSE 'see ```[1]``` here' END AS inner_text FROM documents")
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n["), d, F.lit("]\n```"))).when(k == 1, F.concat(F.lit(" ```\n["), d, F.lit(",2]\n``` "))).otherwise(F.lit("see ```[1]``` here"))
    return table(spark, sf_dir, "documents").select("doc_id", jsonx.strip_code_fences(raw).alias("inner_text"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[' || doc_id || ']' WHEN 1 THEN '[\"z\"]' END AS first_list FROM documents")
def first_array_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("["), d, F.lit("]"))).when(k == 1, F.lit('{"n":1,"z":["z"],"a":[1]}')).otherwise(F.lit('{"n":{"z":[1]}}'))
    return table(spark, sf_dir, "documents").select("doc_id", jsonx.first_array(raw).alias("first_list"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    role = F.create_map(F.lit("user"), F.lit(hook.HOOKS[0]), F.lit("system"), F.lit(hook.HOOKS[1]), F.lit("assistant"), F.lit(hook.HOOKS[2]))
    payload = F.when(F.col("turn") % 7 == 6, F.lit("{broken")).when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("query")))).when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("tool_input")))).otherwise(F.to_json(F.struct(F.col("text").alias("tool_output"))))
    return c.select("conv_id", "turn", role[F.col("role")].alias("hook_type"), payload.alias("payload"))


_CRED = PATTERNS["has_credential_pattern"]


@query("SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN NULL ELSE text END AS text FROM conversations")
def hook_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("conv_id", "turn", hook.hook_text(F.col("hook_type"), F.col("payload")).alias("text"))


@query(
    f"""SELECT conv_id, turn, CAST(CASE WHEN turn % 7 = 6 THEN 1 WHEN regexp_matches(text, '{_CRED}') THEN 2 ELSE 0 END AS INTEGER) AS exit_code,
  CASE WHEN turn % 7 = 6 THEN 'invalid JSON' WHEN regexp_matches(text, '{_CRED}') THEN '{{"labels":["CREDENTIAL"],"risk":"HIGH","rationale":"PII type detected: CREDENTIAL"}}' ELSE '' END AS message FROM conversations"""
)
def hook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hook.scan(_events(spark, sf_dir)).select("conv_id", "turn", "exit_code", "message")


_BEFORE, _AFTER = prompts.BEFORE, prompts.AFTER
_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


@query(
    f"""{SQL_EXAMPLES}, t AS (SELECT doc_id, '{_BEFORE}' || text || '{_AFTER}' || '{{"labels":[' || array_to_string(list_transform(labels, lambda x: '"' || x || '"'), ',') || '],"risk":"' || risk || '","rationale":"' || rationale || '"}}' || '{prompts.COMPLETION_END}' AS s FROM examples),
n AS (SELECT *, CAST(len({_WORDS.format("s")}) AS BIGINT) AS n_tokens FROM t) SELECT doc_id, md5(s) AS text_md5, n_tokens FROM n WHERE n_tokens <= 1024"""
)
def format_training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.training_text(examples(spark, sf_dir)).select("doc_id", F.md5(F.col("training_text").cast("binary")).alias("text_md5"), "n_tokens")


@query(
    f"""WITH f AS (SELECT len({_WORDS.format(f"'{_BEFORE}{_AFTER}'")}) AS n), t AS (SELECT doc_id, '{_BEFORE}' || array_to_string(({_WORDS.format("text")})[1:1024 - n], ' ') || '{_AFTER}' AS s FROM documents, f)
SELECT doc_id, md5(array_to_string(({_WORDS.format("s")})[1:1024], ' ')) AS tokens_md5, CAST(len(({_WORDS.format("s")})[1:1024]) AS BIGINT) AS n_tokens FROM t"""
)
def prompt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", prompts.assembled(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"), F.size("t").cast("bigint").alias("n_tokens"))


# --- generation ------------------------------------------------------------------------------------------------

_FILES = [
    ("medical", [("I see a {SPECIALTY} doctor at {HOSPITAL} on {DAY_OF_WEEK}s", ["MEDICAL-CONTEXT", "ROUTINE"], "MEDIUM", "Treatment at a named place"), ("{MEDICATION} for my {CONDITION} since {MONTH}", ["MEDICAL-CONTEXT"], "MEDIUM", "Condition and drug")]),
    ("personal", [("I am {AGE}, {ETHNICITY} and live in {CITY}", ["DEMOGRAPHIC", "LOCATION"], "HIGH", "Age, origin and place"), ("my hint is {PASSWORD_HINT}", ["CREDENTIAL"], "LOW", ""), ("{DEVICE_MODEL} with serial {DEVICE_ID}", ["DEVICE-ID"], "MEDIUM", "A device number")]),
    ("scheduling", [("I take {BUS_ROUTE} at {TIME} {FREQUENCY}", ["ROUTINE", "LOCATION"], "MEDIUM", "A route and a time")]),
    ("workplace", [("{JOB_TITLE} on the {FLOOR} floor at {COMPANY}", ["WORKPLACE"], "MEDIUM", "Post and employer"), ("the only {JOB_TITLE} in {DEPARTMENT} at {BUILDING}", ["WORKPLACE", "QUASI-ID"], "HIGH", "One of a kind")]),
]


def _templates(spark: SparkSession) -> DataFrame:
    return template_table(spark, [(d, {"domain": d, "patterns": [{"text": t, "labels": ls, "risk": r, "rationale_template": w} for t, ls, r, w in ps]}) for d, ps in _FILES])


def _fill_sql(template: str, seed: str) -> str:
    """SQL that fills one template for row i."""
    parts, place = [], 0
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            slot = piece[1:-1]
            draw = f"(CAST(('0x' || substr(md5('{seed}:' || i || ':{place}:{slot}'), 1, 7)) AS BIGINT)"
            if slot in templates.NUMBERS:
                lo, hi = templates.NUMBERS[slot]
                n = f"({draw} % {hi - lo + 1}) + {lo})"
                parts.append(f"(CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN {n} || 'th' WHEN {n} % 10 = 1 THEN {n} || 'st' WHEN {n} % 10 = 2 THEN {n} || 'nd' WHEN {n} % 10 = 3 THEN {n} || 'rd' ELSE {n} || 'th' END)" if slot == "FLOOR" else f"CAST({n} AS VARCHAR)")
            else:
                values = templates.VALUES[slot]
                parts.append("([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[{draw} % {len(values)}) + 1]")
            place += 1
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts) or "''"


def _template_sql(count: int) -> str:
    rows = []
    for d, (domain, ps) in enumerate(_FILES):
        for k, (t, ls, r, w) in enumerate(ps):
            rows.append(f"SELECT i AS row, {_fill_sql(t, '11')} AS text, '{','.join(sorted(ls))}' AS labels, '{r}' AS risk, '{'' if r == 'LOW' else w}' AS rationale, '{domain}' AS domain FROM range({count}) t(i) WHERE i % {len(_FILES)} = {d} AND (i // {len(_FILES)}) % {len(ps)} = {k}")
    return " UNION ALL ".join(rows)


@query(_template_sql(500))
def template_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.generate(spark, _templates(spark), 500, 11).select("row", "text", joined("labels").alias("labels"), "risk", "rationale", "domain")


def _filled_sql(seed: str) -> str:
    rows = []
    for d, (domain, ps) in enumerate(_FILES):
        for k, (t, ls, r, w) in enumerate(ps):
            why = "''" if r == "LOW" else _fill_sql(w, f"{seed}-r")
            rows.append(f"SELECT i AS doc_id, {_fill_sql(t, seed)} AS text, '{','.join(sorted(ls))}' AS labels, '{r}' AS risk, {why} AS rationale, '{domain}' AS domain FROM (SELECT doc_id AS i FROM documents WHERE doc_id >= 0) WHERE i % {len(_FILES)} = {d} AND (i // {len(_FILES)}) % {len(ps)} = {k}")
    return " UNION ALL ".join(rows)


@query(_filled_sql("doc"))
def template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invented text for each document: pattern and values of slots follow from its id."""
    rows = table(spark, sf_dir, "documents").where("doc_id >= 0").select(F.col("doc_id").alias("row"))
    out = templates.filled(rows, _templates(spark), "doc")
    return out.select(F.col("row").alias("doc_id"), "text", joined("labels").alias("labels"), "risk", "rationale", "domain")


@query(f"SELECT label, count(*) AS documents FROM (SELECT unnest(string_split(labels, ',')) AS label FROM ({_filled_sql('doc')})) GROUP BY label")
def template_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of these texts have each label."""
    return template_documents(spark, sf_dir).select(F.explode(F.split("labels", ",")).alias("label")).groupBy("label").agg(F.count("*").alias("documents"))


_SUPPORT = {x: sum(x in ls for _, ps in _FILES for _, ls, _, _ in ps) for x in LABELS}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x}', CAST({n} AS BIGINT))" for x, n in _SUPPORT.items() if n) + ") t(label, patterns)")
def template_label_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_support(_templates(spark))


@query("""SELECT doc_id AS total, doc_id % 97 AS have, goal AS target_non_hn, remaining, template_count, remaining - template_count AS llm_count FROM (
  SELECT *, CAST(round_even(remaining * 0.5, 0) AS BIGINT) AS template_count FROM (SELECT *, greatest(0, goal - doc_id % 97) AS remaining FROM (SELECT doc_id, CAST(round_even(doc_id * (1 - 0.1), 0) AS BIGINT) AS goal FROM documents)))""")
def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("total"), (F.col("doc_id") % 97).alias("have"))
    return d.select("*", *[c.alias(n) for n, c in scalars.generation_plan(F.col("total"), F.col("have"), F.lit(0.5), F.lit(0.1)).items()])


@query(
    "SELECT model, CAST(greatest(10, b // 75) AS BIGINT) AS structured, CAST(greatest(10, b // 30) AS BIGINT) AS simple, CAST(greatest(10, b // 80) AS BIGINT) AS validation FROM (VALUES "
    + ", ".join(f"('{m}', {b})" for m, b in [*scalars.TOKEN_BUDGETS.items(), ("another", scalars.DEFAULT_BUDGET)])
    + ") t(model, b)"
)
def batch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(m,) for m in [*scalars.TOKEN_BUDGETS, "another"]], "model string")
    return names.select("model", *[scalars.batch_limit(F.col("model"), k).alias(k) for k in scalars.TOKENS_PER_EXAMPLE])


@query(
    f"""{SQL_EXAMPLES} SELECT doc_id, array_to_string(labels, ',') AS labels, risk, rationale, CASE WHEN doc_id % 7 = 6 THEN 'medical' ELSE domain END AS domain FROM examples
WHERE doc_id % 7 IN (0, 6) AND text <> ''"""
)
def llm_response_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by doc_id % 7: sound, a string, empty text, no labels, an unknown label, a broken rule, no domain."""
    e, k = examples(spark, sf_dir), F.col("doc_id") % 7
    parts = lambda *drop: [F.col(c) for c in ("text", "labels", "risk", "rationale", "domain") if c not in drop]
    entry = (
        F.when(k == 0, F.to_json(F.struct(*parts()))).when(k == 1, F.lit('"text"')).when(k == 2, F.to_json(F.struct(F.lit("").alias("text"), *parts("text")))).when(k == 3, F.to_json(F.struct(*parts("labels"))))
        .when(k == 4, F.to_json(F.struct(F.array(F.lit("PHONE")).alias("labels"), *parts("labels")))).when(k == 5, F.to_json(F.struct(F.lit("HIGH").alias("risk"), F.lit("").alias("rationale"), *parts("risk", "rationale")))).otherwise(F.to_json(F.struct(*parts("domain"))))
    )
    return validation.generated_examples(e.select("doc_id", entry.alias("entry"))).select("doc_id", joined("labels").alias("labels"), "risk", "rationale", "domain")


@query("SELECT doc_id, text FROM documents WHERE doc_id % 4 > 1 AND trim(text) <> ''")
def hn_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    return validation.usable_texts(table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "").when(k == 1, " \n\t").otherwise(F.col("text")).alias("text")))


# --- TF-IDF and the baseline -----------------------------------------------------------------------------------

_VOCAB_SQL = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
top AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000),
vocab AS (SELECT term, total, df, ln((1 + n) / (1 + df)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS ord FROM top, n)"""


@query(f"{_VOCAB_SQL} SELECT term, total, df, round(idf, 6) AS idf, ord FROM vocab")
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.fit(table(spark, sf_dir, "documents"), "doc_id")[1].withColumns(six("idf"))


@query(
    f"""{_VOCAB_SQL}, w AS (SELECT doc_id, term, ord, tf * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, ord, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""
)
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, vocab = tfidf.fit(table(spark, sf_dir, "documents"), "doc_id")
    return tfidf.weights(parts, vocab, "doc_id").withColumns(six("weight"))


_DENSE_SQL = {
    **_FLAGS_SQL,
    "token_count": "token_count",
    "sentence_count": "sentence_count",
    "avg_sentence_length": "token_count / sentence_count",
    **{f"ent_{e}": "0" for e in ENTITIES},
}


@query(
    f"""{_VOCAB_SQL}, w AS (SELECT doc_id, term, ord, tf * idf AS w FROM tf JOIN vocab USING (term)),
counts AS (SELECT *, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS token_count,
  CAST(greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '\\S')))) AS BIGINT) AS sentence_count FROM documents),
own AS ({" UNION ALL ".join(f"SELECT doc_id, (SELECT count(*) FROM vocab) + {i} AS feature, CAST({_DENSE_SQL[n]} AS DOUBLE) AS value FROM counts" for i, n in enumerate(FEATURE_ORDER))})
SELECT doc_id, CAST(feature AS BIGINT) AS feature, round(value, 6) AS value FROM (
  SELECT doc_id, ord AS feature, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM w UNION ALL SELECT * FROM own) WHERE value > 0"""
)
def baseline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the baseline learns from: TF-IDF of the vocabulary, then the features of a text, where they are above 0."""
    docs = table(spark, sf_dir, "documents")
    vocab = tfidf.fit(docs, "doc_id")[1].orderBy("ord").collect()  # as many rows as the vocabulary has room for
    rows = baseline.Baseline([(r["term"], r["idf"]) for r in vocab]).featurize(docs, "doc_id").select("doc_id", F.unwrap_udt("features").alias("v"))
    places = F.when(F.col("v.type") == 0, F.col("v.indices")).otherwise(F.sequence(F.lit(0), F.greatest(F.size("v.values") - 1, F.lit(0))))
    pairs = rows.select("doc_id", F.explode(F.arrays_zip(places.alias("f"), F.col("v.values").alias("x"))).alias("p"))
    return pairs.where("p.x > 0").select("doc_id", F.col("p.f").cast("bigint").alias("feature"), F.round("p.x", 6).alias("value"))


@query()
def baseline_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = with_splits(spark, sf_dir)
    model = baseline.train(data.where("split = 'train'"), "doc_id")
    return model.predict(data.where("split = 'test'"), "doc_id").select("doc_id", joined("labels").alias("labels"), "risk", "rationale")


@query()
def recognised_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of documents with the counts of a recogniser that has learned from the shipped templates."""
    rows = spark.range(2000).select(F.col("id").alias("row"))
    find = recogniser.train(recogniser.examples(rows, shipped_templates(spark), 7)).found(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", find("text"))
    made = features(F.col("text"), recogniser.entity_counts(F.col("spans")))
    return docs.select("doc_id", *[made[f"ent_{e}"].alias(f"ent_{e}") for e in ENTITIES])


# --- quotas and training tables --------------------------------------------------------------------------------

_QUOTA_SQL = """g AS (SELECT coalesce(source, '') AS "group", CAST(1 + length(coalesce(source, '')) % 4 AS HUGEINT) AS weight, CAST(count(*) AS HUGEINT) AS cap FROM documents GROUP BY ALL),
goal AS (SELECT CAST(sum(cap) AS HUGEINT) * 2 // 5 AS goal FROM g),
a AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM g, goal WINDOW o AS (ORDER BY cap / weight, "group")),
b AS (SELECT *, (goal - before_) * weight >= cap * weights AS full_ FROM a),
c AS (SELECT *, CAST(goal - coalesce(sum(cap) FILTER (full_) OVER (), 0) AS HUGEINT) AS rest, CAST(greatest(1, coalesce(sum(weight) FILTER (NOT full_) OVER (), 0)) AS HUGEINT) AS open_ FROM b),
d AS (SELECT *, CASE WHEN full_ THEN cap ELSE rest * weight // open_ END AS low, CASE WHEN full_ THEN -1 ELSE rest * weight % open_ END AS part FROM c),
quotas AS (SELECT "group", weight, cap, CAST(low + CASE WHEN NOT full_ AND row_number() OVER (ORDER BY part DESC, "group") <= goal - sum(low) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM d)"""


def _quotas(docs: DataFrame) -> DataFrame:
    groups = docs.groupBy(F.coalesce("source", F.lit("")).alias("group")).agg((1 + F.length("group") % 4).cast("bigint").alias("weight"), F.count("*").alias("cap"))
    return apportion(groups, docs.count() * 2 // 5)


@query(f'WITH {_QUOTA_SQL} SELECT "group", CAST(weight AS BIGINT) AS weight, CAST(cap AS BIGINT) AS cap, quota FROM quotas')
def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fifths of all documents, shared out among the sources by weight, none beyond what it has."""
    return _quotas(table(spark, sf_dir, "documents"))


@query(
    f"""WITH {_QUOTA_SQL}, r AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('quota:' || doc_id), doc_id) AS position FROM documents)
SELECT doc_id, source, position FROM r JOIN quotas ON source = "group" WHERE position <= quota"""
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quotas take, in hash order."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), seeded("quota", "doc_id").alias("_h"))
    return first_of(rows, "source", "_h", ["doc_id"], _quotas(docs)).select("doc_id", "source", F.col("position").cast("bigint").alias("position"))


_TRAINING_SQL = f"""t AS (SELECT id, '{BEFORE}' || text || '{AFTER}' || '{{"labels":[' || array_to_string(list_transform(labels, lambda x: '"' || x || '"'), ',') || '],"risk":"' || risk || '","rationale":"' || rationale || '"}}{COMPLETION_END}' AS training_text
  FROM dataset WHERE split = 'train'), n AS (SELECT *, CAST(len(list_filter(string_split_regex(training_text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM t)"""


@query(f"{_SPLIT_SQL}, {_TRAINING_SQL} SELECT id, md5(training_text) AS text_md5, n_tokens, (SELECT count(*) FROM n WHERE n_tokens <= {MAX_TOKENS}) AS kept, (SELECT count(*) FROM n WHERE n_tokens > {MAX_TOKENS}) AS skipped, row_number() OVER (ORDER BY md5('3:' || id)) AS place FROM n WHERE n_tokens <= {MAX_TOKENS}")
def prepare_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table of a written dataset: what it holds, what was left out, and the place of each row in the order of its files."""
    folder = new_folder(spark)
    write_dataset(dataset(spark, sf_dir), folder)
    rows, counts = prepare_dataset(spark, folder, new_folder(spark), seed=3, text=False)
    placed = file_places(rows)
    return placed.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_tokens", *[F.lit(counts[k]).cast("bigint").alias(k) for k in ("kept", "skipped")], (F.col("place") + 1).alias("place"))


@query()
def subword_prompts(spark: SparkSession, sf_dir: str, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """Prompts cut at the limit in subwords of a public vocabulary, whether the text comes back from its subwords, and how many it has."""
    return counted(table(spark, sf_dir, "documents"), "doc_id", tokenizer)


@query(f"{_SPLIT_SQL} SELECT id, md5(text) AS text_md5, array_to_string(labels, ',') AS labels, risk, rationale, is_hard_negative, split, domain, source FROM dataset")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_dataset(dataset(spark, sf_dir), path)
    # documents without a text come back like others
    out = read_dataset(spark, path, text=False)
    return out.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), joined("labels").alias("labels"), "risk", "rationale", "is_hard_negative", "split", "domain", "source")


@query(ORACLE_SQL["evaluation_report"])
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_report(metrics.evaluation_report(pairs(spark, sf_dir), "a"), path)
    out = read_report(spark, path).withColumn("violations", F.array_join(report_violations(), ","))
    return out.drop("f1_by_label").withColumns(six(*_REPORT))


@query(f"SELECT count(*) FILTER (passed) AS passed, count(*) AS targets FROM ({ORACLE_SQL['targets_check']})")
def targets_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.count_passed(metrics.check_targets(metrics.evaluation_report(pairs(spark, sf_dir), "a")))


@query("SELECT doc_id, array_to_string(regexp_extract_all('{A' || doc_id % 5 || '} ' || coalesce(text, '') || ' {B_1} {A0} { C} {}', '\\{(\\w+)\\}', 1), ',') AS slots FROM documents")
def template_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.concat(F.lit("{A"), F.col("doc_id") % 5, F.lit("} "), F.coalesce("text", F.lit("")), F.lit(" {B_1} {A0} { C} {}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(templates.placeholders(pattern), ",").alias("slots"))


@query(f"""{SQL_EXAMPLES} SELECT risk, domain, array_to_string(list_sort(list_filter([{", ".join(f"'{x}'" for x in LABELS)}], lambda x: NOT list_contains(flatten(list(labels)), x))), ',') AS missing
FROM examples GROUP BY risk, domain""")
def missing_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_labels(examples(spark, sf_dir), LABELS, "risk", "domain").withColumn("missing", joined("missing"))
