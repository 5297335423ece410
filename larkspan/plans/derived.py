"""Test data: labelled examples and two predictors, derived from the table documents by md5 arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.schema import DOMAINS, LABELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _h(prefix: str, k: int) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(prefix), F.lit(str(k)), F.col("doc_id").cast("string")).cast("binary")), 1, 1)


def _labels(conditions: list[Column]) -> Column:
    """Sorted labels whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in zip(conditions, LABELS, strict=True)])))


def _risk(labels: Column) -> Column:
    n = F.size(labels)
    return F.when((n == 0) | ((n == 1) & (F.col("doc_id") % 3 == 0)), "LOW").when(n <= 2, "MEDIUM").otherwise("HIGH")


def _rationale(risk: Column, labels: Column) -> Column:
    return F.when(risk == "LOW", "").otherwise(F.concat(F.lit("Detected: "), F.array_join(labels, ", ")))


def _result(df: DataFrame) -> DataFrame:
    df = df.withColumn("risk", _risk(F.col("labels")))
    return df.withColumn("rationale", _rationale(F.col("risk"), F.col("labels")))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    hn = F.col("doc_id") % 10 == 9
    source = F.when(hn, "hard-negative").when(F.col("doc_id") % 2 == 0, "template").otherwise("llm-augmented")
    domain = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.col("doc_id") % 4 + 1).cast("int"))
    base = table(spark, sf_dir, "documents").select(
        "doc_id", "text", hn.alias("is_hard_negative"), domain.alias("domain"), source.alias("source"), _labels([~hn & (_h("gt", k) < "4") for k in range(8)]).alias("labels")
    )
    return _result(base)


def predictions(spark: SparkSession, sf_dir: str, prefix: str = "pa", hit: str = "d", noise: str = "1") -> DataFrame:
    truth = examples(spark, sf_dir).select("doc_id", F.col("labels").alias("gold"))
    has = [F.array_contains("gold", x) for x in LABELS]
    return _result(truth.select("doc_id", _labels([(has[k] & (_h(prefix, k) < hit)) | (~has[k] & (_h(prefix, k) < noise)) for k in range(8)]).alias("labels")))


def preds_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir, "pb", "b", "2")


def _sql_h(prefix: str, k: int) -> str:
    return f"substr(md5('{prefix}:{k}:' || doc_id), 1, 1)"


def _sql_labels(conditions: list[str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for c, x in zip(conditions, LABELS, strict=True)) + "], lambda x: x IS NOT NULL))"


_SQL_RESULT = """*, CASE WHEN risk = 'LOW' THEN '' ELSE 'Detected: ' || array_to_string(labels, ', ') END AS rationale FROM (
  SELECT *, CASE WHEN len(labels) = 0 OR (len(labels) = 1 AND doc_id % 3 = 0) THEN 'LOW' WHEN len(labels) <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM"""

_EX = f"""examples AS (SELECT {_SQL_RESULT} (
  SELECT doc_id, text, doc_id % 10 = 9 AS is_hard_negative, (['{"', '".join(DOMAINS)}'])[doc_id % 4 + 1] AS domain,
    CASE WHEN doc_id % 10 = 9 THEN 'hard-negative' WHEN doc_id % 2 = 0 THEN 'template' ELSE 'llm-augmented' END AS source,
    {_sql_labels([f"doc_id % 10 <> 9 AND {_sql_h('gt', k)} < '4'" for k in range(8)])} AS labels
  FROM documents)))"""


def _preds(name: str, prefix: str, hit: str, noise: str) -> str:
    c = [f"CASE WHEN list_contains(gold, '{x}') THEN {_sql_h(prefix, k)} < '{hit}' ELSE {_sql_h(prefix, k)} < '{noise}' END" for k, x in enumerate(LABELS)]
    return f"{name} AS (SELECT {_SQL_RESULT} (SELECT doc_id, {_sql_labels(c)} AS labels FROM (SELECT doc_id, labels AS gold FROM examples))))"


SQL_EXAMPLES = f"WITH {_EX}"
SQL_PAIRS = f"""{SQL_EXAMPLES}, {_preds("preds_a", "pa", "d", "1")}, {_preds("preds_b", "pb", "b", "2")},
pairs AS (SELECT e.doc_id, e.labels AS gold, e.risk AS gold_risk, e.is_hard_negative, p.labels AS pred, p.risk AS pred_risk FROM examples e JOIN preds_a p USING (doc_id)),
pairs_b AS (SELECT e.doc_id, e.labels AS gold, e.risk AS gold_risk, e.is_hard_negative, p.labels AS pred, p.risk AS pred_risk FROM examples e JOIN preds_b p USING (doc_id))"""
