"""Evaluation reports as JSON files, and configurations as YAML."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

REPORT = (
    "model_name string, test_set_size bigint, multilabel_f1 double, f1_by_label map<string,double>, risk_accuracy double, "
    "false_negative_rate double, quasi_id_f1 double, hard_negative_precision double, gate_accuracy double"
)


def write_report(report: DataFrame, path: str) -> None:
    """Reports, a JSON object for each, replacing what is at the path."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports as they were written; a file that isn't one fails."""
    return spark.read.schema(REPORT).option("mode", "FAILFAST").json(path)


def load_config(spark: SparkSession, path: str) -> dict:
    """The mapping of a YAML file under any path that Spark can read; FileNotFoundError where there is none, ValueError for anything else."""
    import yaml

    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    found = yaml.safe_load(text[0]) if text else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found
