"""Rows without a text: who leaves texts as they are keeps such rows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions.schema import CORRECTION, EXAMPLE
from larkspan.operators import datasets, training, validation
from larkspan.plans import registry
from larkspan.sources import dataset_io

TEXTS = {"train-00001": "", "train-00002": None, "train-00003": "a b"}


def rows(spark):
    return spark.createDataFrame([(i, t, ["ROUTINE"], "HIGH", "why", False, "train", "personal", "llm-augmented") for i, t in TEXTS.items()], EXAMPLE)


def test_datasets_come_back(spark, tmp_path):
    dataset_io.write_dataset(rows(spark), str(tmp_path / "d"))
    assert {r["id"]: r["text"] for r in dataset_io.read_dataset(spark, str(tmp_path / "d"), text=False).collect()} == TEXTS
    with pytest.raises(Exception, match="invalid example: text"):
        dataset_io.read_dataset(spark, str(tmp_path / "d")).collect()
    dataset_io.write_dataset(rows(spark).withColumn("risk", F.lit("SEVERE")), str(tmp_path / "b"))
    with pytest.raises(Exception, match="invalid example: risk"):
        dataset_io.read_dataset(spark, str(tmp_path / "b"), text=False).collect()
    table, counts = training.prepare_dataset(spark, str(tmp_path / "d"), str(tmp_path / "t"), text=False)
    # there is nothing to train on without a text
    assert counts == {"kept": 2, "skipped": 0} and {r["id"] for r in table.collect()} == {"train-00001", "train-00003"}


@pytest.mark.parametrize("prefix", ["", "x"])
def test_validated_by_id_and_by_place(spark, prefix):
    d = rows(spark).withColumns({"batch": F.lit(0), "place": F.substring("id", -1, 1).cast("int") - 1})
    r = spark.createDataFrame([(0, json.dumps([{"id": prefix + i, "labels": ["ROUTINE"]} for i in TEXTS]))], "batch int, response string")
    assert {x["id"]: x["text"] for x in validation.match(d, r).collect()} == TEXTS


def test_corrections_break_no_rule(spark):
    c = spark.createDataFrame([(i, None, "MEDIUM", None, None, None, 1) for i in TEXTS], T.StructType([*CORRECTION.fields, T.StructField("ord", T.IntegerType())]))
    assert [(r["risk"], r["violations"]) for r in datasets.apply_corrections(rows(spark), c).collect()] == [("MEDIUM", [])] * 3


def test_queries_have_all_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 3, None).otherwise(F.col("text"))).write.parquet(str(tmp_path / "documents.parquet"))
    n = {k: docs.where(k).count() for k in ("true", "doc_id % 10 <> 9")}
    assert registry.QUERIES["jsonl_roundtrip"](spark, str(tmp_path)).count() == n["true"]
    assert registry.QUERIES["validation_fallback"](spark, str(tmp_path)).count() == n["doc_id % 10 <> 9"]
