"""Splits of more than 99,999 rows, whose ids have six digits."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions.schema import CORRECTION, EXAMPLE
from larkspan.operators import datasets, training, validation
from larkspan.sources import dataset_io

IDS = ("train-00007", "train-99999", "train-100000", "train-1234567")


def rows(spark, source="template", ids=IDS):
    return spark.createDataFrame([(i, f"text {i}", ["ROUTINE"], "HIGH", "why", False, "train", "personal", source) for i in ids], EXAMPLE)


def test_datasets_come_back(spark, tmp_path):
    dataset_io.write_dataset(rows(spark), str(tmp_path / "d"))
    assert {r["id"] for r in dataset_io.read_dataset(spark, str(tmp_path / "d")).collect()} == set(IDS)
    for bad in ("train-012345", "train-1234", "dev-00001"):
        dataset_io.write_dataset(rows(spark, ids=[bad]), str(tmp_path / "b"))
        with pytest.raises(Exception, match="invalid example"):
            dataset_io.read_dataset(spark, str(tmp_path / "b")).collect()


def test_training_tables_have_them(spark, tmp_path):
    dataset_io.write_dataset(rows(spark), str(tmp_path / "d"))
    table, counts = training.prepare_dataset(spark, str(tmp_path / "d"), str(tmp_path / "t"))
    assert counts == {"kept": 4, "skipped": 0} and {r["id"] for r in table.collect()} == set(IDS)


def test_corrections_break_no_rule(spark):
    c = spark.createDataFrame([(i, None, "MEDIUM", None, None, None, 1) for i in IDS], T.StructType([*CORRECTION.fields, T.StructField("ord", T.IntegerType())]))
    assert [(r["risk"], r["violations"]) for r in datasets.apply_corrections(rows(spark), c).collect()] == [("MEDIUM", [])] * 4


@pytest.mark.parametrize("prefix", ["", "x"])
def test_validated_by_id_and_by_place(spark, prefix):
    d = rows(spark, "llm-augmented").withColumns({"batch": F.lit(0), "place": F.array_position(F.array(*[F.lit(i) for i in IDS]), F.col("id")).cast("int") - 1})
    r = spark.createDataFrame([(0, json.dumps([{"id": prefix + i, "labels": ["ROUTINE"]} for i in IDS]))], "batch int, response string")
    assert {x["id"] for x in validation.match(d, r).collect()} == set(IDS)
