"""Subword counts of prompts take one Python evaluation, and agree with the functions of a column that take several."""

import pytest
from pyspark.sql import functions as F

from larkspan.functions import prompts
from larkspan.functions.subwords import counted, subwords
from larkspan.plans import registry

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.parametrize("limit", [5, 100, 1024])
def test_counts_are_those_of_assembled_prompts(spark, limit):
    texts = ["", None, "plain words", "two  blanks\n\ttab", "Grüße, 東京 \U0001f600 " * 300, "<|endoftext|> inside", "word " * 3000, "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    encode, decode = subwords(spark, VOCABULARY)
    t = F.coalesce("text", F.lit(""))
    want = d.select("i", F.size(encode(t)), decode(encode(t)) == t, F.size(prompts.assembled(t, encode, decode, limit)))
    assert sorted(map(tuple, counted(d, "i", VOCABULARY, limit).collect())) == sorted(map(tuple, want.collect()))


def test_the_query_has_one_worker_in_a_task(spark, sf_dir):
    plan = registry.QUERIES["subword_prompts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
