"""Scoring hands workers that look n-grams up a filter, not the tree, and arrays in batches of bounded bytes; answers are the same in small pieces."""

import numpy as np
from pyspark.sql import functions as F

from larkspan.llm import lm_scoring

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_lookups_hold_little(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[(F.col("id") * k % 5).cast("string") for k in range(1, 9)]).alias("text"))
    before = spark.conf.get(NAME, None)
    # nothing is in the head but in the tables
    monkeypatch.setattr(lm_scoring, "HEAD", 2.0)
    rows = lambda: sorted((r["doc_id"], round(r["score"], 9)) for r in lm_scoring.score_documents(docs).collect())
    whole = rows()
    seen, looked_up = [], lm_scoring.looked_up

    def noted(texts, tail, *rest):
        seen.append((type(tail.value), tail.value.nbytes, spark.conf.get(NAME)))
        return looked_up(texts, tail, *rest)

    monkeypatch.setattr(lm_scoring, "looked_up", noted)
    monkeypatch.setattr(lm_scoring, "BATCH", 64)
    assert rows() == whole
    assert seen == [(np.ndarray, 8 * lm_scoring.SLOTS, str(8 << 20))]
    assert spark.conf.get(NAME, None) == before
