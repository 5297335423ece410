"""Hits of benchmark seeds carry no whole documents, and windows give what whole documents give."""

from larkspan.llm import decontam
from larkspan.llm.common import scratch

LONG = [f"l{i}" for i in range(14)]
SHORT = ["s1", "s2", "s3", "s4", "s5"]


def tables(spark):
    texts = [LONG, LONG * 40, LONG[3:] + ["x"] * 5, ["x"] * 5 + LONG[:11], LONG[:6] + ["y"] + LONG[7:], SHORT, SHORT[1:], SHORT[:4], ["z", *SHORT[:2], "q", *SHORT[3:]], SHORT * 30 + LONG, ["none"], [], LONG[2:] + SHORT[1:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    return docs, spark.createDataFrame([(0, " ".join(LONG)), (1, " ".join(SHORT)), (2, " ".join(SHORT))], "item_id long, text string")


def columns(plan):
    return {a.name() for a in [plan.output().apply(i) for i in range(plan.output().size())]}


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_no_row_of_a_hit_holds_a_document(spark):
    docs, benchmark = tables(spark)
    with scratch():
        plan = decontam.hits(docs.withColumnRenamed("doc_id", "id"), benchmark)._jdf.queryExecution().optimizedPlan()
        placed = [columns(p) for p in nodes(plan) if "diagonal" in columns(p)]
    assert placed and not any("t" in c for c in placed)


def test_both_ways_agree(spark, monkeypatch):
    docs, benchmark = tables(spark)
    few = sorted(map(tuple, decontam.find_contamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert few == sorted(map(tuple, decontam.find_contamination(docs, benchmark).collect()))
    assert {(r[0], r[1]) for r in few} >= {(i, 0) for i in (0, 1, 2, 3, 4, 9, 12)} | {(i, j) for i in (5, 6, 7, 8, 9, 12) for j in (1, 2)}
