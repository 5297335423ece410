"""Components of edges that one task may hold need no shuffle; of more, stars give the same. Sizes in classes meet from either side."""

import random

import pytest
from pyspark.sql import functions as F

from larkspan.llm import chosen_path, graph, jaccard_join


def expected(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("most", [graph.EDGES, 3])
def test_components_of_few_and_many(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "EDGES", most)
    pick = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(900 - k, 901 - k) for k in range(30)] + [(pick.randrange(1000, 1200), pick.randrange(1000, 1200)) for _ in range(150)]
    edges = [e for e in edges if e[0] != e[1]]
    rows = []
    durable = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: rows.append("Exchange" in df._jdf.queryExecution().executedPlan().toString()) or durable(df))
    got = graph.components(spark.createDataFrame([*edges, *edges[::-1], (5, 5)], "a long, b long").repartition(3))
    assert {r["node"]: r["component"] for r in got.collect()} == expected(edges)
    # the first one reads what the test has dealt; before, each round had six shuffles
    assert most == 3 or not any(rows[1:])


def test_sizes_meet_from_either_side(spark):
    rows = [(1, k, n, 1000, k, [0], k, k % 2 == 0) for k, n in enumerate([10, 11, 12, 13, 15, 16, 20, 25, 30, 31])]
    held = spark.createDataFrame(rows, "h long, sid long, n long, most long, root long, bits array<long>, th long, home boolean")
    found = [{tuple(r) for r in jaccard_join.apart(held, held, F.lit(True), 80, few=few).collect()} for few in (False, True)]
    assert found[0] == found[1] == {(a, b, a, b) for _, a, n, *_ in rows for _, b, m, *_ in rows if a < b and 100 * min(n, m) >= 80 * max(n, m)}


def test_filters_in_one_pass(spark):
    nodes = spark.createDataFrame([(k * 977, k) for k in range(-50, 50)], "h long, n long")
    every, some = chosen_path.filters_of(nodes, F.lit(True), F.col("n") > 20)
    h = [k * 977 for k in range(-50, 50)]
    import numpy as np

    bits = lambda w: chosen_path.bit(w, np.array(h, np.int64).view(np.uint64)).tolist()
    assert all(bits(every)) and bits(some) == [k > 20 for k in range(-50, 50)]
