"""Lists of a large group share a hub: what its classes belong to is looked up once for each, and open lists are those by the definition."""

from larkspan.llm import jaccard_join


def test_open_lists(spark, monkeypatch):
    # six lists of one group, in one of them a stray, and a list of strays of one component
    rows = [(h, sid, 10, 10, 1) for h in range(6) for sid in range(2, 40)] + [(0, 77, 10, 10, 1), (9, 77, 10, 10, 5), (9, 78, 10, 10, 5)]
    lists = spark.createDataFrame(rows, "h long, sid long, n long, most long, hub long")
    roots = spark.createDataFrame([*[(k, 1) for k in range(1, 40)], (77, 77), (78, 77)], "node long, component long")
    facts = spark.createDataFrame([(k, [k]) for k in [*range(1, 40), 77, 78]], "sid long, bits array<long>")
    made = {}
    durable = jaccard_join.durable

    def counted(df, *a):
        out = durable(df, *a)
        made[tuple(sorted(df.columns))] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "durable", counted)
    held = jaccard_join.still_open(lists, roots, facts).collect()
    assert sorted((r["h"], r["sid"], r["root"], r["home"]) for r in held) == sorted([(0, k, 1, True) for k in range(2, 40)] + [(0, 77, 77, False)])
    assert made["home", "hub", "root", "sid"] == 38 + 3
