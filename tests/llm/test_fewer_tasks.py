"""Narrow tables of the join are written by fewer tasks than the shuffle has partitions, and results don't depend on it."""

from larkspan.llm import common, fingerprints, jaccard_join


def test_narrow_tables_take_few_tasks(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[: 50 - i % 3], f"x{i // 4}"]) if i % 4 else f"alone {i} " * 8) for i in range(48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    expected = sorted(map(tuple, fingerprints.near_duplicates(docs).collect()))
    assert len({c for _, c in expected}) < len(rows)
    tasks, durable = [], common.durable
    monkeypatch.setattr(jaccard_join, "durable", lambda df, *a: tasks.append(df.rdd.getNumPartitions()) or durable(df, *a))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 96)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert sorted(map(tuple, fingerprints.near_duplicates(docs).collect())) == expected
        assert len(tasks) > 5 and max(tasks) <= 12
        assert common.fewer(spark.range(9).repartition(96)).rdd.getNumPartitions() == 12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
