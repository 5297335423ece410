"""Sharding along an order: places in files, no shuffle of texts, also where names repeat in folders and rows are left out."""

from pyspark.sql import functions as F

from larkspan.llm import sharding


def test_shards_in_order_leave_texts_where_they_are(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("text"), F.lit(1).alias("_at"))
    for k in (0, 1):
        docs.where(F.col("doc_id") % 2 == k).repartitionByRange(3, "doc_id").write.parquet(str(tmp_path / f"t/k={k}"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.read.parquet(str(tmp_path / "t"))
        out = sharding.shard_in_order(rows, 5)
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        for some in (rows, rows.where("doc_id % 3 <> 0")):
            got = sharding.shard_in_order(some, 5)
            assert got.columns == [*some.columns, "shard", "slot"] and got.count() == some.count()
            found = got.orderBy("shard", "slot").collect()
            for k in range(5):
                assert [r["slot"] for r in found if r["shard"] == k] == list(range(sum(r["shard"] == k for r in found)))
            sizes = [sum(len(r["text"]) + sharding.OVERHEAD for r in found if r["shard"] == k) for k in range(5)]
            assert max(sizes) - min(sizes) < 50
            if some is rows:  # the folder's own order within files of one name
                assert all(a["doc_id"] < b["doc_id"] for a, b in zip(found, found[1:], strict=False) if a["k"] == b["k"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
