"""The event scan as a stream: a stateless map, so it needs no watermark and restarts from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larkspan.operators.hook import pattern_predictor, scan

EVENT = "hook_type string, payload string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(folder)


def scan_stream(events: DataFrame, out: str, checkpoint: str, predict: Callable[[Column], Column] = pattern_predictor, **trigger) -> StreamingQuery:
    return scan(events, predict).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
