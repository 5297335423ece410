"""A detector: a saved predictor behind one interface, for rows and for single texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.scalars import hub_id
from larkspan.operators import baseline
from larkspan.sources.cluster import exists


@dataclass(frozen=True)
class Detection:
    labels: frozenset
    risk: str
    rationale: str


class Detector:
    """Loaded on the driver once; executors get the model with the first job, by broadcast, and keep it for the others."""

    def __init__(self, model: baseline.Baseline):
        self.model = model

    @classmethod
    def from_pretrained(cls, spark: SparkSession, path: str) -> Detector:
        """The model that `baseline.save` has written under a path. A name of a model hub isn't a path: ValueError; FileNotFoundError where nothing is."""
        if not exists(spark, path):
            if hub_id(path):
                raise ValueError(f"{path} is a name on a model hub, from which nothing is fetched")
            raise FileNotFoundError(path)
        return cls(baseline.load(path))

    def detect(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows with labels, risk and rationale, which replace columns of these names. Null and empty texts hold nothing, and no model sees them."""
        columns = [c for c in rows.columns if c.lower() not in ("labels", "risk", "rationale")]
        rows = rows.select(*[F.col(f"`{c}`") for c in columns])
        has = F.coalesce(F.col(text), F.lit("")) != ""
        # the predictor reads the column text; its own columns are numbered, whatever those of the rows are called
        inner = rows.where(has).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"), F.col(text).alias("text"))
        found = self.model.predict(inner, "_all").select("_all.*", "labels", "risk", "rationale")
        none = rows.where(~has).select("*", F.array().cast("array<string>").alias("labels"), F.lit("LOW").alias("risk"), F.lit("").alias("rationale"))
        return found.unionByName(none)

    def predict(self, text: str) -> Detection:
        """One text; an empty one is refused. For many, `detect` is a single job."""
        if not text:
            raise ValueError("an empty text can't be looked at")
        spark = SparkSession.getActiveSession()
        r = self.detect(spark.createDataFrame([(text,)], "text string")).first()
        return Detection(frozenset(r["labels"]), r["risk"], r["rationale"])
