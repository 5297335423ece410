"""Tables that are made once: a journal under a folder remembers by name what has been written whole, so that a restart goes on from there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from larkspan.sources.cluster import delete, files


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that is there whole or not at all; False if it was there before."""
    fs, target = files(spark, path)
    if fs.exists(target):
        return False
    temporary = f"{path}.{uuid.uuid4().hex}"
    _, part = files(spark, temporary)
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    done = not fs.exists(target) and fs.rename(part, target)
    if not done:
        fs.delete(part, False)
    return done


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is in a folder, in order; none if it isn't there."""
    fs, target = files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


class Journal:
    """Entries, in `folder`/entries, name tables in `folder`/tables. A table without an entry was never finished and isn't read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entry(self, name: str) -> dict | None:
        if f"{name}.json" not in names(self.spark, f"{self.folder}/entries"):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/entries/{name}.json", wholetext=True).first()[0])

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name; if there is none yet, what `make` gives, written down."""
        found = self.entry(name)
        if found is None:
            path = f"{self.folder}/tables/{name}-{uuid.uuid4().hex}"
            rows = make()
            rows.write.parquet(path)
            if not put(self.spark, f"{self.folder}/entries/{name}.json", json.dumps({"path": path, "schema": rows.schema.json()})):
                delete(self.spark, path)  # another run was first
            found = self.entry(name)
        return self.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(found["path"])

    def drop(self, name: str) -> None:
        """Forgets a table."""
        found = self.entry(name)
        if found is not None:
            delete(self.spark, f"{self.folder}/entries/{name}.json")
            delete(self.spark, found["path"])

    def remove(self) -> None:
        delete(self.spark, self.folder)
