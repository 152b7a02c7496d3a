"""A key-value store of JSON documents as a folder of Spark tables: read by key, all, put and update.

A put writes the merged table as a new version and then names it in the folder's list of versions; readers take the last one named, so
they see the old table or the new one and never half of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string"


class JsonStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")

    def _last(self) -> str | None:
        fs = self._versions.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(self._versions):
            return None
        row = self.spark.read.schema("at long, version string").json(f"{self.path}/versions").agg(F.max(F.struct("at", "version"))).first()[0]
        return row["version"] if row else None

    def all(self) -> DataFrame:
        """key, value (a JSON text) of every document."""
        last = self._last()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{last}") if last else self.spark.createDataFrame([], SCHEMA)

    def get(self, key: str) -> str | None:
        row = self.all().where(F.col("key") == key).first()
        return row["value"] if row else None

    def put(self, documents: DataFrame) -> None:
        """Puts documents (key, value) in place of those with the same keys."""
        old, version = self.all(), uuid.uuid4().hex
        kept = old.join(documents.select("key").distinct(), "key", "left_anti").select("key", "value")
        kept.unionByName(documents.select("key", "value").dropDuplicates(["key"])).write.parquet(f"{self.path}/{version}")
        stamp = self.spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("at"), F.lit(version).alias("version"))
        stamp.write.mode("append").json(f"{self.path}/versions")

    def update(self, key: str, **fields: object) -> None:
        """Sets fields of one document; the others stay."""
        import json

        now = json.loads(self.get(key) or "{}") | fields
        self.put(self.spark.createDataFrame([(key, json.dumps(now))], SCHEMA))
