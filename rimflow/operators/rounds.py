"""Tables that iterative operators write between their rounds, in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a session in one process may lack it and gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all its machines share")
    if not _OWN or not os.path.isdir(_OWN[-1]):
        _OWN.append(tempfile.mkdtemp(prefix="rimflow-"))
    return f"file://{_OWN[-1]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors do not undo it."""
    path = f"{shared_folder(df.sparkSession)}/rimflow-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
