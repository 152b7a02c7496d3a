"""What the corpus operators have in common: tables in the shared folder, size-checked joins."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 1_000_000


#: A shuffle has a partition for so many bytes of the files that a job reads.
PARTITION_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The size of what df reads, by the planner's knowledge of files; inputs of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 62)


@contextlib.contextmanager
def job_settings(df: DataFrame) -> Iterator[None]:
    """While a job of ours runs: small Arrow batches, and as many shuffle partitions as its input is worth; then the session's settings again."""
    conf = df.sparkSession.conf
    partitions = max(int(conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // PARTITION_BYTES))
    wanted = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session in one process may lack it (tests); it gets a folder of its own then.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all its machines share")
    global _OWN
    if _OWN is None or not os.path.isdir(_OWN):
        _OWN = tempfile.mkdtemp(prefix="rimflow-")
    return f"file://{_OWN}"


_OWN: str | None = None


#: What one Arrow batch of texts or hashes may hold; a batch is in memory several times, in the JVM and in Python.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rimflow-{uuid.uuid4().hex}/{name}"
    with job_settings(df):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(keys: DataFrame) -> DataFrame:
    """A narrow stored table as one side of a join with wide rows.

    It is counted: up to BROADCAST_ROWS rows are broadcast so that wide rows stay where they are; more
    go through a shuffled join, which the adaptive planner splits where keys are hot.
    """
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def keyed_filter(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """left_semi or left_anti join of wide rows with a narrow key table; the columns of rows keep their order."""
    return rows.join(counted(keys), on, how).select(*[F.col(f"`{c}`") for c in rows.columns])


ROW_KEY = ["_row_key_a", "_row_key_b"]


def with_row_key(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with two 64-bit hashes of these columns: they tell rows apart whose doc_id is null or repeated."""
    each = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumns({k: F.xxhash64(F.lit(i), *each) for i, k in enumerate(ROW_KEY)})


def crc_mod5(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
