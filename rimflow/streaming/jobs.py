"""A queue of jobs as a stream: polled with offsets, claimed once for each batch, and taken through their states.

    spark.dataSource.register(job_source("jobs", poll))
    queue = spark.readStream.format("jobs").load()
    queue.writeStream.foreachBatch(claiming(f"{folder}/claims", work)).option("checkpointLocation", ...).start()

poll(first, limit) gives jobs numbered from `first` on, in order: (number, job_id, kind, created_at). It may ask a service or a table; the numbers are the
stream's offsets, so a batch that failed is polled again with the same jobs. A claim is a partition of a Parquet table, named by the
batch: a batch that runs again overwrites its own claims and no others, and a job that an earlier batch has claimed (because it was handed
in twice) is left to that one. So every job is claimed exactly once, whatever fails in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

JOB = "number long, job_id long, kind string, created_at long"
CLAIM = f"{JOB}, place long, status string, batch long"

#: The states that a job goes through, and what may follow on each.
NEXT = {
    "uploaded": ("detecting", "failed"), "detecting": ("selecting", "failed"), "selecting": ("analyzing", "failed"), "analyzing": ("completed", "failed"),
    "completed": (), "failed": (),
}


def job_source(name: str, poll: Callable[[int, int], list[tuple]], limit: int = 1000) -> type[DataSource]:
    """A streaming data source over poll; a batch has at most `limit` jobs."""

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"number": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            found = poll(start["number"], limit)
            return iter(found), {"number": found[-1][0] + 1 if found else start["number"]}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter([j for j in poll(start["number"], limit) if j[0] < end["number"]])

        def commit(self, end: dict) -> None:
            pass

    class Queue(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return JOB

        def simpleStreamReader(self, schema: object) -> Reader:
            return Reader()

    return Queue


def claims(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CLAIM).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CLAIM)


def claim(jobs: DataFrame, batch: int, path: str) -> DataFrame:
    """Claims the jobs of a batch: analyses before scans, the oldest first; a job that came twice once. Gives them with their place."""
    spark = jobs.sparkSession
    earlier = claims(spark, path).where(F.col("batch") < batch).select("job_id")
    free = jobs.groupBy("job_id").agg(F.min(F.struct("number", "kind", "created_at")).alias("j")).select("j.number", "job_id", "j.kind", "j.created_at").join(earlier, "job_id", "left_anti")
    # a batch has a bounded number of jobs, so one window may order them
    placed = free.selectExpr(
        "number", "job_id", "kind", "created_at", "row_number() over (order by case kind when 'analyze' then 0 else 1 end, created_at, number) as place", "'detecting' as status", f"{int(batch)}L as batch"
    )
    placed.selectExpr(*[f"cast({c} as {kind}) as {c}" for c, kind in (x.split() for x in CLAIM.split(", "))]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)
    return claims(spark, path).where(F.col("batch") == batch)


def claiming(path: str, work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: claims the batch's jobs and hands them to work, in the order of `place`."""

    def sink(jobs: DataFrame, batch: int) -> None:
        mine = claim(jobs, batch, path)
        if not mine.isEmpty():
            work(mine.orderBy("place"), batch)

    return sink


def latest_states(transitions: DataFrame) -> DataFrame:
    """job_id, status, ignored of a table of transitions (job_id, at, status): steps that may not follow on the state before are ignored and counted.

    Every job begins as uploaded; transitions of one job are few, so they are folded in their order within one row.
    """
    steps = F.sort_array(F.collect_list(F.struct("at", "status")))
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    start = F.struct(F.lit("uploaded").alias("status"), F.lit(0).alias("ignored"))
    folded = F.aggregate(
        steps, start,
        lambda s, t: F.when(F.array_contains(allowed[s["status"]], t["status"]), F.struct(t["status"].alias("status"), s["ignored"].alias("ignored"))).otherwise(
            F.struct(s["status"].alias("status"), (s["ignored"] + 1).alias("ignored"))
        ),
    )
    return transitions.groupBy("job_id").agg(folded.alias("s")).select("job_id", "s.status", "s.ignored")
