"""Teams of a running game: features of tracks come in batches, the division into two teams is fitted again now and then.

Each batch leaves partial sums of its tracks' features in a table, in a partition that the batch's number names, so a batch that runs again
replaces its own. When `least` samples are there, and then after every `every` frames, the tracks' means are divided by the
same 2-means as team_clusters. Which team is called 0 may change from fit to fit; a fit whose teams agree less than not with the last one (by
samples of the tracks that both know) has its names exchanged, so a track keeps its team. Fits are kept by batch, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimflow.operators.teams import MIN_SAMPLES, two_means

SUMS = "track long, i int, x double, n long, frame long, batch long"
FIT = "track long, samples long, team int, frame long, batch long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _put(df: DataFrame, schema: str, batch: int, path: str) -> None:
    columns = [f"cast({c} as {kind}) as {c}" for c, kind in (x.split() for x in schema.split(", "))]
    df.withColumn("batch", F.lit(batch)).selectExpr(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def teams_so_far(spark: SparkSession, path: str) -> DataFrame:
    """track, samples, team of the last fit; empty before the first."""
    fits = _table(spark, f"{path}/fits", FIT)
    last = fits.agg(F.max("batch").alias("batch"))
    return fits.join(last, "batch").select("track", "samples", "team")


def take_in(features: DataFrame, batch: int, path: str, least: int = 40, every: int = 120, min_samples: int = MIN_SAMPLES) -> bool:
    """Adds a batch (track_id, frame_id, feature) and fits if it is time; says whether it did."""
    spark = features.sparkSession
    given = features.where("track_id is not null and feature is not null").select(F.col("track_id").alias("track"), "frame_id", F.posexplode("feature").alias("i", "x"))
    _put(given.groupBy("track", "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"), F.max("frame_id").alias("frame")), SUMS, batch, f"{path}/sums")
    sums = _table(spark, f"{path}/sums", SUMS).where(F.col("batch") <= batch)
    fits = _table(spark, f"{path}/fits", FIT).where(F.col("batch") < batch)
    now = sums.where("i = 0").agg(F.sum("n").alias("n"), F.max("frame").alias("frame")).first()
    last = fits.agg(F.max("frame"), F.max("batch")).first()
    if (now["n"] or 0) < least or (last[0] is not None and now["frame"] - last[0] < every):
        return False
    each = sums.groupBy("track", "i").agg(F.sum("n").alias("samples"), (F.sum("x") / F.sum("n")).alias("x"))
    means = each.groupBy("track").agg(F.max("samples").alias("samples"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = two_means(means.where(F.col("samples") >= min_samples).select("track", "samples", F.transform("v", lambda e: e["x"]).alias("mean"))).select("track", "samples", "team")
    before = fits.where(F.col("batch") == (-1 if last[1] is None else last[1])).select("track", F.col("team").alias("was"))
    agree = found.join(before, "track").agg(F.sum(F.when(F.col("team") == F.col("was"), F.col("samples")).otherwise(-F.col("samples")))).first()[0]
    if agree is not None and agree < 0:
        found = found.withColumn("team", 1 - F.col("team"))
    _put(found.withColumn("frame", F.lit(now["frame"])), FIT, batch, f"{path}/fits")
    return True


def learning(path: str, **settings: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""

    def sink(features: DataFrame, batch: int) -> None:
        take_in(features, batch, path, **settings)

    return sink
