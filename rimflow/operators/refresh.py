"""Team totals that are kept up to date batch by batch instead of summed anew.

The store is a Parquet table of partial sums of players, partitioned by a bucket of games. A batch of new events is summed by player, and the
buckets of its games, and only those, are read, added to and overwritten (dynamic partition overwrite). Sums merge, so the
totals are those of all events. A batch carries a number, and every bucket remembers the last one that it took in, so a batch
that is applied again after a failure counts once. Batches are applied one after another, as a streaming query's foreachBatch does.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
_POINTS = "case etype when 'score_3pt' then 3 when 'score_2pt' then 2 when 'free_throw_made' then 1 else 0 end"
SUMS = {
    "events": "1", "points": _POINTS, "fg_makes": "int(etype in ('score_2pt', 'score_3pt'))", "fg_attempts": "int(etype in ('score_2pt', 'score_3pt', 'shot_miss'))",
    "assists": "int(etype = 'assist')", "steals": "int(etype = 'steal')", "blocks": "int(etype = 'block')", "turnovers": "int(etype = 'turnover')",
    "rebounds": "int(etype in ('rebound_off', 'rebound_def'))", "fouls": "int(etype = 'foul')",
}
_SCHEMA = "game_id long, team int, track long, " + ", ".join(f"{s} long" for s in SUMS) + ", first_seq long, batch long, bucket int"


def partial_sums(events: DataFrame) -> DataFrame:
    """game_id, team, track and the sums of each player; events: game_id, seq, etype, p_track, p_team."""
    keys = [F.col("game_id").cast("long").alias("game_id"), F.col("p_team").cast("int").alias("team"), F.col("p_track").cast("long").alias("track")]
    return events.groupBy(*keys).agg(*[F.sum(F.expr(x)).cast("long").alias(s) for s, x in SUMS.items()], F.min("seq").cast("long").alias("first_seq"))


def _merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(s).cast("long").alias(s) for s in SUMS], F.min("first_seq").alias("first_seq"))


def stored_sums(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def apply_batch(events: DataFrame, batch: int, path: str) -> list[int]:
    """Adds a batch of events to the store; gives the buckets that it touched. Batch numbers ascend; one that was applied already changes nothing."""
    spark = events.sparkSession
    new = partial_sums(events).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(game_id), {BUCKETS}) as int)"))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most BUCKETS numbers
    if not touched:
        return []
    old = stored_sums(spark, path).where(F.col("bucket").isin(touched))
    done = [r["bucket"] for r in old.groupBy("bucket").agg(F.max("batch").alias("b")).where(F.col("b") >= batch).collect()]
    left = [b for b in touched if b not in done]
    if not left:
        return []
    both = old.drop("batch").unionByName(new).where(F.col("bucket").isin(left))
    merged = _merged(both, "game_id", "team", "track", "bucket").withColumn("batch", F.lit(batch).cast("long"))
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    # what is overwritten is also read, so the new rows are written beside it first
    merged.select(*columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}-next")
    staged = spark.read.schema(_SCHEMA).parquet(f"{path}-next")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return left


def team_sums(spark: SparkSession, path: str, game: int | None = None) -> DataFrame:
    """The sums of each team of each game; a game is looked for in its bucket only."""
    rows = stored_sums(spark, path)
    if game is not None:
        rows = rows.where(F.expr(f"bucket = cast(pmod(xxhash64({int(game)}L), {BUCKETS}) as int) and game_id = {int(game)}"))
    return _merged(rows, "game_id", "team")
