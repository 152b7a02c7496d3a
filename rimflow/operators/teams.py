"""Two teams from appearance features: the mean feature of each track (A21), then 2-means on the means (A22).

The reference starts at random and keeps the best of five attempts. Here the seeds are fixed by the data: the track
farthest from the mean of all, and the track farthest from that one (ties: the larger track). Lloyd's steps follow until no track
changes its team. What is collected are two centroids a round; tracks stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import written

MIN_SAMPLES = 2
MAX_ROUNDS = 100


def track_means(features: DataFrame, track: str = "track_id", feature: str = "feature") -> DataFrame:
    """track, samples, mean: one row for each track; rows without a track or a feature do not count."""
    given = features.where(F.col(track).isNotNull() & F.col(feature).isNotNull()).select(F.col(track).alias("track"), F.col(feature).alias("feature"))
    each = given.select("track", F.posexplode("feature").alias("i", "x")).groupBy("track", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    whole = each.groupBy("track").agg(F.max("n").alias("samples"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return whole.select("track", "samples", F.transform("v", lambda e: e["x"]).alias("mean"))


def _d2(to: list[float]) -> Column:
    gaps = F.zip_with("mean", F.array(*[F.lit(float(x)) for x in to]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b)


def _centroids(means: DataFrame, team: Column) -> dict[int, list[float]]:
    """The mean of the tracks of each team: as many numbers as the features have, twice at most."""
    rows = means.select(team.alias("team"), F.posexplode("mean").alias("i", "x")).groupBy("team", "i").agg(F.avg("x").alias("x")).collect()
    out: dict[int, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r["team"], r["i"])):
        out.setdefault(r["team"], []).append(r["x"])
    return out


def team_clusters(features: DataFrame, track: str = "track_id", feature: str = "feature", min_samples: int = MIN_SAMPLES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """track, samples, team (0 or 1), d2 (to its centroid) of every track with min_samples; the smallest track is of team 0.

    Fewer than two such tracks give an empty result, as there is nothing to divide.
    """
    return two_means(track_means(features, track, feature).where(F.col("samples") >= min_samples), max_rounds)


def two_means(means: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """track, samples, team, d2 of tracks with their mean features (track, samples, mean)."""
    means = written(means, "means")  # read again in every round
    if means.limit(2).count() < 2:
        return means.select("track", "samples", F.lit(0).alias("team"), F.lit(0.0).alias("d2")).limit(0)
    at = _centroids(means, F.lit(0))[0]
    seeds = []
    for _ in range(2):
        at = means.agg(F.max_by("mean", F.struct(_d2(at), "track"))).first()[0]
        seeds.append(at)
    last = None
    for _ in range(max_rounds):
        team = F.when(_d2(seeds[1]) < _d2(seeds[0]), 1).otherwise(0)
        state = means.agg(F.sum(team), F.bit_xor(F.xxhash64("track", team))).first()
        if state == last:
            break
        last = state
        found = _centroids(means, team)
        seeds = [found.get(k, seeds[k]) for k in (0, 1)]
    else:
        raise RuntimeError("the teams did not settle")
    first = means.agg(F.min_by(team, "track")).first()[0]
    return means.select("track", "samples", F.when(team == first, 0).otherwise(1).alias("team"), F.least(_d2(seeds[0]), _d2(seeds[1])).alias("d2"))
