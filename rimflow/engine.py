"""The library's front door: every plan as a method over the caller's own tables, and queries with arguments.

    engine = Engine(spark, ge=events, fr=frames, de=detections, tr=tracks)
    engine.box_score().where("game_id = 7").show()
    engine.events(etype="steal", since_frame=5000, recent=20).show()

Inputs are DataFrames with the columns that the adapters produce (see rimflow.sources.adapters); only those that a plan
names are needed for it. Tables of one row for each frame or more are joined by (game_id, frame_id), so any number of games
can be in them. Zones (zo) and court polygons (po) may be of one game each or (game_id null, or no such column) of all; they and hoops (ho) have defaults: those of the configuration, and the hoops that
rims show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimflow.config import COURT_POLYGON, DEFAULT, EngineConfig
from rimflow.operators.teams import team_clusters
from rimflow.plans.core import bind
from rimflow.plans.registry import plans
from rimflow.sources import adapters, calibration


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig = DEFAULT, **inputs: DataFrame):
        self.spark, self.config, self.inputs, self.plans = spark, config, dict(inputs), plans(config)
        self.inputs.setdefault("zo", spark.sql(adapters.zones_sql(width=config.frame_width, height=config.frame_height)))
        x, y = config.frame_width / DEFAULT.frame_width, config.frame_height / DEFAULT.frame_height
        self.inputs.setdefault("po", spark.sql(adapters.polygon_sql(tuple((int(a * x), int(b * y)) for a, b in COURT_POLYGON))))
        for name in ("zo", "po"):  # those of all games
            if "game_id" not in self.inputs[name].columns:
                self.inputs[name] = self.inputs[name].withColumn("game_id", F.lit(None).cast("long"))
        if "ho" not in self.inputs and "ri" in self.inputs:
            self.inputs["ho"] = calibration.hoops(bind(spark, self.plans["auto_calibration"], self.inputs))

    def __getattr__(self, name: str) -> Callable[[], DataFrame]:
        if name == "plans" or name not in self.plans:
            raise AttributeError(name)
        return lambda: bind(self.spark, self.plans[name], self.inputs)

    def __dir__(self) -> list[str]:
        return [*super().__dir__(), *self.plans]

    def snapshot(self) -> DataFrame:
        """One row for each game with its summary and, nested, its teams and players."""
        nest = lambda df, name: df.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct([c for c in df.columns if c != "game_id"]))).alias(name))
        return (self.summary() if "fr" in self.inputs else self.game_summary()).join(nest(self.team_totals(), "teams"), "game_id", "left").join(nest(self.player_stats(), "box"), "game_id", "left")

    # queries with arguments; what is left out does not restrict

    def events(self, etype: str | None = None, since_frame: int | None = None, recent: int | None = None) -> DataFrame:
        """Events of a type, from a frame on (with it), and of these the last ones of each game."""
        found = _matching(self.inputs["ge"], etype=etype)
        if since_frame is not None:
            found = found.where(F.col("frame_id") >= since_frame)
        if recent is not None:
            place = F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("seq")))
            found = found.withColumn("_place", place).where(F.col("_place") <= recent).drop("_place")
        return found

    def summary(self) -> DataFrame:
        """game_summary with the frames and seconds in which play was dead or live."""
        return self.game_summary().join(self.game_time(), "game_id", "left")

    def box(self, team: int | None = None, game: int | None = None) -> DataFrame:
        return _matching(self.box_score(), team=team, game_id=game)

    def player(self, track: int, game: int | None = None) -> DataFrame:
        return _matching(self.player_stats(), track=track, game_id=game)

    def team(self, team: int, game: int | None = None) -> DataFrame:
        return _matching(self.team_totals(), team=team, game_id=game)

    def top(self, stat: str = "points", n: int = 1, team: int | None = None) -> DataFrame:
        """The n best players of each game by a column of player_stats or by rebounds; ties go to who was seen first."""
        players = _matching(self.player_stats(), team=team).withColumn("rebounds", F.expr("offensive_rebounds + defensive_rebounds"))
        place = F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc(stat), "first_seq", "track"))
        return players.withColumn("place", place).where(F.col("place") <= n)

    def moments(self, n: int | None = None, track: int | None = None, jersey: str | None = None) -> DataFrame:
        found = _matching(self.top_moments(), p_track=track, p_jersey=jersey)
        return found if n is None else found.where(F.col("place") <= n)

    def shots(self, track: int | None = None, team: int | None = None) -> DataFrame:
        return _matching(self.shot_chart(), track=track, team=team)

    def hot_players(self) -> DataFrame:
        return self.hot_hand().where("is_hot")

    def frames_between(self, first: int, last: int, game: int | None = None) -> DataFrame:
        """Frames first to last, both with."""
        return _matching(self.inputs["fr"], game_id=game).where(F.col("frame_id").between(first, last))

    def focus(self, ref: int) -> DataFrame:
        """The tracks of one selected player: those that look most like them in their game, if they do enough."""
        return self.appearance_match().where(F.col("ref") == ref).select("game_id", F.col("vec_id").alias("track_id"), "dist")

    def job(self, job_id: int) -> DataFrame:
        return self.inputs["jobs"].where(F.col("o_orderkey") == job_id)

    def team_clusters(self) -> DataFrame:
        """The team of every track of the input `features` (track_id, feature): see rimflow.operators.teams."""
        return team_clusters(self.inputs["features"])

    def export_json(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").json(path)


def _matching(df: DataFrame, **wanted: object) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
