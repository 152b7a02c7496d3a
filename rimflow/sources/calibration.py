"""Court calibrations as tables: hoops from calibrated centres, and JSON files of them, one object for each game.

A hoop's radius is 3.5 % of the distance between the hoops, 25 pixels at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HOOP = "struct<center: array<int>, radius: int, backboard_top: int, net_bottom: int>"
SCHEMA = f"game_id bigint, frame_width int, frame_height int, left_hoop {_HOOP}, right_hoop {_HOOP}, half_court_x int, is_calibrated boolean"


def hoops(centres: DataFrame) -> DataFrame:
    """game_id, side, x, y, radius; centres: game_id, left_x, left_y, right_x, right_y."""
    radius = "cast(greatest(25, floor(0.035 * abs(right_x - left_x))) as int)"
    return centres.selectExpr("game_id", f"stack(2, 'left', left_x, left_y, {radius}, 'right', right_x, right_y, {radius}) as (side, x, y, radius)")


def calibrations(centres: DataFrame, width: int = 1280, height: int = 720) -> DataFrame:
    """One calibration for each game, as SCHEMA says."""
    radius = "cast(greatest(25, floor(0.035 * abs(right_x - left_x))) as int)"
    hoop = lambda s: f"struct(array({s}_x, {s}_y) as center, {radius} as radius, {s}_y - cast(1.5 * {radius} as int) as backboard_top, {s}_y + 2 * {radius} as net_bottom) as {s}_hoop"
    return centres.selectExpr("game_id", f"{width} as frame_width", f"{height} as frame_height", hoop("left"), hoop("right"), "(left_x + right_x) div 2 as half_court_x", "true as is_calibrated")


def save(calibrated: DataFrame, path: str) -> None:
    calibrated.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """game_id, side, x, y, radius of the calibrated games in JSON files; hoops without a radius have 40."""
    read = spark.read.schema(SCHEMA).json(path).where("is_calibrated")
    side = lambda s: read.select("game_id", F.lit(s).alias("side"), F.col(f"{s}_hoop.center")[0].alias("x"), F.col(f"{s}_hoop.center")[1].alias("y"), F.coalesce(f"{s}_hoop.radius", F.lit(40)).alias("radius")).where(F.col(f"{s}_hoop").isNotNull())
    return side("left").unionByName(side("right"))
