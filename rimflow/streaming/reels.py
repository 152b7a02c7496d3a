"""Reels while games run: stretches around every frame in which a selected player is near the ball or near an event.

Sightings of selected players meet balls and events of the same frame in a stream-stream join whose state the watermark clears. The
moments that come out open a session for each player: from reel_lead frames before a moment to reel_hold frames after it, and stretches that
touch are one. A reel is given out once the watermark has passed its end. The rows are those of the plan player_reels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimflow.config import DEFAULT, EngineConfig


def moments(sightings: DataFrame, frames: DataFrame, events: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """game_id, ref, frame_id, ts: where a selected player is within near_ball of the ball, or half as far again of an event.

    sightings: game_id, frame_id, ts, ref, cx, cy; frames and events: game_id, frame_id, ts, ball_x, ball_y. All are streams with a watermark on ts,
    or all are tables; rows of one frame carry one ts. Frames without a ball are left out before the join and do not move the watermark on.
    """
    near = config.near_ball**2
    marks = frames.select("game_id", "frame_id", "ts", "ball_x", "ball_y", F.lit(4 * near).alias("reach"))
    if events is not None:
        marks = marks.union(events.select("game_id", "frame_id", "ts", "ball_x", "ball_y", F.lit(9 * near).alias("reach")))
    on = "s.game_id = m.game_id and s.frame_id = m.frame_id and s.ts = m.ts"
    within = "4 * ((s.cx - m.ball_x) * (s.cx - m.ball_x) + (s.cy - m.ball_y) * (s.cy - m.ball_y)) <= m.reach"
    return sightings.alias("s").join(marks.alias("m"), F.expr(f"{on} and {within}")).select("s.game_id", "s.ref", "s.frame_id", "s.ts")


def live_reels(sightings: DataFrame, frames: DataFrame, events: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """game_id, ref, start_frame, end_frame, moments (frames in which the player is near) of every reel."""
    # half a frame more than the stretches are long, so that those that touch are one
    gap = f"{int(1_000_000 * (config.reel_lead + config.reel_hold + 0.5) / config.fps)} microseconds"
    found = moments(sightings, frames, events, config)
    reels = found.groupBy("game_id", "ref", F.session_window("ts", gap).alias("w")).agg(
        F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.size(F.collect_set("frame_id")).cast("long").alias("moments")
    )
    return reels.select(
        "game_id", "ref", F.greatest(F.lit(0), F.col("first") - config.reel_lead).alias("start_frame"), (F.col("last") + config.reel_hold).alias("end_frame"), "moments"
    )
