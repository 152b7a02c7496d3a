"""Live games: the same questions on streams of events.

Running totals use stateful aggregation in update mode; possession, whose rule depends on the order of frames, keeps one small
state for each game. Sinks go through foreachBatch, so a callback sees ordinary DataFrames and a failed batch is run again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rimflow.config import DEFAULT, EngineConfig


def live_scores(events: DataFrame) -> DataFrame:
    """Points and baskets of each team so far; events: game_id, etype, p_team."""
    points = F.expr("case etype when 'score_3pt' then 3 when 'score_2pt' then 2 when 'free_throw_made' then 1 else 0 end")
    return events.groupBy("game_id", "p_team").agg(F.sum(points).alias("points"), F.count("*").alias("events"))


def live_event_counts(events: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time (column ts); windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "etype").agg(F.count("*").alias("n")).select("w.start", "w.end", "etype", "n")


def possession_step(contacts: list[tuple[int, int | None]], state: tuple, config: EngineConfig = DEFAULT) -> tuple[list[tuple[int, int | None]], tuple]:
    """Advances (candidate, its frames, holder, frames without contact) over (frame, player in reach or None)."""
    who, frames, holder, missed = state
    out = []
    for frame, player in contacts:
        if player is None:
            missed += 1
            if missed >= config.possession_loss_frames:
                who, frames, holder = None, 0, None
        else:
            missed = 0
            who, frames = player, frames + 1 if player == who else 1
            if frames >= config.possession_frames:
                holder = who
        out.append((frame, holder))
    return out, (who, frames, holder, missed)


def live_possession(contacts: DataFrame) -> DataFrame:
    """game_id, frame_id, holder; contacts: game_id, frame_id, player (null where nobody is in reach)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (-1, 0, -1, 0)
        unwrap = lambda x: None if x == -1 else x
        now = (unwrap(old[0]), old[1], unwrap(old[2]), old[3])
        rows = pd.concat(list(parts)).sort_values("frame_id")
        seen = [(int(f), None if pd.isna(p) else int(p)) for f, p in zip(rows["frame_id"], rows["player"], strict=True)]
        out, now = possession_step(seen, now)
        state.update(tuple(-1 if x is None else int(x) for x in now))
        yield pd.DataFrame({"game_id": key[0], "frame_id": [f for f, _ in out], "holder": pd.array([h for _, h in out], dtype="Int64")})

    narrow = contacts.select(F.col("game_id").cast("long").alias("game_id"), F.col("frame_id").cast("long").alias("frame_id"), F.col("player").cast("long").alias("player"))
    return narrow.groupBy("game_id").applyInPandasWithState(
        step, "game_id long, frame_id long, holder long", "who long, frames long, holder long, missed long", "append", GroupStateTimeout.NoTimeout
    )


def live_clips(marks: DataFrame, gap: str = "1 second", late: str = "20 seconds") -> DataFrame:
    """Clips of a live game: marks (game_id, ts, etype) no further apart than gap are one session, which is given out once the watermark has passed it."""
    sessions = marks.withWatermark("ts", late).groupBy("game_id", F.session_window("ts", gap).alias("w"))
    return sessions.agg(F.count("*").alias("marks"), F.sort_array(F.collect_set("etype")).alias("etypes")).select("game_id", "w.start", "w.end", "marks", "etypes")


def to_callbacks(events: DataFrame, callbacks: dict[str, Callable[[DataFrame], None]], checkpoint: str, on_error: Callable[[str, Exception], None] | None = None):
    """Starts a query that hands each micro-batch's rows of an event type to the callback of that name.

    A callback that fails does not keep the others from their rows nor stop the query: its error goes to on_error, or to the log.
    """

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.persist()
        for etype, call in callbacks.items():
            try:
                call(batch.where(F.col("etype") == etype))
            except Exception as error:  # whatever a callback raises is its own affair
                (on_error or (lambda name, e: logging.getLogger(__name__).warning("callback %s failed: %s", name, e)))(etype, error)
        batch.unpersist()

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
