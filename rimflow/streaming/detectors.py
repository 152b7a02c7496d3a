"""Live detectors: shots, scores, passes, turnovers and dead balls of games whose frames arrive late and out of order.

    frames = with_nearest(spark.readStream..., tracks)       # game_id, frame_id, ts, ball_x, ball_y, rim_x, rim_y, conf, scored, who, team
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    live_detections(frames.withWatermark("ts", "2 seconds")).writeStream...

Each game is a key of one stateful operator. Frames that the watermark has not passed wait in a list state and are released
in the order of their numbers when it does, so that a late frame takes its place instead of being folded out of order; frames that
arrive behind the watermark are dropped by Spark. Released frames advance small state machines, whose state is one value; what they
find is given out once. An event-time timer wakes a game for the frames that wait. When a game has sent nothing for `idle`
frames of event time it is ended: an open dead ball is closed at its last frame, and all its state is removed.

The machines give the rows of the plans of the same rules (shot_attempts, cooldown, passes, turnovers, dead_segments, dead_state).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rimflow.config import DEFAULT, EngineConfig

#: The operator keeps its state in this provider; set it as spark.sql.streaming.stateStore.providerClass.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FRAME = "frame_id long, ms long, ball_x double, ball_y double, rim_x double, rim_y double, conf double, scored boolean, who long, team long"
FIELDS = [c.split()[0] for c in FRAME.split(", ")]
FOUND = "game_id long, kind string, frame_id long, start_frame long, seg long, n long, size double, track long, other long, reason string"
MACHINES = ("shots", "scores", "passes", "segments", "dead")


def _square(x: float) -> int:
    return int(x**2)


class Shots:
    """A ball that rises for some frames by some height: found at the first frame in which it does not."""

    def __init__(self, config: EngineConfig):
        self.c, self.before, self.n, self.start, self.peak = config, None, 0, 0.0, 0.0

    def step(self, f: dict) -> Iterator[dict]:
        if f["ball_x"] is None:
            return
        x, y = f["ball_x"], f["ball_y"]
        was, self.before = self.before, [x, y]
        if was and y < was[1] and (x - was[0]) ** 2 + (y - was[1]) ** 2 >= _square(self.c.rise_speed):
            self.start, self.peak = (was[1], y) if not self.n else (self.start, min(self.peak, y))
            self.n += 1
            return
        if self.n >= self.c.rise_frames and self.start - self.peak >= int(self.c.arc_height):
            yield {"kind": "shot_attempt", "frame_id": f["frame_id"], "n": self.n, "size": self.start - self.peak}
        self.n = 0


class Scores:
    """A ball that falls through the height of the rim near it; then a pause."""

    def __init__(self, config: EngineConfig):
        self.c, self.before, self.last = config, None, None

    def step(self, f: dict) -> Iterator[dict]:
        if f["ball_x"] is None:
            return
        was, self.before = self.before, f["ball_y"]
        if was is None or f["rim_y"] is None or f["rim_x"] is None or not was < f["rim_y"] <= f["ball_y"]:
            return
        r2 = (f["ball_x"] - f["rim_x"]) ** 2 + (f["ball_y"] - f["rim_y"]) ** 2
        if r2 <= _square(self.c.rim_radius) and (self.last is None or f["frame_id"] - self.last >= self.c.score_cooldown):
            self.last = f["frame_id"]
            yield {"kind": "score", "frame_id": f["frame_id"], "size": r2}


class Passes:
    """Who holds the ball, and from that passes and turnovers. who, team: the nearest player in reach, or none."""

    def __init__(self, config: EngineConfig):
        self.c, self.who, self.frames, self.missed, self.nth = config, None, 0, 0, 0
        self.holder = self.team = self.before = None
        self.last: list | None = None  # holder, team, frame number, ball of the last frame with a holder

    def step(self, f: dict) -> Iterator[dict]:
        if f["ball_x"] is None:
            return
        self.nth += 1
        if f["who"] is None:
            self.missed += 1
            if self.missed >= self.c.possession_loss_frames:
                self.who, self.frames, self.holder, self.team = None, 0, None, None
        else:
            self.missed, self.frames, self.who = 0, self.frames + 1 if f["who"] == self.who else 1, f["who"]
            if self.frames >= self.c.possession_frames:
                self.holder, self.team = f["who"], -1 if f["team"] is None else f["team"]
        before, self.before = self.before, self.holder
        if self.holder is None:
            return
        last, self.last = self.last, [self.holder, self.team, self.nth, f["ball_x"], f["ball_y"]]
        if last is None or last[0] == self.holder:
            return
        far = (f["ball_x"] - last[3]) ** 2 + (f["ball_y"] - last[4]) ** 2 >= _square(self.c.pass_distance)
        if before is None and last[1] == self.team and far and self.nth - last[2] - 1 <= self.c.pass_frames + 1:
            yield {"kind": "pass", "frame_id": f["frame_id"], "track": last[0], "other": self.holder, "n": self.nth - last[2] - 2}
        if last[1] != self.team and last[1] >= 0 and self.team >= 0:
            yield {"kind": "turnover", "frame_id": f["frame_id"], "track": last[0], "other": self.holder}


class Segments:
    """Stretches without play: the ball is missing, out of bounds, still, or seen with low confidence only."""

    def __init__(self, config: EngineConfig):
        self.c, self.seen, self.missing, self.still, self.seg, self.open = config, None, 0, 0, 0, None
        self.conf: list = []
        self.v: list = []

    def _reason(self, f: dict) -> str | None:
        c, there, v = self.c, f["ball_x"] is not None, 0.0
        self.missing = 0 if there else self.missing + 1
        if there:
            v = ((f["ball_x"] - self.seen[0]) ** 2 + (f["ball_y"] - self.seen[1]) ** 2) ** 0.5 if self.seen else 0.0
            self.seen = [f["ball_x"], f["ball_y"]]
        self.conf, self.v = [*self.conf, f["conf"]][-10:], [*self.v, v][-c.still_frames :]
        slow = there and f["conf"] is not None and f["conf"] >= c.min_confidence and len(self.v) == c.still_frames and round(sum(self.v) / len(self.v), 6) < c.still_pixels
        self.still = self.still + 1 if slow else 0
        known = [x for x in self.conf if x is not None]
        out = c.bounds_outer
        if self.missing >= c.missing_frames:
            return "ball_missing"
        if there and not (-out <= f["ball_x"] <= c.frame_width + out and -out <= f["ball_y"] <= c.frame_height + out):
            return "out_of_bounds"
        if self.still >= c.still_frames:
            return "ball_stationary"
        return "low_confidence" if len(self.conf) == 10 and known and round(sum(known) / len(known), 9) < c.min_confidence / 2 else None

    def step(self, f: dict) -> Iterator[dict]:
        reason = self._reason(f)
        if reason:
            if not self.open:
                self.seg += 1
                self.open = [f["frame_id"], f["frame_id"], reason]
            self.open[1] = f["frame_id"]
        else:
            yield from self.end()

    def end(self) -> Iterator[dict]:
        if self.open and self.open[1] + 1 - self.open[0] >= int(self.c.min_dead_sec * self.c.fps):
            yield {"kind": "dead_segment", "frame_id": self.open[1] + 1, "start_frame": self.open[0], "seg": self.seg, "reason": self.open[2]}
        self.open = None


class Dead:
    """Whether play is dead: for some frames after a score, out of bounds, or with the ball at rest. Given out when it changes."""

    def __init__(self, config: EngineConfig):
        self.c, self.scored, self.ball, self.still, self.dead, self.said, self.last = config, None, None, 0, False, False, 0

    def step(self, f: dict) -> Iterator[dict]:
        c, x, y = self.c, f["ball_x"], f["ball_y"]
        self.last = f["frame_id"]
        if f["scored"]:
            self.scored = f["frame_id"]
        fresh = self.scored is not None and f["frame_id"] - self.scored < c.dead_after_score
        edge = c.bounds_inner
        out = x is not None and (x < edge or x > c.frame_width - edge or y < edge or y > c.frame_height - edge)
        early, has = fresh or out, x is not None and self.ball is not None
        slow = has and (x - self.ball[0]) ** 2 + (y - self.ball[1]) ** 2 < c.rest_pixels**2
        if not early and has:
            self.still = self.still + 1 if slow else 0
        rest = has and self.still >= c.rest_frames
        said = early or bool(f["scored"]) or rest or (self.dead and (not has or slow))
        self.dead = bool(f["scored"]) or (out and not fresh) or (not early and rest) or (self.dead and (early or not has or slow))
        if not early:
            self.ball = None if x is None else [x, y]
        if said != self.said:
            self.said = said
            yield {"kind": "dead_ball" if said else "live_ball", "frame_id": f["frame_id"]}

    def end(self) -> Iterator[dict]:
        if self.said:
            yield {"kind": "live_ball", "frame_id": self.last + 1}


_KINDS = {"shots": Shots, "scores": Scores, "passes": Passes, "segments": Segments, "dead": Dead}


class Detectors:
    """The machines of one game, whose state can be written and read."""

    def __init__(self, config: EngineConfig = DEFAULT, machines: tuple[str, ...] = MACHINES, state: str | None = None):
        self.all = {m: _KINDS[m](config) for m in machines}
        self.last = -1
        if state:
            saved = json.loads(state)
            self.last = saved["last"]
            for m, x in self.all.items():
                x.__dict__.update(saved["of"][m])

    def saved(self) -> str:
        return json.dumps({"last": self.last, "of": {m: {k: v for k, v in x.__dict__.items() if k != "c"} for m, x in self.all.items()}})

    def step(self, frame: dict) -> Iterator[dict]:
        """frame: FIELDS; a frame that came already, or an earlier one, is passed over."""
        if frame["frame_id"] <= self.last:
            return
        self.last = frame["frame_id"]
        for x in self.all.values():
            yield from x.step(frame)

    def end(self) -> Iterator[dict]:
        for x in self.all.values():
            if hasattr(x, "end"):
                yield from x.end()


class _Games(StatefulProcessor):
    def __init__(self, settings: dict, machines: tuple[str, ...], idle_ms: int):
        self.settings, self.machines, self.idle_ms = settings, machines, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.config = EngineConfig(**self.settings)
        self.waiting = handle.getListState("waiting", FRAME)
        self.state = handle.getValueState("machines", "saved string, last_ms long")

    def handleInputRows(self, key, rows, timerValues):
        new = [_plain(r) for part in rows for r in part[FIELDS].astype(object).where(part[FIELDS].notna(), None).itertuples(index=False)]
        yield from self._advanced(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advanced(key, [], timerValues.getCurrentWatermarkInMs())

    def _advanced(self, key: tuple, new: list[tuple], upto: int) -> Iterator[pd.DataFrame]:
        rows = [_plain(r) for r in self.waiting.get()] + new if self.waiting.exists() else new
        ready = sorted((r for r in rows if r[1] <= upto), key=lambda r: r[0])
        later = [r for r in rows if r[1] > upto]
        saved, last_ms = self.state.get() if self.state.exists() else (None, upto)
        machines = Detectors(self.config, self.machines, saved)
        found = []
        for r in ready:
            found += machines.step(dict(zip(FIELDS, r, strict=True)))
            last_ms = max(last_ms, r[1])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not later and upto >= last_ms + self.idle_ms:
            found += machines.end()
            self.waiting.clear()
            self.state.clear()
        else:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            self.state.update((machines.saved(), int(last_ms)))
            self.handle.registerTimer(int(min(r[1] for r in later) if later else last_ms + self.idle_ms))
        if found:
            columns = dict(c.split() for c in FOUND.split(", "))
            yield pd.DataFrame({c: pd.Series([x.get(c, key[0] if c == "game_id" else None) for x in found], dtype=_DTYPES[kind]) for c, kind in columns.items()})

    def close(self) -> None:
        pass


_DTYPES = {"long": "Int64", "double": "float64", "string": object}
_OF = {"long": int, "double": float, "boolean": bool}
_KIND_OF = [_OF[c.split()[1]] for c in FRAME.split(", ")]


def _plain(row: tuple) -> tuple:
    """The values of FRAME as Python's own."""
    return tuple(None if x is None else kind(x) for kind, x in zip(_KIND_OF, row, strict=True))


def live_detections(frames: DataFrame, config: EngineConfig = DEFAULT, machines: tuple[str, ...] = MACHINES, idle: int = 90) -> DataFrame:
    """game_id, kind (shot_attempt, score, pass, turnover, dead_segment, dead_ball, live_ball), frame_id and what belongs to the kind.

    frames: a stream with a watermark on ts (event time) and game_id, frame_id, ball_x, ball_y, rim_x, rim_y, conf, scored; for passes also
    who and team, the nearest player in reach (with_nearest). idle: frames of silence after which a game has ended.
    """
    have = set(frames.columns)
    kinds = dict(c.split() for c in FRAME.split(", "))
    columns = [(F.unix_millis("ts") if c == "ms" else F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in FIELDS]
    keyed = frames.select(F.col("game_id").cast("long").alias("game_id"), "ts", *columns).groupBy("game_id")
    return keyed.transformWithStateInPandas(_Games(asdict(config), machines, int(1000 * idle / config.fps)), FOUND, "Append", "EventTime")


def with_nearest(frames: DataFrame, tracks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """frames with who and team: the player nearest to the ball, if in reach. Both sides carry their game's frames with ts and a watermark, or neither is a stream.

    A frame waits for its tracks until the watermark has passed it; a frame without any is given out then.
    """
    dist = "(t.cx - f.ball_x) * (t.cx - f.ball_x) + (t.cy - f.ball_y) * (t.cy - f.ball_y)"
    on = "f.game_id = t.game_id and f.frame_id = t.frame_id and f.ts = t.ts"
    near = frames.alias("f").join(tracks.alias("t"), F.expr(on), "left").select("f.*", "t.track_id", "t.team_id", F.expr(dist).alias("d2"))
    keep = [c for c in frames.columns if c not in ("game_id", "frame_id", "ts")]
    reach = F.min(F.when(F.col("d2") <= config.possession_radius**2, F.struct("d2", "track_id", "team_id"))).alias("best")
    best = near.groupBy("game_id", "frame_id", "ts").agg(*[F.first(c).alias(c) for c in keep], reach)
    return best.select("game_id", "frame_id", "ts", *keep, F.col("best.track_id").alias("who"), F.col("best.team_id").alias("team"))
