"""Live detectors on late and shuffled frames against the batch plans, and what is left in their state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rimflow.config import EngineConfig
from rimflow.engine import Engine
from rimflow.streaming.detectors import ROCKSDB, Detectors, live_detections, with_nearest

FRAME = "game_id long, frame_id long, ball_x int, ball_y int, rim_x int, rim_y int, conf double, scored boolean"
TRACK = "game_id long, frame_id long, track_id long, cx int, cy int, x1 int, y1 int, x2 int, y2 int, team_id int, jersey string"
CONFIG = EngineConfig(
    possession_loss_frames=4, pass_distance=30.0, rise_speed=6.0, rise_frames=3, arc_height=20.0, rim_radius=200.0, score_cooldown=12, dead_after_score=8, rest_frames=4,
    missing_frames=4, still_frames=6, min_dead_sec=0.1, min_confidence=0.3,
)
CLOCK = 999  # a game that only moves the watermark on


@pytest.fixture(scope="module")
def rocks(spark: SparkSession):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def games(seed, n_games=3, n=260):
    """Balls that rise, fall through the rim, lie still, are lost and leave the court; players in and out of reach."""
    rng = random.Random(seed)
    frames, tracks = [], []
    for g in range(n_games):
        x, y, mode, left, who = 640, 360, "walk", 0, None
        for f in range(n):
            if left == 0:
                mode, left, who = rng.choice(["walk", "rise", "fall", "still", "lost", "out", "dim"]), rng.randint(3, 14), rng.choice([None, None, 0, 2, 0, 2, 1, 3])
            left -= 1
            if mode == "rise":
                y -= rng.randint(5, 25)
            elif mode == "fall":
                y += rng.randint(5, 40)
            elif mode == "out":
                x = 1290 + rng.randint(0, 60)
            elif mode != "still":
                x, y = x + rng.randint(-15, 15), y + rng.randint(-9, 9)
            if not 0 <= y <= 720 or (x > 1280 and mode != "out"):
                x, y = 640, 300
            seen = mode != "lost"
            frames.append((g, f, x if seen else None, y if seen else None, 640, 280, rng.random() * (0.2 if mode == "dim" else 1.0), rng.random() < 0.01))
            for t in range(4):
                px, py = x + (rng.randint(-60, 60) if t == who else 300 + 50 * t), y + rng.choice([-60, 0, 60])
                tracks.append((g, f, t + 1, px, py, px, py, px, py, None if t == 3 else t % 2, None))
    return frames, tracks


def streamed(spark, tmp_path, rows, schema, seed, name, jitter=1.5, parts=6):
    """Rows in files that come one after another; within `jitter` seconds they are out of order. Frames last a thirtieth of a second."""
    rng = random.Random(seed)
    order = sorted((r for r in rows if r[0] != CLOCK), key=lambda r: r[1] / 30 + rng.random() * jitter)
    size = -(-len(order) // parts)
    files = [order[k * size : (k + 1) * size] for k in range(parts)] + [[r] for r in rows if r[0] == CLOCK]
    for k, part in enumerate(files):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.expr("timestamp_micros(1000000000000000 + frame_id * 1000000 div 30)"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/part={k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/{name}/*").withWatermark("ts", "2 seconds")


def run(found, tmp_path, name):
    q = found.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return q


def clock(frames_of, last=9000):
    """Frames of another game, far ahead in time."""
    return [(CLOCK, last + k, *frames_of) for k in range(3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_late_and_shuffled_stream_gives_what_the_plans_give(rocks, tmp_path, seed):
    spark = rocks
    frames, tracks = games(seed)
    e = Engine(spark, CONFIG, fr=spark.createDataFrame(frames, FRAME), tr=spark.createDataFrame(tracks, TRACK))
    near = {(r["game_id"], r["frame_id"]): r for r in with_nearest(e.inputs["fr"].withColumn("ts", F.lit(0)), e.inputs["tr"].withColumn("ts", F.lit(0)), CONFIG).collect()}
    rows = [(*f, near[f[0], f[1]]["who"] if (f[0], f[1]) in near else None, near[f[0], f[1]]["team"] if (f[0], f[1]) in near else None) for f in frames]
    rows += clock((None, None, None, None, None, False, None, None))
    found = live_detections(streamed(spark, tmp_path, rows, FRAME + ", who long, team int", seed, "frames"), CONFIG)
    q = run(found, tmp_path, f"found{seed}")
    got = [r for r in spark.table(f"found{seed}").collect() if r["game_id"] != CLOCK]
    of = lambda kind, *cols: sorted(tuple(r[c] for c in ("game_id", "frame_id", *cols)) for r in got if r["kind"] == kind)
    plain = lambda df, *cols: sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert of("shot_attempt", "n", "size") == plain(e.shot_attempts(), "game_id", "frame_id", "rising_frames", "arc_height")
    assert of("score") == plain(e.cooldown(), "game_id", "frame_id")
    assert of("pass", "track", "other", "n") == plain(e.passes(), "game_id", "frame_id", "sender", "receiver", "flight")
    assert of("turnover", "track", "other") == plain(e.turnovers(), "game_id", "frame_id", "loser", "winner")
    assert of("dead_segment", "start_frame", "seg", "reason") == plain(e.dead_segments(), "game_id", "end_frame", "start_frame", "seg", "reason")
    turns, dead = [], {}
    for r in sorted(e.dead_state().collect(), key=lambda r: (r["game_id"], r["frame_id"])):
        if r["dead"] != dead.get(r["game_id"], False):
            turns.append((r["game_id"], r["frame_id"], "dead_ball" if r["dead"] else "live_ball"))
        dead[r["game_id"]] = r["dead"]
    turns += [(g, 260, "live_ball") for g, d in dead.items() if d]  # ended with the game
    assert sorted((r["game_id"], r["frame_id"], r["kind"]) for r in got if r["kind"] in ("dead_ball", "live_ball")) == sorted(turns)
    assert {"shot_attempt", "score", "pass", "turnover", "dead_segment", "dead_ball"} <= {r["kind"] for r in got}
    # the games that ended hold no state any more: what is left is the clock's
    left = spark.read.format("statestore").option("path", f"{tmp_path}/cp_found{seed}").option("stateVarName", "machines").load()
    assert {r["key"]["game_id"] for r in left.collect()} <= {CLOCK} and q.lastProgress is not None


def test_the_nearest_player_of_streams(rocks, tmp_path):
    spark = rocks
    frames, tracks = games(7, n_games=2, n=90)
    want = with_nearest(spark.createDataFrame(frames, FRAME).withColumn("ts", F.lit(0)), spark.createDataFrame(tracks, TRACK).withColumn("ts", F.lit(0)), CONFIG)
    want = sorted((r["game_id"], r["frame_id"], r["who"] or 0, -5 if r["team"] is None else r["team"]) for r in want.collect())
    left = streamed(spark, tmp_path, frames + clock((None,) * 6), FRAME, 3, "f")
    right = streamed(spark, tmp_path, tracks + clock((9, *(0,) * 6, None, None)), TRACK, 4, "t")
    run(with_nearest(left, right, CONFIG), tmp_path, "near")
    got = sorted((r["game_id"], r["frame_id"], r["who"] or 0, -5 if r["team"] is None else r["team"]) for r in spark.table("near").collect() if r["game_id"] != CLOCK)
    assert got == want


def test_machines_go_on_from_what_they_saved():
    frames, _ = games(11, n_games=1)
    names = ("game_id", "frame_id", "ball_x", "ball_y", "rim_x", "rim_y", "conf", "scored")
    rows = [dict(zip(names, f, strict=True)) | {"who": f[1] // 5 % 3, "team": 0, "ms": 0} for f in frames]
    whole, cut, found, parts = Detectors(CONFIG), Detectors(CONFIG), [], []
    for f in rows:
        found += whole.step(f)
        parts += cut.step(f)
        cut = Detectors(CONFIG, state=cut.saved())
        parts += cut.step(f)  # once more: passed over
    assert found == parts and list(whole.end()) == list(cut.end()) and len(found) > 10
