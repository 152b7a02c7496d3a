"""Raw documents with their rejects, and live reels against the plan."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_live_detectors import CLOCK, FRAME, rocks, run, streamed  # noqa: F401

from rimflow.config import EngineConfig
from rimflow.engine import Engine
from rimflow.sources.ingest import ingested
from rimflow.streaming.reels import live_reels

DOCS = {
    1: '{"type": "steal", "frame": 7, "player": 3, "jersey": "23", "team_id": 1, "ball_position": [10, 20.5], "court_zone": "paint", "note": "x", "n": 2}',
    2: '{"type": "dance", "frame_idx": "12", "player": "3", "team_id": "0"}',
    3: '{"frame": null}',
    4: '{"type": "pass", "frame": "soon", "team_id": "home", "ball_position": [1]}',
    5: '{"type": "pass", ',
    6: "[1, 2]", 7: "3", 8: None, 9: "", 10: "{}", 11: '{"type": "block", "frame": 3.0, "ball_position": null, "player": 1.5}', 12: '{"type": ["pass"], "frame": 1, "meta": {"a": [1]}}',
}


def test_every_document_is_an_event_or_a_reject(spark):
    raw = spark.createDataFrame([(k, 1, v) for k, v in DOCS.items()], "seq long, game_id long, value string")
    good, bad = ingested(raw)
    events = {r["seq"]: r.asDict() for r in good.collect()}
    assert {r["seq"]: r["reasons"] for r in bad.collect()} == {4: "frame,team_id,ball_position", 5: "no json", 6: "no object", 7: "no object", 8: "no json", 9: "no json"}
    assert set(events) == {1, 2, 3, 10, 11, 12}
    assert events[1] == {"seq": 1, "game_id": 1, "etype": "steal", "frame_id": 7, "p_track": 3, "p_jersey": "23", "p_team": 1, "ball_x": 10.0, "ball_y": 20.5, "zone": "paint", "meta": {"note": "x", "n": "2"}}
    of = lambda k, *c: tuple(events[k][x] for x in c)
    assert of(2, "etype", "frame_id", "p_track", "p_jersey", "p_team") == ("unknown", 12, None, "", 0)
    assert of(3, "etype", "frame_id", "p_team", "ball_x") == ("unknown", 0, None, None) == of(10, "etype", "frame_id", "p_team", "ball_x")
    assert of(11, "etype", "frame_id", "p_track", "ball_x") == ("block", 3, None, None) and events[12]["etype"] == "unknown"
    assert ingested(raw, default_frame=5)[0].where("seq = 10").first()["frame_id"] == 5
    assert ingested(raw.limit(0))[0].count() == 0


def test_documents_of_a_stream(spark, tmp_path):
    raw = spark.createDataFrame([(k, 1, v) for k, v in DOCS.items()], "seq long, game_id long, value string")
    raw.repartition(3).write.parquet(f"{tmp_path}/raw")
    good, bad = ingested(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/raw"))
    run(good, tmp_path, "good_docs")
    run(bad, tmp_path, "bad_docs")
    assert spark.table("good_docs").count() == 6 and spark.table("bad_docs").count() == 6


def test_live_reels_equal_the_plan(rocks, tmp_path):  # noqa: F811
    spark, rng = rocks, random.Random(3)
    config = EngineConfig(near_ball=60, reel_lead=9, reel_hold=6)
    sight, event = "game_id long, frame_id long, ref long, cx int, cy int", "game_id long, frame_id long, ball_x int, ball_y int"
    frames = [(g, f, *((None, None) if rng.random() < 0.2 else (rng.randint(0, 400), rng.randint(0, 300))), 0, 0, 0.5, False) for g in range(2) for f in range(300)]
    events = [(g, f, rng.randint(0, 400), rng.randint(0, 300)) for g in range(2) for f in range(300) if rng.random() < 0.1]
    seen = [(g, f, r, rng.randint(0, 400), rng.randint(0, 300)) for g in range(2) for f in range(300) for r in range(3) if rng.random() < 0.5]
    e = Engine(
        spark, config, fr=spark.createDataFrame(frames, FRAME), ma=spark.createDataFrame(seen, sight),
        ge=spark.createDataFrame(events, event),
    )
    want = sorted((r["game_id"], r["ref"], r["start_frame"], r["end_frame"], r["moments"]) for r in e.player_reels().collect())
    later = [(CLOCK, 9000 + k) for k in range(3)]
    streams = [
        streamed(spark, tmp_path, rows + [(*x, *rest) for x in later], schema, k, name)
        for k, (rows, schema, name, rest) in enumerate([(seen, sight, "seen", (1, 0, 0)), (frames, FRAME, "balls", (900, 900, 0, 0, 0.5, False)), (events, event, "events", (900, 900))])
    ]
    run(live_reels(*streams, config=config), tmp_path, "reels")
    got = sorted(tuple(r) for r in spark.table("reels").where(F.col("game_id") != CLOCK).collect())
    assert got == want and len(want) > 6
