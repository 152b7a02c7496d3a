"""Joins by cells and buckets against loops, their plans, and lead changes against a loop."""

from __future__ import annotations

import random

from test_traces import EVENT, FRAME, TRACK

from rimflow.config import EngineConfig
from rimflow.engine import Engine


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ten_thousand_zones_equal_a_loop(spark):
    rng = random.Random(4)
    zones = []
    for k in range(10_000):
        x, y = rng.randint(-100, 2000), rng.randint(-100, 1200)
        zones.append((k, f"z{k}", x, y, x + rng.randint(0, 90), y + rng.randint(0, 90), rng.choice([None, None, 1, 2])))
    tracks = [(g, f, 1, x := rng.randint(-120, 2000), y := rng.randint(-120, 1200), x, y, x, y, 0, None) for g in (1, 2, 3) for f in range(60)]
    e = Engine(
        spark, EngineConfig(zone_margin=3), tr=spark.createDataFrame(tracks, TRACK),
        zo=spark.createDataFrame(zones, "k int, name string, x1 int, y1 int, x2 int, y2 int, game_id long"),
    )
    found = e.zone_lookup()
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    want = {}
    for g, f, _, x, y, *_ in tracks:
        hits = [((x2 - x1) * (y2 - y1), k, name) for k, name, x1, y1, x2, y2, own in zones if own in (None, g) and x1 - 3 <= x <= x2 + 3 and y1 - 3 <= y <= y2 + 3]
        if hits:
            want[g, f] = (min(hits)[2], len(hits))
    assert {(r["game_id"], r["frame_id"]): (r["zone"], r["zones"]) for r in found.collect()} == want and len(want) > 60


def test_a_game_may_have_a_polygon_of_its_own(spark):
    square = [(0, 0, 0, None), (1, 100, 0, None), (2, 100, 100, None), (3, 0, 100, None)]
    own = [(0, 200, 200, 2), (1, 300, 200, 2), (2, 250, 300, 2)]
    tracks = [(g, k, 1, x, y, x, y, x, y, 0, None) for g in (1, 2) for k, (x, y) in enumerate([(50, 50), (250, 240), (150, 150)])]
    e = Engine(spark, tr=spark.createDataFrame(tracks, TRACK), po=spark.createDataFrame(square + own, "k int, x int, y int, game_id long"))
    assert {(r["game_id"], r["cx"]): r["inside"] for r in e.point_in_poly().collect()} == {(1, 50): True, (1, 250): False, (1, 150): False, (2, 50): False, (2, 250): True, (2, 150): False}
    plain = Engine(spark, tr=spark.createDataFrame(tracks, TRACK), po=spark.createDataFrame([s[:3] for s in square], "k int, x int, y int"))
    assert [r["inside"] for r in plain.point_in_poly().orderBy("game_id", "cx").collect()] == [True, False, False] * 2


def test_frames_of_overlapping_clips(spark):
    rng = random.Random(2)
    events = [(g, i, f, rng.choice(["steal", "pass", "block"]), 1, None, 0, None, None, None, 0, 0, None, False, False) for g in (1, 2) for i, f in enumerate(sorted(rng.sample(range(9000), 90)))]
    frames = [(g, f, 1, 1, 1, 1, 0.5, False) for g in (1, 2) for f in range(0, 9000, 3)]
    e = Engine(spark, EngineConfig(clip_gap=20, clip_margin=150, clip_bucket=64), ge=spark.createDataFrame(events, EVENT), fr=spark.createDataFrame(frames, FRAME))
    clips = e.clip_groups().collect()
    want = sorted((c["game_id"], c["clip"], f, f - c["start_frame"]) for c in clips for g, f, *_ in frames if g == c["game_id"] and c["start_frame"] <= f <= c["end_frame"])
    found = e.clip_frames()
    assert sorted(tuple(r) for r in found.collect()) == want and len({w[::2] for w in want}) < len(want)  # some frames are in two clips
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_lead_changes_equal_a_loop(spark):
    rng = random.Random(6)
    points = {"score_2pt": 2, "score_3pt": 3, "free_throw_made": 1}
    events, want = [], {}
    for g in range(12):
        n = rng.randint(1, 40)
        kinds = ["pass", "steal", *points] if g % 4 else ["pass"]
        mine = [(g, i, i, rng.choice(kinds), 1, None, rng.choice([0, 1, 2, None] if g % 3 else [0, 1]), None, None, None, 0, 0, None, False, False) for i in range(n)]
        events += mine
        teams = sorted({m[6] for m in mine if m[6] is not None})
        if not teams:
            continue
        score, before, changes, largest = dict.fromkeys(teams, 0), None, 0, 0
        for m in mine:
            if m[6] is not None:
                score[m[6]] += points.get(m[3], 0)
            ranked = sorted(teams, key=lambda t: (-score[t], t))
            changes += before is not None and before != ranked[0]
            before = ranked[0]
            if len(teams) > 1:
                largest = max(largest, score[ranked[0]] - score[ranked[1]])
        want[g] = (changes, largest)
    e = Engine(spark, ge=spark.createDataFrame(events, EVENT))
    assert {r["game_id"]: (r["lead_changes"], r["largest_lead"]) for r in e.lead_changes().collect()} == want
