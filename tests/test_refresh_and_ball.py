"""Totals kept up batch by batch, and the choice of a ball among candidates."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from test_traces import EVENT

from rimflow.operators import refresh
from rimflow.operators.tracking import track_ball

KINDS = ["score_2pt", "score_3pt", "free_throw_made", "shot_miss", "assist", "steal", "block", "turnover", "rebound_off", "foul", "pass"]


def events(rng, games, n):
    return [(rng.choice(games), i, i, rng.choice(KINDS), rng.randint(1, 9), None, rng.choice([0, 1, None]), None, None, None, 0, 0, None, False, False) for i in range(n)]


def rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def test_a_refresh_equals_a_full_recomputation_and_touches_its_buckets(spark, tmp_path):
    rng, path = random.Random(3), f"file://{tmp_path}/sums"
    assert refresh.team_sums(spark, path).count() == 0
    batches = [events(rng, games, 200) for games in (range(30), [3, 4], [4, 50])]
    for k, part in enumerate(batches):
        df = spark.createDataFrame(part, EVENT)
        files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("sums/bucket=*/*.parquet")}
        touched = refresh.apply_batch(df, k, path)
        if k:
            assert len(touched) <= 2 and all(p.stat().st_mtime_ns == t for p, t in files.items() if p.exists() and int(p.parent.name.split("=")[1]) not in touched)
            assert {int(p.parent.name.split("=")[1]) for p in files if not p.exists()} <= set(touched)
        assert refresh.apply_batch(df, k, path) == []  # the same batch again
        whole = spark.createDataFrame([e for b in batches[: k + 1] for e in b], EVENT)
        want = refresh._merged(refresh.partial_sums(whole), "game_id", "team")
        assert rows(refresh.team_sums(spark, path)) == rows(want)
    assert rows(refresh.team_sums(spark, path, 4)) == [r for r in rows(want) if r[0] == 4]
    assert "bucket" in refresh.team_sums(spark, path, 4)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    assert refresh.apply_batch(spark.createDataFrame([], EVENT), 9, path) == []


def ball(*frames):
    return pd.DataFrame([(1, f, x, y, c) for f, cands in enumerate(frames) for x, y, c in (cands or [(np.nan, np.nan, np.nan)])], columns=["game_id", "frame_id", "ball_x", "ball_y", "conf"])


def test_the_near_candidate_wins_by_the_blend():
    """A ball that moves by 10 px a frame; then one candidate where it is expected and a surer one 140 px off."""
    line = [[(100.0 + 10 * k, 50.0, 0.5)] for k in range(5)]
    got = track_ball(ball(*line, [(150.0, 50.0, 0.2), (290.0, 50.0, 0.3)]))
    assert abs(got["x"].iloc[-1] - 150) < 5
    far = track_ball(ball(*line, [(900.0, 50.0, 0.3)]))
    assert far["frames_lost"].iloc[-1] == 1 and abs(far["x"].iloc[-1] - 150) < 8  # outside the gate and not sure
    assert track_ball(ball(*line, [(900.0, 50.0, 0.4)]))["frames_lost"].iloc[-1] == 0


def test_gating_begins_with_two_points_and_ends_after_fifteen_frames():
    got = track_ball(ball([(100.0, 50.0, 0.5)], [(110.0, 50.0, 0.1), (800.0, 50.0, 0.3)]))
    assert got["x"].iloc[-1] > 300  # one point of history: the surer one
    line = [[(100.0 + 10 * k, 50.0, 0.5)] for k in range(5)]
    lost = track_ball(ball(*line, *[None] * 18, [(900.0, 50.0, 0.1)]))
    assert list(lost["frame_id"]) == [*range(21), 23] and lost["x"].iloc[-1] == 900.0
