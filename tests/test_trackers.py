"""Trackers of many games side by side against plain loops over one game, and their time on many games."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from rimflow.operators import tracking
from rimflow.operators.tracking import assign, ball_tracks, track_objects

#: Seconds that either tracker may take on many games; the tests say what was measured.
LIMIT = 20
DETECTION = "game_id long, frame_id long, k1 long, k2 long, k3 int, conf int, x1 int, y1 int, x2 int, y2 int"


class Filter:
    """The filter in matrices."""

    def __init__(self, x, y):
        self.x, self.p = np.array([x, y, 0.0, 0.0]), np.eye(4)
        self.f, self.h = np.eye(4) + np.eye(4, k=2), np.eye(2, 4)

    def predict(self):
        self.x, self.p = self.f @ self.x, self.f @ self.p @ self.f.T + np.eye(4) * 0.01
        return self.x[:2]

    def correct(self, x, y):
        gain = self.p @ self.h.T @ np.linalg.inv(self.h @ self.p @ self.h.T + np.eye(2) * 0.1)
        self.x, self.p = self.x + gain @ (np.array([x, y]) - self.h @ self.x), (np.eye(4) - gain @ self.h) @ self.p


def overlap(a, b):
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / (area(a) + area(b) - inter)


def plain_objects(rows):
    """rows of one game: frame_id, k1, k2, k3, conf, x1, y1, x2, y2."""
    tracks, born, out = [], 0, []
    for frame in sorted({r[0] for r in rows}):
        boxes = []
        for r in sorted((r for r in rows if r[0] == frame), key=lambda r: (-r[4], *r[1:4])):
            if all(overlap(r[5:], b) <= 0.45 for b in boxes):
                boxes.append(r[5:])
        centers = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b in boxes]
        free = list(range(len(boxes)))
        for t in tracks:
            t["seen"] = False
        for sure in (True, False):
            some = [t for t in tracks if not t["seen"] and (t["state"] == "confirmed" or not sure)]
            if not some or not free:
                continue
            cost = [[1 - overlap(t["box"], boxes[d]) if sure else np.hypot(*(t["at"].x[:2] - centers[d])) for d in free] for t in some]
            found = assign(np.array(cost), 0.7 if sure else 120.0)
            for i, j in found:
                some[i] |= {"seen": True, "box": boxes[free[j]], "new": centers[free[j]]}
            free = [d for k, d in enumerate(free) if k not in {j for _, j in found}]
        for t in tracks:
            t["at"].predict()
            if t["seen"]:
                t["at"].correct(*t["new"])
                t |= {"hits": t["hits"] + 1, "lost": 0}
                t["state"] = "confirmed" if t["hits"] >= 3 else t["state"]
            else:
                t |= {"lost": t["lost"] + 1, "state": "lost" if t["state"] == "confirmed" else t["state"]}
        for d in free:
            born += 1
            tracks.append({"number": born, "at": Filter(*centers[d]), "box": boxes[d], "hits": 1, "lost": 0, "state": "tentative", "seen": True})
        tracks = [t for t in tracks if t["lost"] < 30]
        out += [(frame, t["number"], t["state"], *map(float, t["box"])) for t in tracks if t["seen"]]
    return out


def games(seed, frames):
    """Games of other lengths and crowds, with gaps, boxes over each other and one game without an id."""
    rng, rows = np.random.default_rng(seed), []
    for game in [0, None, 3, 4, 7]:
        spread = int(rng.integers(100, 900))
        for f in np.flatnonzero(rng.random(int(rng.integers(1, frames))) < 0.9).tolist():
            for k in range(int(rng.integers(1, 6))):
                x, y = (int(v) for v in rng.integers(0, spread, 2))
                rows.append((game, f, k, 0, 0, int(rng.integers(0, 10)) * 10, x, y, x + int(rng.integers(20, 90)), y + int(rng.integers(40, 140))))
    return rows


@pytest.mark.parametrize(("seed", "chunk"), [(1, 300_000), (2, 40), (3, 7), (4, 1)])
def test_objects_of_many_games_equal_plain_loops(seed, chunk, monkeypatch):
    monkeypatch.setattr(tracking, "CHUNK_ROWS", chunk)  # games and frames go on from chunk to chunk
    rows = games(seed, 90)
    df = pd.DataFrame(rows, columns=[x.split()[0] for x in DETECTION.split(", ")]).astype({"game_id": "Int64"})
    by = df.sort_values(["game_id", "frame_id", "conf", "k1", "k2", "k3"], ascending=[True, True, False, True, True, True], na_position="first")
    table = tracking.pa.Table.from_pandas(by[["game_id", "frame_id", "x1", "y1", "x2", "y2"]], preserve_index=False)
    run = tracking._tracker(tracking.TrackerSettings())(iter(table.to_batches(13)))
    got = [tuple(r.values()) for batch in run for r in batch.to_pylist()]
    want = [(g, *r) for g in [None, 0, 3, 4, 7] for r in plain_objects([r[1:] for r in rows if r[0] == g])]
    assert got == want


def test_objects_by_spark_keep_games_whole_and_take_little_time(spark):
    """15,240 frames with three boxes each: one game after the other took 54 s on 4 cores, all games of a chunk at once 4 s."""
    some = [[r[1:] for r in games(seed, 150) if r[0] == 7] for seed in range(5)]
    rows = [(g, *r) for g in range(200) for r in some[g % 5]]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=[x.split()[0] for x in DETECTION.split(", ")]), DETECTION)
    assert track_objects(df.limit(10)).count() > 0  # workers start
    began = time.time()
    got = track_objects(df.repartition(7)).toPandas()
    took = time.time() - began
    for g in (0, 1, 197):
        assert sorted(got[got["game_id"] == g].drop(columns="game_id").itertuples(index=False, name=None)) == sorted(plain_objects([r[1:] for r in rows if r[0] == g]))
    assert took < LIMIT, took


def plain_ball(rows):
    """rows of one game: frame_id, ball_x, ball_y, conf."""
    ball, lost, points, out = None, 0, 0, []
    for frame in sorted({r[0] for r in rows}):
        seen = sorted(((x, y, c) for f, x, y, c in rows if f == frame and x is not None and y is not None), key=lambda s: (s[2] is None, -(s[2] or 0), s[0]))
        if ball:
            ball.predict()
            if points >= 2:
                away = lambda s: np.hypot(*(s[:2] - ball.x[:2]))  # noqa: E731, B023
                near = [s for s in seen if away(s) <= 160]
                blend = lambda s: (s[2] is None, -0.7 * (1 - away(s) / 160) - 0.3 * (s[2] or 0))  # noqa: E731, B023
                seen = [min(near, key=blend)] if near else [s for s in seen if s[2] is not None and s[2] >= 0.35]
        lost = 0 if seen else lost + 1
        if seen and ball:
            ball.correct(*seen[0][:2])
        elif seen:
            ball = Filter(*seen[0][:2])
        if ball:
            points += 1
            out.append((frame, *ball.x[:2], np.hypot(*ball.x[2:]), lost))
        if lost > 15:
            ball = None
    return out


BALL = "game_id long, frame_id long, ball_x int, ball_y int, conf double"


def ball_games(seed, frames):
    """Games with none to four candidates a frame, some without a confidence; balls that fly, leap and are gone for a while; one game without an id."""
    rng, rows = np.random.default_rng(seed), []
    for game in [0, None, 3, 4, 7]:
        x, y = rng.integers(0, 1200, 2)
        for f in np.flatnonzero(rng.random(int(rng.integers(20, frames))) < 0.9).tolist():
            x, y = (x + 9, y + 4) if rng.random() < 0.95 else rng.integers(0, 1200, 2)
            n = 0 if f % 60 >= 41 else int(rng.integers(0, 5))
            rows += [(game, f, None, 5, 0.9)] * (n == 0)
            for k in range(n):
                dx, dy = rng.integers(-300, 300, 2) if k else (0, 0)
                rows.append((game, f, int(x + dx), int(y + dy), None if rng.random() < 0.05 else int(rng.integers(0, 100)) / 100))
    return rows


@pytest.mark.parametrize(("seed", "chunk"), [(1, 300_000), (2, 40), (3, 7), (4, 1)])
def test_balls_of_many_games_equal_plain_loops(spark, seed, chunk, monkeypatch):
    rows = ball_games(seed, 200)
    want = [(g, *r) for g in [0, 3, 4, 7, None] for r in plain_ball([r[1:] for r in rows if r[0] == g])]
    assert {r[-1] for r in want} >= {0, 15}
    near = lambda got: [r[:2] + r[5:] for r in got] == [r[:2] + r[5:] for r in want] and np.allclose([r[2:5] for r in got], [r[2:5] for r in want])
    if seed == 1:
        assert near(sorted(map(tuple, ball_tracks(spark.createDataFrame(rows, BALL)).collect()), key=lambda r: (r[0] is None, r[:2])))
    monkeypatch.setattr(tracking, "CHUNK_ROWS", chunk)  # games and frames go on from chunk to chunk
    by = pd.DataFrame(rows, columns=[x.split()[0] for x in BALL.split(", ")]).astype({"game_id": "Int64"})
    by = by.sort_values(["game_id", "frame_id", "conf", "ball_x", "ball_y"], ascending=[True, True, False, True, True])
    run = tracking._ball_tracker()(iter(tracking.pa.Table.from_pandas(by, preserve_index=False).to_batches(13)))
    assert near([tuple(r.values()) for batch in run for r in batch.to_pylist()])


def test_balls_of_many_games_take_little_time(spark):
    """22,360 frames: a data frame sorted for each took 102 s, one step for all games of a chunk 3 s."""
    some = [[r[1:] for r in ball_games(seed, 300) if r[0] == 7] for seed in range(3)]
    rows = [(g, *r) for g in range(120) for r in some[g % 3] if r[3] is not None]
    df = spark.createDataFrame(rows, BALL)
    assert ball_tracks(df.limit(10)).count() > 0  # workers start
    began = time.time()
    got = ball_tracks(df.repartition(7)).toPandas()
    took = time.time() - began
    for g in (0, 1, 119):
        want = plain_ball([r[1:] for r in rows if r[0] == g])
        one = got[got["game_id"] == g].drop(columns="game_id").sort_values("frame_id")
        assert one["frame_id"].tolist() == [r[0] for r in want] and np.allclose(one.to_numpy(float), np.array(want, float))
    assert took < LIMIT, took
