"""Teams that are fitted again while features come in."""

from __future__ import annotations

import random

from rimflow.operators.teams import team_clusters
from rimflow.streaming import teams

SCHEMA = "track_id long, frame_id long, feature array<double>"


def test_teams_stay_over_fits_and_equal_the_whole(spark, tmp_path):
    rng, path, rows = random.Random(2), f"file://{tmp_path}/teams", []
    # the smallest track, by which a fit alone would name the teams, comes last and is of the other team
    batches = [range(5, 11), range(5, 13), range(1, 13)]
    fitted, seen = [], []
    for b, tracks in enumerate(batches):
        part = [(t, 100 * b + k, [float(20 * ((t in (1, 3)) ^ (t % 2)) + rng.random()), float(rng.random())]) for t in tracks for k in range(8)]
        part += [(None, 100 * b, [0.0, 0.0]), (99, 100 * b, None)]
        rows += part
        df = spark.createDataFrame(part, SCHEMA)
        fitted.append(teams.take_in(df, b, path, least=40, every=90))
        if b == 1:
            assert teams.take_in(df, b, path, least=40, every=90) == fitted[1]  # the same batch again
        seen.append({r["track"]: r["team"] for r in teams.teams_so_far(spark, path).collect()})
    assert fitted == [True, True, True]
    for a, b in zip(seen, seen[1:], strict=False):
        assert all(b[t] == team for t, team in a.items())
    whole = {r["track"]: (r["team"], r["samples"]) for r in team_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    last = {r["track"]: (r["team"], r["samples"]) for r in teams.teams_so_far(spark, path).collect()}
    assert {t: n for t, (_, n) in last.items()} == {t: n for t, (_, n) in whole.items()}
    flip = whole[5][0] != last[5][0]
    assert all(last[t][0] == (1 - team if flip else team) for t, (team, _) in whole.items())


def test_fits_wait_for_samples_and_frames(spark, tmp_path):
    path = f"file://{tmp_path}/teams"
    rows = lambda f: spark.createDataFrame([(t, f, [float(9 * (t % 2)), 0.0]) for t in range(4) for _ in range(3)], SCHEMA)
    assert [teams.take_in(rows(f), k, path, least=20, every=50) for k, f in enumerate((0, 10, 20, 61))] == [False, True, False, True]
    assert teams.teams_so_far(spark, path).count() == 4
