"""Players over chains of tracks and numbers, against a loop over the sightings."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rimflow.operators import identity, registry

SEEN = "game_id long, seq long, track long, team int, jersey string"


def loop(rows):
    """Groups of tracks are united when a sighting shows a number that another group has; who was united with whom, and when."""
    want = {}
    for g in {r[0] for r in rows}:
        first, group, owner, joined = {}, {}, {}, {}
        for _, s, t, team, jersey in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if t not in first:
                first[t], group[t], joined[t] = s, {t}, {t: s}
            if not jersey:
                continue
            a, b = group.get(owner.setdefault((team, jersey), t)), group[t]
            if a is not b:
                for x in a:
                    for y in b:
                        joined[x][y] = joined[y][x] = s
                a |= b
                for y in b:
                    group[y] = a
        for t in first:
            c = min(group[t], key=lambda u: (first[u], u))
            want[g, t] = (c, joined[t][c], first[t])
    return want


def aliases(spark, rows):
    return {(r["game_id"], r["track"]): (r["canonical"], r["since_seq"], r["first_seq"]) for r in identity.player_aliases(spark.createDataFrame(rows, SEEN)).collect()}


def test_chains_late_numbers_and_two_teams_with_one_number(spark):
    rows = [
        (1, 1, 5, 0, "23"), (1, 2, 8, 0, None), (1, 3, 8, 0, "23"),  # 8 is 5 from 3 on
        (1, 4, 9, 0, "30"), (1, 6, 8, 0, "30"), (1, 7, 11, 0, "30"),  # 8 is misread as 30, which ties 9, and 11 by way of it
        (1, 5, 20, 1, "23"), (1, 8, 30, None, "23"), (1, 9, 31, None, "23"), (1, 10, 40, 0, ""), (None, 1, 5, 0, "23"), (None, 2, 6, 0, "23"),
    ]
    got = aliases(spark, rows)
    assert {t: got[1, t][:2] for t in (5, 8, 9, 11, 20, 30, 31, 40)} == {5: (5, 1), 8: (5, 3), 9: (5, 6), 11: (5, 7), 20: (20, 5), 30: (30, 8), 31: (30, 9), 40: (40, 10)}
    assert got[None, 6] == (5, 2, 2)
    seen = spark.createDataFrame(rows, SEEN)
    at = {(r["game_id"], r["seq"]): r["player"] for r in identity.resolved(seen, identity.player_aliases(seen)).collect()}
    assert (at[1, 2], at[1, 3], at[1, 4], at[1, 7]) == (8, 5, 9, 5)  # an alias holds from its link on


@pytest.mark.parametrize("seed", [1, 2])
def test_aliases_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(g, s, rng.randint(1, 60), rng.choice([0, 1]), rng.choice([None, "", *[str(x) for x in range(20)]])) for g in range(2) for s in range(90)]
    assert aliases(spark, rows) == loop(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(identity, "MAX_ROUNDS", 40)
    rows = [r for i in range(30) for r in ((1, 2 * i, i, 0, str(i)), (1, 2 * i + 1, i, 0, str(i + 1)))]
    assert aliases(spark, rows) == loop(rows)


def test_events_name_both_players(spark):
    events = spark.createDataFrame([(1, 1, 3, 0, "7", 4, 1, None), (1, 2, None, None, None, 4, 1, "9")], "game_id long, seq long, p_track long, p_team int, p_jersey string, s_track long, s_team int, s_jersey string")
    assert sorted(tuple(r) for r in identity.sightings_of(events).select("seq", "track", F.coalesce("jersey", F.lit("-"))).collect()) == [(1, 3, "7"), (1, 4, "-"), (2, 4, "9")]


def test_player_identities_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    got = registry.queries()["player_identities"](spark, sf)
    want = con.sql(registry.oracle_sql()["player_identities"])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall()) and max(r[want.columns.index("tracks")] for r in rows) >= 3
