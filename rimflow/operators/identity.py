"""Who is who: tracks that carry one team's number at some time are one player, however long the chain of numbers and tracks.

A tracker gives a player a new track whenever it loses them. A sighting of a track with a number ties the track to the pair (team, number)
from that frame on; tracks are tied to one another through the numbers that they share, also over several of them. The player
of a track is the first seen track of those that are tied together, and an alias holds from the frame in which the last link of the
chain was seen: before, the track was a player of its own.

Both are found by propagation over the links, without a graph in one task: in each round every track takes the smallest label of the
tracks with which it shares a number, and then that label's own label (pointer jumping), so chains take logarithmically many rounds.
Rounds are written to the shared folder and end when a checksum of the labels stays the same. A number that very many tracks
carry is one row for each in an aggregation, never a list or a set of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import written

#: Rounds after which the propagation is given up with an error.
MAX_ROUNDS = 200


def sightings_of(events: DataFrame) -> DataFrame:
    """game_id, seq, track, team, jersey: the players of game events, both of an event that has two."""
    roles = [F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("track", "team", "jersey")]) for p in ("p", "s")]
    each = events.select("game_id", "seq", F.explode(F.array(*roles)).alias("r")).select("game_id", "seq", "r.*")
    return each.where("track is not null")


def _checksum(df: DataFrame, *columns: str) -> tuple:
    return df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()


def player_aliases(sightings: DataFrame) -> DataFrame:
    """game_id, track, canonical (the player's first seen track), since_seq (from when on the alias holds), first_seq.

    sightings: game_id, seq, track, team, jersey (null or empty: not read). A null team is a team of its own, as is a null game.
    """
    seen = sightings.select("game_id", F.col("seq").cast("long").alias("seq"), F.col("track").cast("long").alias("track"), "team", F.nullif("jersey", F.lit("")).alias("jersey"))
    tracks = seen.groupBy("game_id", "track").agg(F.min("seq").alias("first_seq"))
    number = F.struct("team", "jersey")  # one column that may hold a null team
    links = seen.where("jersey is not null").groupBy("game_id", "track", number.alias("number")).agg(F.min("seq").alias("seq"))
    links, tracks = written(links, "links"), written(tracks, "tracks")
    same = lambda a, b, *on: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in on))

    labels = tracks.select("game_id", "track", "first_seq", F.struct("first_seq", "track").alias("label"))
    before = None
    for k in range(MAX_ROUNDS):
        mine = links.alias("l").join(labels.alias("t"), same("l", "t", "game_id", "track")).select("l.game_id", "l.track", "l.number", "t.label")
        least = mine.groupBy("game_id", "number").agg(F.min("label").alias("label"))
        near = links.alias("l").join(least.alias("m"), same("l", "m", "game_id", "number")).groupBy("l.game_id", "l.track").agg(F.min("m.label").alias("label"))
        taken = labels.alias("t").join(near.alias("n"), same("t", "n", "game_id", "track"), "left")
        taken = taken.select("t.game_id", "t.track", "t.first_seq", F.least("t.label", F.coalesce("n.label", "t.label")).alias("label"))
        taken = written(taken, f"labels_{k}")
        jumped = taken.alias("t").join(taken.alias("o"), F.expr("t.game_id <=> o.game_id and t.label.track = o.track"))
        labels = written(jumped.select("t.game_id", "t.track", "t.first_seq", F.least("t.label", "o.label").alias("label")), f"jumped_{k}")
        now = _checksum(labels, "game_id", "track", "label")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"labels did not settle in {MAX_ROUNDS} rounds")

    # since: on the way to the canonical track with the earliest latest link, the latest link
    far = 1 << 62
    since = labels.select("game_id", "track", F.when(F.col("label.track") == F.col("track"), F.col("first_seq")).otherwise(F.lit(far)).alias("since_seq"))
    before = None
    for k in range(MAX_ROUNDS):
        reach = links.alias("l").join(since.alias("t"), same("l", "t", "game_id", "track")).groupBy("l.game_id", "l.number").agg(F.min(F.greatest("t.since_seq", "l.seq")).alias("at"))
        near = links.alias("l").join(reach.alias("m"), same("l", "m", "game_id", "number")).groupBy("l.game_id", "l.track").agg(F.min(F.greatest("m.at", "l.seq")).alias("at"))
        taken = since.alias("t").join(near.alias("n"), same("t", "n", "game_id", "track"), "left")
        since = written(taken.select("t.game_id", "t.track", F.least("t.since_seq", F.coalesce("n.at", "t.since_seq")).alias("since_seq")), f"since_{k}")
        now = _checksum(since, "game_id", "track", "since_seq")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"aliases did not settle in {MAX_ROUNDS} rounds")
    both = labels.alias("t").join(since.alias("s"), same("t", "s", "game_id", "track"))
    return both.select("t.game_id", "t.track", F.col("t.label.track").alias("canonical"), "s.since_seq", "t.first_seq")


def resolved(sightings: DataFrame, aliases: DataFrame) -> DataFrame:
    """sightings with `player`: the canonical track where the alias holds already, else the track itself."""
    a = aliases.select(F.col("game_id").alias("_game"), F.col("track").alias("_track"), "canonical", "since_seq")
    joined = sightings.join(a, F.expr("game_id <=> _game and track = _track"), "left")
    return joined.withColumn("player", F.when(F.col("seq") >= F.col("since_seq"), F.col("canonical")).otherwise(F.col("track"))).drop("_game", "_track", "canonical", "since_seq")


def players(sightings: DataFrame) -> DataFrame:
    """game_id, canonical, tracks, numbers (team:number, sorted), sightings, first_seq, merged_seq (when the last of its tracks was known as theirs)."""
    aliases = player_aliases(sightings)
    joined = sightings.alias("v").join(aliases.alias("a"), F.expr("v.game_id <=> a.game_id and v.track = a.track"))
    number = F.when(F.nullif("v.jersey", F.lit("")).isNotNull(), F.concat_ws(":", F.coalesce(F.col("v.team").cast("string"), F.lit("-")), "v.jersey"))
    out = joined.groupBy("a.game_id", "a.canonical").agg(
        F.countDistinct("a.track").alias("tracks"), F.array_join(F.sort_array(F.collect_set(number)), ",").alias("numbers"), F.count("*").alias("sightings"),
        F.min("a.first_seq").alias("first_seq"), F.max("a.since_seq").alias("merged_seq"),
    )
    return out


#: The same over a closure of all ways from track to track.
PLAYERS_SQL = """
with recursive si as materialized ({sightings}), firsts as (select game_id, track, min(seq) as first_seq from si group by all),
links as materialized (select game_id, track, team, jersey, min(seq) as s from si where jersey is not null group by all),
ways as (
  select game_id, track as a, track as b, first_seq as t from firsts
  union
  select w.game_id, w.a, y.track, greatest(w.t, x.s, y.s) from ways w join links x on x.game_id = w.game_id and x.track = w.b join links y on y.game_id = x.game_id and y.team = x.team and y.jersey = x.jersey
), named as (
  select w.game_id, w.b as track, arg_min(w.a, (f.first_seq, w.a)) as canonical from ways w join firsts f on f.game_id = w.game_id and f.track = w.a group by all
), since as (
  select n.game_id, n.track, n.canonical, min(w.t) as since_seq from named n join ways w on w.game_id = n.game_id and w.a = n.canonical and w.b = n.track group by all
)
select s.game_id, s.canonical, count(distinct s.track) as tracks, coalesce(string_agg(distinct v.team || ':' || v.jersey, ',' order by v.team || ':' || v.jersey), '') as numbers,
       count(*) as sightings, min(v.seq) as first_seq, max(s.since_seq) as merged_seq
from since s join si v on v.game_id = s.game_id and v.track = s.track group by s.game_id, s.canonical
"""
