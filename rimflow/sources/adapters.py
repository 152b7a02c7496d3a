"""Deterministic projections of general tables to the engine's tables, with the same projection as SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rimflow.config import COURT_POLYGON, DEFAULT, ZONES

ETYPES = (
    "score_2pt", "score_3pt", "free_throw_made", "free_throw_miss", "shot_attempt", "shot_miss", "rebound_off", "rebound_def",
    "steal", "turnover", "assist", "pass", "block", "foul", "fast_break",
)
_KINDS = ("click", "view", "purchase", "signup", "error")

_CASE = "case " + " ".join(
    f"when event_type = '{kind}' and k % 3 = {part} then '{ETYPES[3 * i + part]}'" for i, kind in enumerate(_KINDS) for part in range(3)
) + " end"

_GAME = """
select event_id {div} 500 as game_id, event_id as seq, event_id as frame_id, {case} as etype,
       user_id + 1 as p_track, case when user_id % 5 = 0 then null else cast(user_id % 15 as {string}) end as p_jersey,
       cast(user_id % 2 as int) as p_team,
       (user_id + 2 * k + 1) % 150 + 1 as s_track, cast(((user_id + 2 * k + 1) % 150) % 15 as {string}) as s_jersey,
       cast(((user_id + 2 * k + 1) % 150) % 2 as int) as s_team,
       cast((k * 13 + event_id * 7) % 1280 as int) as ball_x, cast((k * 11 + event_id * 5) % 720 as int) as ball_y,
       case when k % 7 = 0 then null when k % 4 = 0 then 'paint' when k % 4 = 1 then 'mid_range' when k % 4 = 2 then 'three_point' else 'backcourt' end as zone,
       {case} = 'score_3pt' or k % 4 = 2 as is_three, k % 5 = 0 as is_dead
from ({source})
"""
_FRAMES = """
select event_id {div} 500 as game_id, event_id as frame_id,
       case when k % 17 = 0 or event_id % 200 between 100 and 119 then null
            else cast(400 + 6 * (event_id % 40) + case when event_id % 200 >= 160 then 5000 else 0 end as int) end as ball_x,
       case when k % 17 = 0 or event_id % 200 between 100 and 119 then null
            else cast(360 - 26 * least(event_id % 40, 10) + 20 * greatest(event_id % 40 - 10, 0) - 12 * greatest(event_id % 40 - 25, 0) as int) end as ball_y,
       640 as rim_x, 180 as rim_y, cast(k % 10 as double) / 10 as conf, k % 29 = 0 as scored
from ({source})
"""
_DETECTIONS = """
select l_orderkey {div} 500 as game_id, l_orderkey as frame_id, l_partkey as k1, l_suppkey as k2, l_linenumber as k3,
       case l_linenumber % 3 when 0 then 'ball' when 1 then 'player' else 'rim' end as class_name, cast(l_linenumber % 3 as int) as class_id,
       cast(round(l_discount * 100) as int) * 10 as conf,
       cast(l_partkey % 1200 as int) as x1, cast((l_suppkey * 7) % 600 as int) as y1,
       cast(l_partkey % 1200 + 20 + l_quantity as int) as x2, cast((l_suppkey * 7) % 600 + 40 + 2 * l_quantity as int) as y2
from ({source})
"""
#: Tracks follow the detections with odd line numbers, a few pixels off, as filtered positions are.
_TRACKS = """
select game_id, frame_id, k2 % 4 + 1 as track_id, cast((x1 + x2) {div} 2 as int) as cx, cast((y1 + y2) {div} 2 as int) as cy, x1, y1, x2, y2,
       cast(k2 % 2 as int) as team_id, case when k1 % 3 = 0 then null else cast(k1 % 15 as {string}) end as jersey
from (select game_id, frame_id, k1, k2, cast(x1 + k1 % 31 - 15 as int) as x1, cast(y1 + k2 % 23 - 11 as int) as y1, cast(x2 + k1 % 31 - 15 as int) as x2, cast(y2 + k2 % 23 - 11 as int) as y2
      from ({source}) d0 where k3 % 2 = 1) d
"""

_READINGS = """
select game_id, frame_id, k1 % 40 as track, cast(case when k2 % 4 = 0 then k3 % 2 else k1 % 2 end as {string}) as number, concat('#', cast(k2 * 7 as {string})) as text, conf, k1 * 10000 + k2 * 10 + k3 as o from ({source}) d
"""
_RIMS = """
select game_id, frame_id, frame_id * 100000000 + k1 * 10000 + k2 * 10 + k3 as o, conf, x1, y1, x2, y2 from ({source}) d where class_name = 'rim'
"""
_HOOPS = """
select game_id, side, x, y, radius from (select distinct event_id {div} 500 as game_id from {source}) g
     cross join (values ('left', 480, 180, 25), ('right', 1180, 190, 25)) as h(side, x, y, radius)
"""
#: Who was seen, now and then with a number that is not always the same.
_SIGHTINGS = """
select event_id {div} 500 as game_id, event_id as seq, user_id + 1 as track, cast(user_id % 2 as int) as team,
       case when k % 6 = 0 then cast((user_id * 7 + k) % 97 as {string}) end as jersey
from ({source})
"""


def _sql(text: str, duck: bool, **sources: str) -> str:
    words = {"div": "//", "string": "varchar"} if duck else {"div": "div", "string": "string"}
    return text.format(case=_CASE, **words, **sources)


def _parsed(events: str, duck: bool) -> str:
    k = "cast(json_extract_string(props, '$.k') as bigint)" if duck else "cast(get_json_object(props, '$.k') as bigint)"
    return f"select event_id, event_type, user_id, {k} as k from {events}"


def game_events_sql(events: str = "events", duck: bool = True) -> str:
    return _sql(_GAME, duck, source=_parsed(events, duck))


def frames_sql(events: str = "events", duck: bool = True) -> str:
    return _sql(_FRAMES, duck, source=_parsed(events, duck))


def detections_sql(lineitem: str = "lineitem", duck: bool = True) -> str:
    return _sql(_DETECTIONS, duck, source=f"select * from {lineitem}")


def tracks_sql(lineitem: str = "lineitem", duck: bool = True) -> str:
    return _sql(_TRACKS, duck, source=detections_sql(lineitem, duck))


def readings_sql(lineitem: str = "lineitem", duck: bool = True) -> str:
    return _sql(_READINGS, duck, source=detections_sql(lineitem, duck))


def rims_sql(lineitem: str = "lineitem", duck: bool = True) -> str:
    return _sql(_RIMS, duck, source=detections_sql(lineitem, duck))


def hoops_sql(events: str = "events", duck: bool = True) -> str:
    return _sql(_HOOPS, duck, source=events)


def sightings_sql(events: str = "events", duck: bool = True) -> str:
    return _sql(_SIGHTINGS, duck, source=_parsed(events, duck))


def matched_sql(lineitem: str = "lineitem", duck: bool = True) -> str:
    return f"select game_id, frame_id, track_id as ref, cx, cy from ({tracks_sql(lineitem, duck)}) m"


def pixels_sql(lineitem: str = "lineitem", duck: bool = True) -> str:
    """One pixel for each detection: hue 0..179, saturation and brightness 0..255."""
    return f"select game_id, game_id as frame_id, k2 % 4 + 1 as track_id, k1 % 180 as h, (k2 * 37 + k3) % 256 as s, k1 * 7 % 256 as v from ({detections_sql(lineitem, duck)}) d"


def ticks_sql(events: str = "events", duck: bool = True) -> str:
    return f"select event_id {'//' if duck else 'div'} 500 as game_id, event_id as frame_id, {'epoch_us(ts)' if duck else 'unix_micros(cast(ts as timestamp))'} as us from {events}"


def files_sql(events: str = "events", duck: bool = True) -> str:
    name = "case event_id % 6 when 0 then '.MP4' when 1 then '.mov' when 2 then '.txt' when 3 then '' when 4 then '.tar.avi' else 'mp4' end"
    return f"select concat('game', cast(event_id as {'varchar' if duck else 'string'}), {name}) as name, event_type as base, ts as made from {events}"


def candidates_sql(embeddings: str = "embeddings", duck: bool = True) -> str:
    return f"select vec_id % 4 as game_id, vec_id, embedding from {embeddings} where vec_id >= 32"


def selected_sql(embeddings: str = "embeddings", duck: bool = True) -> str:
    return f"select vec_id % 4 as game_id, vec_id, embedding from {embeddings} where vec_id < 32"


def zones_sql(zones: dict = ZONES, width: int = DEFAULT.frame_width, height: int = DEFAULT.frame_height) -> str:
    """The zones of a frame as a table (k, name, x1, y1, x2, y2, game_id); k is their order of precedence, a null game stands for all."""
    rows = ", ".join(f"({k}, '{name}', {int(a * width)}, {int(b * height)}, {int(c * width)}, {int(d * height)})" for k, (name, (a, b, c, d)) in enumerate(zones.items()))
    return f"select *, cast(null as bigint) as game_id from (values {rows}) as v(k, name, x1, y1, x2, y2)"


def polygon_sql(points: tuple = COURT_POLYGON) -> str:
    """The vertices of a polygon as a table (k, x, y, game_id); a null game stands for those without a polygon of their own."""
    return "select *, cast(null as bigint) as game_id from (values " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(points)) + ") as v(k, x, y)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, sql) -> DataFrame:
    return spark.sql(sql("{t}", False), t=table(spark, sf_dir, name))


def game_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", game_events_sql)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", frames_sql)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", detections_sql)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", tracks_sql)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", readings_sql)


def rims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", rims_sql)


def hoops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", hoops_sql)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", candidates_sql)


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", selected_sql)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", sightings_sql)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", matched_sql)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", pixels_sql)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", ticks_sql)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", files_sql)
