"""Raw event documents (one JSON object a row) as game events, and what is wrong with those that are none.

A document has a `type`, a frame (`frame`, else `frame_idx`, else the default), a `player`, `jersey`, `team_id`, `ball_position` [x, y] and
`court_zone`; whatever else it holds goes to `meta`. Values are coerced by try_cast: a number in a string is that number. Nothing is lost:

* an unknown or missing type is `unknown`; a player that is no whole number is no player; a missing jersey is empty;
* text that is no JSON, JSON that is no object, and a frame, team or position that is given and cannot be coerced go to the rejects
  with their reasons, in the order in which they are named here, joined by commas.

Both sides are projections of the same parsed column, so they work on tables and on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimflow.config import EVENT_TYPES

KNOWN = ("type", "frame", "frame_idx", "player", "jersey", "team_id", "ball_position", "court_zone")


def parsed(raw: DataFrame, column: str = "value", default_frame: int = 0) -> DataFrame:
    """raw with the fields of its documents and `reasons`, an array that is empty where the document is an event."""
    doc = raw.withColumn("_doc", F.try_parse_json(F.col(column)))
    doc = doc.withColumn("_is_object", F.expr("coalesce(schema_of_variant(_doc) like 'OBJECT<%', false)"))
    given = lambda c: f"(_is_object and variant_get(_doc, '$.{c}') is not null and schema_of_variant(variant_get(_doc, '$.{c}')) <> 'VOID')"
    # only asked where the document is an object, for a path into anything else is an error
    value = lambda c, kind: f"case when _is_object then try_variant_get(_doc, '$.{c}', '{kind}') end"
    frame = f"case when {given('frame')} then {value('frame', 'bigint')} when {given('frame_idx')} then {value('frame_idx', 'bigint')} else {default_frame} end"
    kind = value("type", "string")
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    doc = doc.selectExpr(
        "*",
        f"case when {kind} in ({types}) then {kind} else 'unknown' end as etype",
        f"{frame} as frame_id",
        f"case when {given('player')} and schema_of_variant(variant_get(_doc, '$.player')) = 'BIGINT' then {value('player', 'bigint')} end as p_track",
        f"coalesce({value('jersey', 'string')}, '') as p_jersey",
        f"cast({value('team_id', 'bigint')} as int) as p_team",
        f"{value('ball_position[0]', 'double')} as ball_x", f"{value('ball_position[1]', 'double')} as ball_y",
        f"{value('court_zone', 'string')} as zone",
        f"case when _is_object then map_filter(try_variant_get(_doc, '$', 'map<string, string>'), (k, v) -> k not in ({', '.join(repr(k) for k in KNOWN)})) end as meta",
    )
    reasons = [
        ("no json", "_doc is null"), ("no object", "_doc is not null and not _is_object"), ("frame", "_is_object and frame_id is null"),
        ("team_id", f"{given('team_id')} and p_team is null"), ("ball_position", f"{given('ball_position')} and (ball_x is null or ball_y is null)"),
    ]
    each = ", ".join(f"case when {test} then '{name}' end" for name, test in reasons)
    return doc.withColumn("reasons", F.expr(f"filter(array({each}), x -> x is not null)")).drop("_doc", "_is_object")


def ingested(raw: DataFrame, column: str = "value", default_frame: int = 0) -> tuple[DataFrame, DataFrame]:
    """The events (the columns of raw but the document, and its fields), and the rejects (the columns of raw and `reasons`)."""
    both = parsed(raw, column, default_frame)
    fields = ["etype", "frame_id", "p_track", "p_jersey", "p_team", "ball_x", "ball_y", "zone", "meta"]
    keep = [c for c in raw.columns if c != column and c not in fields]
    return both.where("size(reasons) = 0").select(*keep, *fields), both.where("size(reasons) > 0").select(*raw.columns, F.array_join("reasons", ",").alias("reasons"))
