"""Plans as SQL templates over named inputs.

A template names its inputs as <<name>>. On Spark the inputs are DataFrames (whatever scans or views the caller has),
on DuckDB they are sub-selects of the adapters. A few expressions that the two dialects write differently have one
spelling in templates:

    a // b              integer division
    LASTNN[x]           last non-null x (a window follows)
    LAGNN[x]            x of the last earlier row where it is not null (a window follows)
    SORTEDSET[x]        the different values of x, sorted, joined by commas (an aggregate)
    STR                 the string type
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rimflow.sources import adapters

INPUTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ge": (adapters.game_events, "events"),
    "fr": (adapters.frames, "events"),
    "de": (adapters.detections, "lineitem"),
    "tr": (adapters.tracks, "lineitem"),
    "oc": (adapters.readings, "lineitem"),
    "ri": (adapters.rims, "lineitem"),
    "jobs": (lambda s, d: adapters.table(s, d, "orders"), "orders"),
    "emb": (lambda s, d: adapters.table(s, d, "embeddings"), "embeddings"),
    "vec": (adapters.candidates, "embeddings"),
    "sel": (adapters.selected, "embeddings"),
    "ma": (adapters.matched, "lineitem"),
    "px": (adapters.pixels, "lineitem"),
    "ti": (adapters.ticks, "events"),
    "fi": (adapters.files, "events"),
    "ho": (adapters.hoops, "events"),
    "zo": (lambda s, d: s.sql(adapters.zones_sql()), "zones"),
    "po": (lambda s, d: s.sql(adapters.polygon_sql()), "polygon"),
}
_DUCK = {"ge": adapters.game_events_sql, "fr": adapters.frames_sql, "de": adapters.detections_sql, "tr": adapters.tracks_sql, "oc": adapters.readings_sql, "ri": adapters.rims_sql}
_DUCK |= {"px": adapters.pixels_sql, "ti": adapters.ticks_sql, "fi": adapters.files_sql, "vec": adapters.candidates_sql, "sel": adapters.selected_sql, "ma": adapters.matched_sql, "ho": adapters.hoops_sql, "zo": adapters.zones_sql, "po": adapters.polygon_sql}


@dataclass(frozen=True)
class Plan:
    """A query: its template, and another for the oracle where folds are written as recursion there."""

    sql: str
    oracle: str | None = None
    covers: tuple[str, ...] = field(default=())

    def claims(self, *covers: str) -> Plan:
        return Plan(self.sql, self.oracle, covers)


def to_spark(sql: str) -> str:
    sql = sql.replace(" // ", " div ").replace("STR", "string")
    sql = re.sub(r"LASTNN\[(.*?)\]", r"last_value(\1, true)", sql)
    sql = re.sub(r"LAGNN\[(.*?)\]", r"lag(\1) ignore nulls", sql)
    return re.sub(r"SORTEDSET\[(.*?)\]", r"array_join(sort_array(collect_set(\1)), ',')", sql)


def to_duck(sql: str) -> str:
    sql = sql.replace("STR", "varchar")
    sql = re.sub(r"LASTNN\[(.*?)\]", r"last_value(\1 ignore nulls)", sql)
    sql = re.sub(r"LAGNN\[(.*?)\]", r"lag(\1 ignore nulls)", sql)
    return re.sub(r"SORTEDSET\[(.*?)\]", r"string_agg(distinct \1, ',' order by \1)", sql)


def bind(spark: SparkSession, plan: Plan, inputs: dict[str, DataFrame]) -> DataFrame:
    names = set(re.findall(r"<<(\w+)>>", plan.sql))
    text = to_spark(plan.sql).replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"<<(\w+)>>", r"{\1}", text), **{n: inputs[n] for n in names})


def query(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = set(re.findall(r"<<(\w+)>>", plan.sql))
        return bind(spark, plan, {n: INPUTS[n][0](spark, sf_dir) for n in names})

    return run


def oracle(plan: Plan) -> str:
    text = to_duck(plan.oracle or plan.sql)
    return re.sub(r"<<(\w+)>>", lambda m: f"({_DUCK[m[1]]()})" if m[1] in _DUCK else INPUTS[m[1]][1], text)
