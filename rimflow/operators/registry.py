"""Queries of operators that are more than one plan, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rimflow.sources import adapters

from . import identity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"player_identities": lambda spark, sf_dir: identity.players(adapters.sightings(spark, sf_dir))}


def oracle_sql() -> dict[str, str]:
    return {"player_identities": identity.PLAYERS_SQL.format(sightings=adapters.sightings_sql())}
