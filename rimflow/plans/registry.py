"""All plans of the library by name, for given settings."""

from __future__ import annotations

from rimflow.config import EngineConfig

from . import geometry, looks, sequences, stats
from .core import Plan


def plans(config: EngineConfig) -> dict[str, Plan]:
    return stats.plans(config) | geometry.plans(config) | sequences.plans(config) | looks.plans(config)
