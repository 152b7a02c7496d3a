"""Where a model meets the tables: a detector over frames and a reader over crops, batch by batch in the tasks.

The model is the caller's: a function that makes it is called once for each task, and what it makes is called with batches. Frames and
crops are binary columns (as the binaryFile source gives them); nothing of them goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DETECTIONS = "game_id long, frame_id long, class_name string, conf double, x1 double, y1 double, x2 double, y2 double"
READINGS = "game_id long, frame_id long, track long, text string, conf double"

Detector = Callable[[list[bytes]], list[list[tuple[str, float, float, float, float, float]]]]
Reader = Callable[[list[bytes]], list[tuple[str, float] | None]]


def detect(frames: DataFrame, make: Callable[[], Detector], least: float = 0.3) -> DataFrame:
    """Detections (class_name, conf, box) of least confidence or more; frames: game_id, frame_id, image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make()
        for batch in batches:
            found = detector(batch["image"].tolist())
            rows = [(g, f, *d) for g, f, ds in zip(batch["game_id"], batch["frame_id"], found, strict=True) for d in ds if d[1] >= least]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return frames.select("game_id", "frame_id", "image").mapInPandas(run, DETECTIONS)


def read(crops: DataFrame, make: Callable[[], Reader], least_width: int = 25, least_height: int = 50) -> DataFrame:
    """Readings of crops that are large enough; crops: game_id, frame_id, track, width, height, image. A crop without a reading gives no row."""
    large = crops.where(f"width >= {least_width} and height >= {least_height}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for batch in batches:
            found = reader(batch["image"].tolist())
            rows = [(*key, *x) for key, x in zip(batch[["game_id", "frame_id", "track"]].itertuples(index=False), found, strict=True) if x is not None]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READINGS.split(", ")])

    return large.select("game_id", "frame_id", "track", "image").mapInPandas(run, READINGS)
