"""Synthetic videos of repeated work: frames (video, frame_idx, height, width, pixels) to try the codec on.

Where things are at a frame is column arithmetic; a frame's pixels are drawn by the task that holds its
row. Noise is seeded by the frame, so that any task draws the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of a cycle at rest, and the phases of reaching in, pressing, letting go and leaving.
PAUSE, ENTRY, GRASP, PRESS, LEAVE = 0.15, 0.10, 0.45, 0.70, 0.90
# Colours as blue, green, red.
FLOOR, MACHINE, HAND, TOOL, SKIN, PART, LEADS = (128, 128, 128), (60, 60, 80), (180, 120, 90), (30, 80, 150), (85, 125, 185), (0, 120, 230), (180, 180, 175)


def _drawn(places: DataFrame, height: int, width: int, draw: Callable[[np.ndarray, dict], np.ndarray], plate: np.ndarray) -> DataFrame:
    """(video, frame_idx, height, width, pixels) from places (video, frame_idx, ...), drawn upon a plate of floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.clip(draw(plate.copy(), r), 0, 255).astype(np.uint8).tobytes() for r in batch.to_pylist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("video"), batch.column("frame_idx"), pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32()), pa.array(out, pa.binary())],
                ["video", "frame_idx", "height", "width", "pixels"],
            )

    return places.mapInArrow(run, "video int, frame_idx long, height int, width int, pixels binary")


def _box(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, colour) -> None:
    image[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = colour


def bench(spark: SparkSession, frames: int = 900, cycles: int = 9, height: int = 540, width: int = 960, radius: int = 40) -> DataFrame:
    """A hand that rests, reaches across a floor with a machine and returns, once a cycle; noise while it moves."""
    rng = np.random.default_rng(42)
    plate = np.array(FLOOR, float) + rng.integers(-10, 10, (height, width, 1))
    _box(plate, width // 4, height // 2, width // 4 + 200, height // 2 + 80, MACHINE)
    each = frames // cycles
    phase = (F.col("frame_idx") % each) / each
    moving = (phase - PAUSE) / (1 - PAUSE)
    share = F.when(phase < PAUSE, 0.0).otherwise(0.5 * (1 - F.cos(2 * np.pi * moving)))
    arc = F.when(phase < PAUSE, 0.0).otherwise(0.05 * height * F.sin(4 * np.pi * moving))
    at = spark.range(frames).select(
        F.lit(0).alias("video"), F.col("id").alias("frame_idx")
    ).withColumns({"x": (width * (0.25 + 0.5 * share)).cast("int"), "y": (height * (0.5 - 0.05 * share) + arc).cast("int"), "noise": F.floor(4 * F.least(F.greatest(phase - PAUSE, F.lit(0.0)) / 0.1, F.lit(1.0)))})
    ys, xs = np.mgrid[0:height, 0:width]

    def draw(image: np.ndarray, r: dict) -> np.ndarray:
        image[(xs - r["x"]) ** 2 + (ys - r["y"]) ** 2 <= radius**2] = HAND
        _box(image, r["x"] - 10, r["y"] - 10, r["x"] + 10, r["y"] + 10, TOOL)
        n = r["noise"]
        return image + np.random.default_rng(r["frame_idx"]).integers(-n, n + 1, image.shape) if n else image

    return _drawn(at, height, width, draw, plate)


def point_of_view(spark: SparkSession, cycles: int = 5, per_cycle: int = 100, width: int = 480, height: int = 270, noise: float = 2.0) -> DataFrame:
    """A workbench seen from above: a hand comes in from below, takes a part from a tray, presses it home and leaves.

    Each cycle has its own light; every frame has the noise of a sensor.
    """
    rng = np.random.default_rng(0xD1FF)
    plate = 96 + 40 * np.linspace(0, 1, height)[:, None, None] + rng.normal(0, 3, (height, width, 1)) + np.array([0, 4, 10])
    tray, bolt = (int(width * 0.21), int(height * 0.74)), (int(width * 0.55), int(height * 0.72))
    _box(plate, tray[0] - 40, tray[1] - 25, tray[0] + 40, tray[1] + 25, (70, 110, 60))
    _box(plate, bolt[0] - 14, bolt[1] - 14, bolt[0] + 14, bolt[1] + 14, (120, 120, 125))
    phase = (F.col("frame_idx") % per_cycle) / per_cycle

    def along(start: float, end: float) -> Column:
        """From 0 to 1 between two phases, with a soft start and end."""
        t = F.least(F.greatest((phase - start) / (end - start), F.lit(0.0)), F.lit(1.0))
        return t * t * (3 - 2 * t)

    reach, carry, leave = along(ENTRY, GRASP), along(GRASP, PRESS), along(PRESS, LEAVE)

    def path(home: int, first: int, second: int) -> Column:
        return (home + (first - home) * reach + (second - first) * carry + (home - second) * leave).cast("int")

    held = ((phase < GRASP) & (reach > 0.85)) | ((phase >= GRASP) & (phase < PRESS))
    places = spark.range(cycles * per_cycle).select(F.lit(0).alias("video"), F.col("id").alias("frame_idx")).withColumns({
        "x": path(width // 2, tray[0], bolt[0]), "y": path(height + 60, tray[1] + 10, bolt[1] + 5), "seen": (phase >= ENTRY) & (phase < LEAVE), "held": held,
        "waits": (phase < ENTRY) | (phase >= LEAVE) | ((phase < GRASP) & ~held), "cycle": F.floor(F.col("frame_idx") / per_cycle),
    })

    def part(image: np.ndarray, x: int, y: int) -> None:
        _box(image, x - 10, y - 7, x + 10, y + 7, PART)
        for edge in (x - 10, x + 7):
            _box(image, edge, y - 7, edge + 3, y + 7, LEADS)

    def draw(image: np.ndarray, r: dict) -> np.ndarray:
        if r["waits"]:
            part(image, *tray)
        if r["held"]:
            part(image, r["x"], r["y"] - 28)
        if r["seen"]:
            skin = np.array(SKIN, float)
            _box(image, r["x"] - 22, r["y"], r["x"] + 22, r["y"] + 85, skin)
            _box(image, r["x"] - 19, r["y"] - 27, r["x"] + 19, r["y"] + 27, 0.93 * skin)
            for k in (-12, -4, 4, 12):
                _box(image, r["x"] + k - 2, r["y"] - 24, r["x"] + k + 2, r["y"] - 20, 1.15 * skin)
        light = np.random.default_rng(r["cycle"] + 1000).uniform(-4, 4)
        return image + light + np.random.default_rng(r["frame_idx"]).normal(0, noise, image.shape)

    return _drawn(places, height, width, draw, plate)
