"""Objects for one video at a time: push frames and encode, open a container and pull frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import codec, imu
from cadenza.sources import container
from cadenza.streaming.online import folder

#: Frames that are held before they are written.
HELD = 64


class Recorder:
    """Takes frames of one video, with their orientations or gyro samples, and gives a container's bytes.

    Frames go to the shared folder as they come; encoding is a Spark job over them. options are those of
    codec.encode().
    """

    def __init__(self, spark: SparkSession, width: int, height: int, /, fps: float = 30.0, **options):
        self.spark, self.width, self.height, self.fps, self.options = spark, width, height, fps, options
        self.frame_count, self.samples, self.turns = 0, [], []
        self._path, self._held = folder(spark), []

    def push_frame(self, pixels: np.ndarray, quaternion: np.ndarray | None = None) -> None:
        """A frame of height x width x 3 bytes, and its orientation x, y, z, w."""
        if pixels.shape != (self.height, self.width, 3) or pixels.dtype != np.uint8:
            raise ValueError(f"frames are bytes of shape ({self.height}, {self.width}, 3)")
        if quaternion is not None:
            self.turns.append((self.frame_count, *(float(v) for v in quaternion)))
        self._held.append((0, self.frame_count, self.height, self.width, bytearray(pixels.tobytes())))
        self.frame_count += 1
        if len(self._held) >= HELD:
            self._write()

    def push_gyro(self, rate: np.ndarray, dt: float = 1 / imu.GYRO_HZ) -> None:
        """A gyro sample, radians a second; used where frames come without orientations."""
        self.samples.append((0, len(self.samples) + 1, *(float(v) for v in rate), float(dt)))

    def _write(self) -> None:
        if self._held:
            self.spark.createDataFrame(self._held, "video int, frame_idx long, height int, width int, pixels binary").write.mode("append").parquet(self._path)
            self._held = []

    def orientation(self) -> DataFrame | None:
        """(video, frame_idx, q) of the frames, or None."""
        if self.turns:
            rows = self.spark.createDataFrame(self.turns, "frame_idx long, x double, y double, z double, w double")
            return rows.select(F.lit(0).alias("video"), "frame_idx", F.struct("x", "y", "z", "w").alias("q"))
        if self.samples:
            of = imu.at_frames(self.spark.createDataFrame(self.samples, "video int, seq long, gx double, gy double, gz double, dt double"))
            return of.where(F.col("frame_idx") < self.frame_count)
        return None

    def encode(self) -> bytes:
        if not self.frame_count:
            raise ValueError("no frame was pushed")
        self._write()
        return bytes(codec.encode(self.spark.read.parquet(self._path), fps=self.fps, orientation=self.orientation(), **self.options).first()["content"])


class Player:
    """Reads a container's bytes: what it says of itself, and its frames, pulled one at a time."""

    def __init__(self, content: bytes, lenient: bool = False):
        self.content, self.lenient = content, lenient
        self.total_frames, self.fps, self.width, self.height, self.flags = container.parse_header(content)
        self._next = self.iter_frames()

    def __len__(self) -> int:
        return self.total_frames

    def iter_frames(self) -> Iterator[np.ndarray]:
        return (f.astype(np.uint8) for f in codec.decode_content(self.content, self.lenient))

    def iter_cycles(self) -> Iterator[np.ndarray]:
        """Each cycle's frames, stacked."""
        for cycle in codec.decode_cycles(self.content, self.lenient):
            if frames := list(cycle):
                yield np.stack(frames).astype(np.uint8)

    __iter__ = iter_frames

    def next_frame(self) -> np.ndarray | None:
        """The next frame, or None after the last."""
        return next(self._next, None)

    def __getitem__(self, index: int) -> np.ndarray:
        at = index + self.total_frames if index < 0 else index
        if not 0 <= at < self.total_frames:
            raise IndexError(index)
        return next(f for k, f in enumerate(self.iter_frames()) if k == at)

    def orientations(self) -> np.ndarray | None:
        return codec.orientations(self.content, self.lenient)
