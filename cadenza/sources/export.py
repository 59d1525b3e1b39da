"""Frames and containers as files of their own names, on any file system that pyarrow knows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a destination's suffix asks for.
VIDEOS, JPEGS, PNGS = (".mp4", ".mov", ".avi"), (".jpg", ".jpeg"), (".png",)


def format_of(path: str, fmt: str = "auto") -> str:
    """png, jpeg or mp4. auto: by the suffix of path; none is a folder, which gets PNG files, any other a video."""
    if fmt != "auto":
        if fmt not in ("png", "jpeg", "jpg", "mp4"):
            raise ValueError(f"unknown format {fmt!r}: png, jpeg and mp4 are known")
        return "jpeg" if fmt == "jpg" else fmt
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = f".{name.rsplit('.', 1)[1]}" if "." in name else ""
    return "jpeg" if suffix in JPEGS else "png" if suffix in PNGS or not suffix else "mp4"


def png(pixels: np.ndarray) -> bytes:
    """An image (height, width, 3) of blue, green, red bytes, or (height, width) of grey ones, as a PNG file."""
    height, width = pixels.shape[:2]
    rows = pixels[:, :, ::-1] if pixels.ndim == 3 else pixels
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(rows).reshape(height, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    out = b"\x89PNG\r\n\x1a\n"
    for tag, data in ((b"IHDR", head), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")):
        out += struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return out


def put(path: str, content: bytes) -> None:
    """Write a file whole. Written again by another try of a task, it has the same content."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(content)


def _progress(done: DataFrame, total: int, on_progress: Callable[[int, int], None] | None) -> int:
    n = 0
    for n, _ in enumerate(done.toLocalIterator(), 1):  # a number for each file
        if on_progress:
            on_progress(n - 1, total)
    return n


def export(frames: DataFrame, path: str, fmt: str = "auto", key: str | None = None, on_progress: Callable[[int, int], None] | None = None) -> int:
    """Write frames (frame_idx, height, width, pixels) below path, a file each; the number of files.

    Names are frame_ and the number with as many digits as the last needs; with key, in a folder for each
    of its values. Tasks write their own frames. PNG is offered; JPEG and video need codecs that
    aren't here. on_progress(i, total) is called on the driver for each file as it is known to be written.
    """
    kind = format_of(path, fmt)
    if kind != "png":
        raise ValueError(f"{kind} files aren't offered: no codec is installed; use png")
    of = frames.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("_key"), F.col("frame_idx").cast("long"), "height", "width", "pixels")
    counts = {r["_key"]: (r["n"], r["last"]) for r in of.groupBy("_key").agg(F.count("*").alias("n"), F.max("frame_idx").alias("last")).collect()}
    digits = {k: len(str(last)) for k, (_, last) in counts.items()}
    base = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, h, w, px in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = base if name is None else f"{base}/{name.rstrip('/').rsplit('/', 1)[-1]}"
                put(f"{folder}/frame_{at:0{digits[name]}d}.png", png(np.frombuffer(px, np.uint8).reshape(h, w, 3)))
            yield pa.RecordBatch.from_pydict({"frame_idx": batch.column(1)})

    return _progress(of.mapInArrow(write, "frame_idx long"), sum(n for n, _ in counts.values()), on_progress)


def save(containers: DataFrame, path: str, suffix: str = ".dfy", key: str = "video") -> int:
    """Write containers (key, content) below path as files named by key; the number of files."""
    base = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put(f"{base}/{name}{suffix}", content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([1] * batch.num_rows, pa.int64())})

    return _progress(containers.select(F.col(key).cast("string"), "content").mapInArrow(write, "n long"), 0, None)
