"""Frames as tables: synthetic scenes, access by index, clips for training, export."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A run: value and length, big-endian.
_PAIR = np.dtype([("value", ">i2"), ("run", "u1")])


def synthetic(spark: SparkSession, frames: int, width: int = 16, height: int = 16, cycles: int = 4, radius: float = 3.0) -> DataFrame:
    """(video, frame_idx, px): a bright disc that circles over a flat background, all in column arithmetic."""
    t = F.col("frame_idx") * (cycles / frames)
    two_pi = 2 * np.pi
    cx, cy = 0.5 * width + 0.3 * width * F.sin(two_pi * t), 0.5 * height + 0.2 * height * F.sin(2 * two_pi * t)
    at = spark.range(frames).withColumnRenamed("id", "frame_idx").withColumns({"cx": cx, "cy": cy})

    def value(i):
        dx, dy = i % width - F.col("cx"), F.floor(i / width) - F.col("cy")
        return F.when(dx * dx + dy * dy <= radius * radius, 200.0).otherwise(100.0)

    return at.select(F.lit(0).alias("video"), "frame_idx", F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), value).alias("px"))


def at_index(frames: DataFrame, video, index: int) -> DataFrame:
    """One frame; a negative index counts from the end. IndexError beyond either end."""
    of = frames.where(F.col("video") == F.lit(video))
    last = of.agg(F.max("frame_idx")).first()[0]
    n = 0 if last is None else last + 1
    at = index + n if index < 0 else index
    if not 0 <= at < n:
        raise IndexError(index)
    return of.where(F.col("frame_idx") == at)


def between(frames: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Frames start, start + step, ... before stop, of every video."""
    return frames.where((F.col("frame_idx") >= start) & (F.col("frame_idx") < stop) & ((F.col("frame_idx") - start) % step == 0))


def counts(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """(video, total_frames, first, last, seconds)."""
    return frames.groupBy("video").agg(F.count("*").alias("total_frames"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), (F.count("*") / fps).alias("seconds"))


def clip_index(sizes: DataFrame, length: int, stride: int = 1) -> DataFrame:
    """(video, clip, start) of all clips of length frames, stride apart, in videos (video, n)."""
    starts = F.when(F.col("n") >= length, F.sequence(F.lit(0).cast("long"), F.col("n") - length, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<long>"))
    return sizes.select("video", F.posexplode(starts).alias("clip", "start"))


def clips(frames: DataFrame, index: DataFrame, length: int) -> DataFrame:
    """(video, clip, start, px array of arrays): frames (video, k, px) gathered into the clips of an index.

    The join is on equality: each clip asks for its own places.
    """
    asked = index.select("video", "clip", "start", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("k"))
    rows = asked.join(frames.select("video", "k", "px"), ["video", "k"])
    return rows.groupBy("video", "clip", "start").agg(F.array_sort(F.collect_list(F.struct("k", "px"))).alias("f")).select("video", "clip", "start", F.col("f.px").alias("px"))


def apply(frames: DataFrame, function, schema: str) -> DataFrame:
    """A user's transform of Arrow batches of frames."""
    return frames.mapInArrow(function, schema)


def png(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(video, frame_idx, name, content): each frame as a grey PNG file, with a zero-padded name."""

    @F.arrow_udf(T.BinaryType())
    def draw(px: pa.Array) -> pa.Array:
        out = []
        for v in px.to_pylist():
            if v is None:
                out.append(None)
                continue
            rows = np.clip(np.array(v), 0, 255).astype(np.uint8).reshape(height, width)
            raw = b"".join(b"\0" + r.tobytes() for r in rows)
            body = b"\x89PNG\r\n\x1a\n"
            for tag, data in ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")):
                body += struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
            out.append(body)
        return pa.array(out, pa.binary())

    name = F.format_string("frame_%06d.png", F.col("frame_idx"))
    return frames.select("video", "frame_idx", name.alias("name"), draw("px").alias("content"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def read_png(content: pa.Array) -> pa.Array:
    """The pixels of grey PNG files of eight bits without interlacing or filters, as png() makes them; each part's checksum is tested."""
    out = []
    for data in content.to_pylist():
        if data is None:
            out.append(None)
            continue
        at, width, body = 8, 0, b""
        while at < len(data):
            (n,) = struct.unpack_from(">I", data, at)
            tag, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
            if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(tag + part):
                raise ValueError("a part of the PNG file doesn't match its checksum")
            width, body = (struct.unpack_from(">I", part)[0] if tag == b"IHDR" else width), body + (part if tag == b"IDAT" else b"")
            at += 12 + n
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, width + 1)
        if rows[:, 0].any():
            raise ValueError("a filtered row")
        out.append(rows[:, 1:].ravel().tolist())
    return pa.array(out, pa.list_(pa.int32()))


def deflate(level: int = 9):
    """An Arrow function: binary to its zlib stream."""

    @F.arrow_udf(T.BinaryType())
    def pack(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else zlib.compress(v, level) for v in column.to_pylist()], pa.binary())

    return pack


@F.arrow_udf(T.BinaryType())
def inflate(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else zlib.decompress(v) for v in column.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def pack_pairs(pairs: pa.Array) -> pa.Array:
    """Run-length pairs as bytes: i16 value and u8 run, big-endian."""
    of = pairs.flatten()
    packed = np.zeros(len(of), _PAIR)
    packed["value"], packed["run"] = (of.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    raw, ends = packed.tobytes(), np.cumsum(pairs.value_lengths().fill_null(0).to_numpy()) * 3
    return pa.array([raw[a:z] if ok else None for a, z, ok in zip([0, *ends.tolist()[:-1]], ends.tolist(), pairs.is_valid().to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(T.ArrayType(T.StructType().add("value", "integer").add("run", "integer")))
def unpack_pairs(packed: pa.Array) -> pa.Array:
    parts = [np.frombuffer(b[: len(b) // 3 * 3], _PAIR) if b is not None else np.zeros(0, _PAIR) for b in packed.to_pylist()]
    every = np.concatenate([*parts, np.zeros(0, _PAIR)])
    pairs = pa.StructArray.from_arrays([pa.array(every[c].astype(np.int32)) for c in ("value", "run")], ["value", "run"])
    offsets = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32), mask=np.append(packed.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pairs)
