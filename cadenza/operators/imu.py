"""Orientation: quaternions [x, y, z, w] as structs, gyro integration, homographies, warping."""

from __future__ import annotations

from collections.abc import Iterator
from math import radians, tan

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.session import written

# Sample and frame rates.
GYRO_HZ, FRAME_HZ = 200, 30


def quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))


def multiply(a: Column, b: Column) -> Column:
    """Hamilton product."""
    def v(i: str, j: str, k: str) -> Column:  # one component of w1 v2 + w2 v1 + v1 x v2
        return a["w"] * b[i] + a[i] * b["w"] + a[j] * b[k] - a[k] * b[j]

    w = a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"]
    return quaternion(v("x", "y", "z"), v("y", "z", "x"), v("z", "x", "y"), w)


def conjugate(q: Column) -> Column:
    return quaternion(-q["x"], -q["y"], -q["z"], q["w"])


def normalise(q: Column) -> Column:
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])
    return quaternion(*(q[c] / n for c in "xyzw"))


def rotation(q: Column) -> list[list[Column]]:
    """The 3 x 3 rotation of a unit quaternion."""
    axes = "xyz"

    def entry(i: int, j: int) -> Column:
        if i == j:
            a, b = (q[axes[k]] for k in range(3) if k != i)
            return 1 - 2 * (a * a + b * b)
        k = 3 - i - j
        sign = -1 if (i + 1) % 3 == j else 1
        return 2 * (q[axes[i]] * q[axes[j]] + sign * q[axes[k]] * q["w"])

    return [[entry(i, j) for j in range(3)] for i in range(3)]


def focal(width: int, degrees: float = 90.0) -> float:
    return width / (2 * tan(radians(degrees / 2)))


def homography(q: Column, width: int = 1920, height: int = 1080) -> list[list[Column]]:
    """K R K^-1 in closed form, for focal length f and the centre of the frame."""
    f, cx, cy = focal(width), width / 2, height / 2
    r = rotation(q)
    kr = [[f * r[0][j] + cx * r[2][j] for j in range(3)], [f * r[1][j] + cy * r[2][j] for j in range(3)], r[2]]
    return [[row[0] / f, row[1] / f, row[2] - row[0] * (cx / f) - row[1] * (cy / f)] for row in kr]


def turn(gx: Column, gy: Column, gz: Column, dt: Column) -> Column:
    """The rotation of a gyro sample (radians a second) over dt; none if it is tiny."""
    rate = F.sqrt(gx * gx + gy * gy + gz * gz)
    angle = rate * dt
    s = F.sin(angle / 2) / rate
    still = angle <= 1e-10
    return quaternion(*(F.when(still, 0.0).otherwise(g * s) for g in (gx, gy, gz)), F.when(still, 1.0).otherwise(F.cos(angle / 2)))


def products(q: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... of n quaternions (rows x, y, z, w), in a logarithmic number of steps."""
    out, reach = q.copy(), 1
    while reach < len(out):
        a, b = out[:-reach], out[reach:]
        vector = a[:, 3:] * b[:, :3] + b[:, 3:] * a[:, :3] + np.cross(a[:, :3], b[:, :3])
        scalar = a[:, 3] * b[:, 3] - (a[:, :3] * b[:, :3]).sum(axis=1)
        out = np.concatenate([out[:reach], np.column_stack([vector, scalar])])
        out /= np.linalg.norm(out, axis=1, keepdims=True)
        reach *= 2
    return out


def integrate(samples: DataFrame) -> DataFrame:
    """(video, seq, q): the orientation after each sample of (video, seq, gx, gy, gz, dt).

    The quaternion product is associative, so a recording is cut into runs of 4,096 samples; products
    within runs are prefix products in parallel, and so are those of the runs, of which a recording has
    few. A sample without a rate counts as one at rest.
    """
    run = 4096

    def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = products(pdf[["x", "y", "z", "w"]].to_numpy())
        return pdf[["video", "run", "seq"]].assign(**dict(zip("xyzw", out.T, strict=True)))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        out = np.concatenate([[[0.0, 0.0, 0.0, 1.0]], products(pdf[["x", "y", "z", "w"]].to_numpy())[:-1]])
        return pdf[["video", "run"]].assign(**{f"b{c}": v for c, v in zip("xyzw", out.T, strict=True)})

    kind = samples.schema["video"].dataType.simpleString()
    turns = samples.select("video", "seq", F.floor(F.col("seq") / run).alias("run"), turn(*(F.coalesce(c, F.lit(0.0)) for c in ("gx", "gy", "gz", "dt"))).alias("d")).select("video", "run", "seq", "d.*")
    local = written(turns.groupBy("video", "run").applyInPandas(prefix, f"video {kind}, run long, seq long, x double, y double, z double, w double"), "turns")
    ends = local.groupBy("video", "run").agg(F.max_by(F.struct("x", "y", "z", "w"), "seq").alias("e")).select("video", "run", "e.*")
    before = ends.groupBy("video").applyInPandas(chain, f"video {kind}, run long, bx double, by double, bz double, bw double")
    return local.join(before, ["video", "run"]).select("video", "seq", normalise(multiply(quaternion(*(F.col(f"b{c}") for c in "xyzw")), quaternion(*(F.col(c) for c in "xyzw")))).alias("q"))


def emits(seq: Column, gyro_hz: int = GYRO_HZ, frame_hz: int = FRAME_HZ) -> Column:
    """Whether sample seq (from 1) completes a camera frame, in exact ratios."""
    return F.floor(seq * frame_hz / gyro_hz) > F.floor((seq - 1) * frame_hz / gyro_hz)


def at_frames(samples: DataFrame) -> DataFrame:
    """(video, frame_idx, q): the orientation at each camera frame of a recording (video, seq from 1, gx, gy, gz, dt)."""
    return integrate(samples).where(emits(F.col("seq"))).select("video", frame_of(F.col("seq")).alias("frame_idx"), "q")


def frame_of(seq: Column, gyro_hz: int = GYRO_HZ, frame_hz: int = FRAME_HZ) -> Column:
    return (F.floor(seq * frame_hz / gyro_hz) - 1).cast("long")


def relative(frames: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """frames (video, frame_idx, q, ...) with q relative to the reference of their video.

    reference has (video, frame_idx, q): a reference set at a frame holds from there to the next one. Where
    none holds yet, or none is given, the reference is the video's first orientation.
    """
    first = frames.where("q is not null").groupBy("video").agg(F.min_by("q", "frame_idx").alias("_first"))
    rows = frames.join(first, "video", "left")
    if reference is None:
        rows = rows.withColumn("_set", F.lit(None).cast(frames.schema["q"].dataType))
    else:
        sets = reference.select("video", F.col("frame_idx").alias("_from"), F.col("q").alias("_set"))
        spans = sets.withColumn("_to", F.lead("_from").over(W.partitionBy("video").orderBy("_from")))
        # references are set by hand, a few a video: each frame lies in the span of one at most
        rows = rows.join(spans, (rows["video"] == spans["video"]) & (rows["frame_idx"] >= spans["_from"]) & (spans["_to"].isNull() | (rows["frame_idx"] < spans["_to"])), "left").drop(spans["video"])
    turned = multiply(conjugate(F.coalesce("_set", "_first")), F.col("q"))
    return rows.withColumn("q", F.when(F.col("q").isNotNull(), turned)).select(*frames.columns)


def mapping(width: int, height: int) -> Column:
    """The column _map: the nine entries of the homography of q, null without q."""
    return F.when(F.col("q").isNotNull(), F.array(*(h for row in homography(F.col("q"), width, height) for h in row))).alias("_map")


def resample(image: np.ndarray, matrix: list[float] | None) -> np.ndarray:
    """An image (height, width, channels) through a homography, bilinearly; places beyond it take the nearest edge."""
    if matrix is None or None in matrix:
        return image
    height, width = image.shape[:2]
    ys, xs = np.mgrid[0:height, 0:width]
    # where each place of the result comes from
    u, v, s = np.linalg.inv(np.array(matrix).reshape(3, 3)) @ np.stack([xs.ravel(), ys.ravel(), np.ones(width * height)])
    u, v = np.clip(u / s, 0, width - 1), np.clip(v / s, 0, height - 1)
    u0, v0 = np.minimum(u.astype(int), max(0, width - 2)), np.minimum(v.astype(int), max(0, height - 2))
    u1, v1 = np.minimum(u0 + 1, width - 1), np.minimum(v0 + 1, height - 1)
    du, dv = (u - u0)[:, None], (v - v0)[:, None]
    out = (image[v0, u0] * (1 - du) + image[v0, u1] * du) * (1 - dv) + (image[v1, u0] * (1 - du) + image[v1, u1] * du) * dv
    return out.reshape(image.shape)


def warp(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames (.., px array<double> of height x width, q) with px resampled bilinearly through the homography of q.

    Places beyond the frame take the nearest edge. px is the frame before warping; channels may follow
    one another in a pixel. Without q a frame stays as it is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [resample(px.values.to_numpy(zero_copy_only=False).reshape(height, width, -1), h).ravel() for px, h in zip(batch.column("px"), batch.column("_map").to_pylist(), strict=True)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0), *out])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists], [*batch.schema.names[:-2], "px"])

    kept = [c for c in frames.columns if c not in ("px", "q")]
    rows = frames.select(*kept, F.col("px").cast("array<double>").alias("px"), mapping(width, height))
    return rows.mapInArrow(run, rows.drop("_map").schema)


def pack(quaternions: np.ndarray) -> bytes:
    """Rows x, y, z, w as half floats, one after another."""
    return np.asarray(quaternions, np.float64).reshape(-1, 4).astype("<f2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2").reshape(-1, 4).astype(np.float32)
