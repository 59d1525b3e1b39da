"""Quality and size measures of decoded sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.operators.sequence import with_previous

# Constants of the structural similarity index for a range of 255, and its window.
C1, C2, WINDOW = (0.01 * 255) ** 2, (0.03 * 255) ** 2, 11


def frame_psnr(pairs: DataFrame) -> DataFrame:
    """pairs (video, frame_idx, a, b) to (video, frame_idx, mse, psnr)."""
    mse = arrays.mean_squared_error(F.col("a"), F.col("b"))
    return pairs.select("video", "frame_idx", mse.alias("mse")).withColumn("psnr", arrays.psnr(F.col("mse")))


def rollup(of: DataFrame, value: str = "psnr") -> DataFrame:
    """(video, n, mean, min, max, std), std over the population."""
    return of.groupBy("video").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std")
    )


def weighted(of: DataFrame, value: str = "mean", weight: str = "n") -> DataFrame:
    return of.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted"), F.sum(weight).alias("n"))


def jumps(pairs: DataFrame) -> DataFrame:
    """(video, frame_idx, orig_jump, dec_jump, ratio) for each frame after the first."""
    prev = with_previous(pairs, "video", "frame_idx", ["a", "b"]).where("prev_a is not null")
    orig, dec = (arrays.mean_abs_difference(F.col(c), F.col(f"prev_{c}")) for c in "ab")
    return prev.select("video", "frame_idx", orig.alias("orig_jump"), dec.alias("dec_jump")).withColumn("ratio", F.col("dec_jump") / (F.col("orig_jump") + 0.5))


def banding(of: DataFrame) -> DataFrame:
    """(video, transitions, score, worst_frame, worst_ratio): the share of jumps more than twice the original's."""
    return of.groupBy("video").agg(
        F.count("*").alias("transitions"), F.avg((F.col("ratio") > 2).cast("double")).alias("score"),
        F.max_by("frame_idx", F.struct("ratio", -F.col("frame_idx"))).alias("worst_frame"), F.max("ratio").alias("worst_ratio"),
    )


def block_ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two blocks as a whole."""
    def second(x: Column, y: Column, mx: Column, my: Column) -> Column:
        return arrays.mean(F.zip_with(x, y, lambda p, q: p * q)) - mx * my

    ma, mb = arrays.mean(a), arrays.mean(b)
    return ((2 * ma * mb + C1) * (2 * second(a, b, ma, mb) + C2)) / ((ma * ma + mb * mb + C1) * (second(a, a, ma, ma) + second(b, b, mb, mb) + C2))


def ssim(width: int, height: int, window: int = WINDOW):
    """An Arrow function of two frames: the mean of the index under a sliding uniform window, mirrored at the edges."""

    def box(m: np.ndarray) -> np.ndarray:
        before = window // 2
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (before, window - 1 - before)
            s = np.cumsum(np.insert(np.pad(m, pad, mode="symmetric"), 0, 0, axis=axis), axis=axis)
            n = m.shape[axis]
            m = (np.take(s, range(window, window + n), axis) - np.take(s, range(n), axis)) / window
        return m

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            if not (x.is_valid and y.is_valid):
                out.append(None)
                continue
            p, q = (v.values.to_numpy(zero_copy_only=False).astype(float).reshape(height, width) for v in (x, y))
            mp, mq = box(p), box(q)
            vp, vq, c = box(p * p) - mp**2, box(q * q) - mq**2, box(p * q) - mp * mq
            out.append(float((((2 * mp * mq + C1) * (2 * c + C2)) / ((mp**2 + mq**2 + C1) * (vp + vq + C2))).mean()))
        return pa.array(out, pa.float64())

    return score


# Bytes of a representative cycle and bit rates, by height of the picture and quality.
CYCLE_KB = {540: (80, 200, 450), 720: (150, 400, 900), 1080: (300, 800, 1800)}
VIDEO_KBPS = {540: 500, 720: 1000, 1080: 2000}
PLATE_BYTES, REFERENCE_PIXELS, CYCLE_S, REPRESENTATIVES, POINTER, DELTA = 200 * 1024, 1920 * 1080, 5, 3, 4, 0.15


def _by_height(height: Column, values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for h, v in values.items():
        out = F.when(height == h, F.lit(float(v))).otherwise(out)
    return out


def cycle_bytes(height: Column, quality: Column) -> Column:
    """Bytes of a representative cycle: linear between the qualities 20, 50 and 80, half as steep again beyond."""
    low, mid, high = (_by_height(height, {h: v[k] * 1024 for h, v in CYCLE_KB.items()}) for k in range(3))
    return (
        F.when(quality <= 20, low)
        .when(quality <= 50, F.floor(low + (quality - 20) / 30 * (mid - low) + 0.5))
        .when(quality <= 80, F.floor(mid + (quality - 50) / 30 * (high - mid) + 0.5))
        .otherwise(F.floor(high + (quality - 80) / 20 * (high * 0.5) + 0.5)).cast("double")
    )


def video_bytes(frames: Column, fps: Column, width: Column, height: Column, kbps: float = 2000.0) -> Column:
    """A conventional codec's size at a bit rate for 1920 x 1080, scaled by pixels."""
    return F.floor(kbps * (width * height / REFERENCE_PIXELS) * 1000 / 8 * (frames / fps)).cast("long")


def calculator(scenarios: DataFrame) -> DataFrame:
    """scenarios (workers, hours, height, mbps, repeat share, quality) with sizes, ratio and upload times."""
    seconds = F.col("hours") * 3600
    cycles = F.floor(seconds / CYCLE_S + 0.5)
    repeats = F.greatest(cycles - REPRESENTATIVES, F.lit(0))
    size = cycle_bytes(F.col("height"), F.col("quality"))
    ours = PLATE_BYTES + REPRESENTATIVES * size + repeats * (F.col("repeat") * POINTER + (1 - F.col("repeat")) * size * DELTA)
    theirs = _by_height(F.col("height"), VIDEO_KBPS) * 1000 / 8 * seconds
    rate = F.col("mbps") * 1e6
    return scenarios.withColumns({"coded_bytes": ours, "video_bytes": theirs}).withColumns({
        "ratio": F.col("video_bytes") / F.col("coded_bytes"),
        "coded_upload_s": F.col("coded_bytes") * F.col("workers") * 8 / rate,
        "video_upload_s": F.col("video_bytes") * F.col("workers") * 8 / rate,
    })
