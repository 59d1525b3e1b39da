"""Prediction of frames from the one before and from a representative sequence.

Frames are rows (video, frame_idx, px array<double>). Open-loop steps are set-based; the closed loop,
whose reference is what a decoder would have, is a function of ordered frames, run for groups that
intra frames make independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.functions.transform import basis, clip
from cadenza.operators.sequence import with_previous

# Predicted frames between intra frames, largest offset, frames sampled, least overlap.
RUN, REACH, SAMPLES, OVERLAP = 25, 20, 10, 5


def numbered(frames: DataFrame) -> DataFrame:
    """frames with k, their place in the video from 0; frame_idx is unique in a video. Only keys are sorted, pixels are joined."""
    places = frames.select("video", "frame_idx").withColumn("k", F.row_number().over(W.partitionBy("video").orderBy("frame_idx")) - 1)
    return frames.join(places, ["video", "frame_idx"])


def frame_type(k: Column, run: int = RUN) -> Column:
    """I at the start and after every run of P frames: the counter in closed form."""
    return F.when(k % (run + 1) == 0, "I").otherwise("P")


def temporal_delta(frames: DataFrame) -> DataFrame:
    """frames with delta: the change from the frame before in whole levels; null for the first."""
    with_prev = with_previous(frames, "video", "frame_idx", ["px"])
    return with_prev.withColumn("delta", F.zip_with("px", "prev_px", lambda a, b: a.cast("int") - clip(b, 0.0, 255.0).cast("int"))).drop("prev_px")


def motion_energy(frames: DataFrame) -> DataFrame:
    """(video, frame_idx, energy): mean absolute change from the frame before, 0 for the first."""
    with_prev = with_previous(frames, "video", "frame_idx", ["px"])
    return with_prev.select("video", "frame_idx", F.coalesce(arrays.mean_abs_difference(F.col("px"), F.col("prev_px")), F.lit(0.0)).alias("energy"))


def canonical_delta(frames: DataFrame, canonical: DataFrame, beyond: str = "drop") -> DataFrame:
    """frames (video, k, px) less canonical (video, k, px) at the same place.

    beyond the canonical's end: "drop" the frame, "zero" take 0 as reference, or "last" its last frame.
    """
    ref = canonical.select("video", F.col("k").alias("rk"), F.col("px").alias("ref"))
    if beyond == "last":
        ends = canonical.groupBy("video").agg(F.max("k").alias("end"))
        joined = frames.join(ends, "video", "left").withColumn("rk", F.least("k", "end")).drop("end").join(ref, ["video", "rk"], "left")
    else:
        joined = frames.withColumn("rk", F.col("k")).join(ref, ["video", "rk"], "inner" if beyond == "drop" else "left")
    zero = F.transform("px", lambda v: F.lit(0.0))
    return joined.withColumn("delta", F.zip_with("px", F.coalesce("ref", zero), lambda a, b: a.cast("int") - b.cast("int"))).drop("rk", "ref")


def reconstruct(reference: Column, residual: Column) -> Column:
    return F.zip_with(reference, residual, lambda a, b: clip(a + b, 0.0, 255.0))


def decode_open_loop(deltas: DataFrame) -> DataFrame:
    """(video, k, cell, v): cells of deltas (video, k, type, cell, d) summed from each I frame on, without clipping."""
    group = F.sum((F.col("type") == "I").cast("int")).over(W.partitionBy("video", "cell").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    v = F.sum("d").over(W.partitionBy("video", "cell", "_group").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return deltas.withColumn("_group", group).select("video", "k", "cell", v.alias("v"))


def even_samples(n: Column, most: int = SAMPLES) -> Column:
    """Places of min(most, n) samples spread evenly over 0..n-1, truncated."""
    m = F.least(F.lit(most), n)
    return F.when(n <= 0, F.array().cast("array<int>")).when(m == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.floor(i * (n - 1) / (m - 1) + 1e-9).cast("int"))
    )


def phase_offsets(a: DataFrame, b: DataFrame, reach: int = REACH, samples: int = SAMPLES, overlap: int = OVERLAP) -> DataFrame:
    """(pair, offset, mse) for each pair and shift of sequences a and b, rows (pair, k, px) less their background.

    A positive offset drops the start of b, a negative one the start of a. Only sampled places are
    joined, on equality.
    """
    size = a.groupBy("pair").agg(F.max("k").alias("na")).join(b.groupBy("pair").agg(F.max("k").alias("nb")), "pair")
    grid = size.select("pair", (F.col("na") + 1).alias("na"), (F.col("nb") + 1).alias("nb"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset"))
    shift = F.abs("offset")
    # either shift leaves the same overlap: both slices lose as many frames
    n = F.least("na", "nb") - shift
    grid = grid.withColumn("n", n.cast("int")).where(F.col("n") >= overlap).select("pair", "offset", F.explode(even_samples(F.col("n"), samples)).alias("i"))
    places = grid.select("pair", "offset", "i", (F.col("i") + F.greatest(-F.col("offset"), F.lit(0))).alias("ka"), (F.col("i") + F.greatest("offset", F.lit(0))).alias("kb"))
    held = lambda px: F.transform(px, lambda v: clip(v, -128.0, 127.0))
    left = a.select("pair", F.col("k").alias("ka"), held("px").alias("pa"))
    right = b.select("pair", F.col("k").alias("kb"), held("px").alias("pb"))
    joined = places.join(left, ["pair", "ka"]).join(right, ["pair", "kb"])
    return joined.groupBy("pair", "offset").agg(F.avg(arrays.mean_squared_error(F.col("pa"), F.col("pb"))).alias("mse"))


def best_offset(offsets: DataFrame) -> DataFrame:
    """The offset of the least error for each pair; the most negative of equals."""
    best = F.min(F.struct("mse", "offset")).alias("m")
    return offsets.groupBy("pair").agg(best).select("pair", "m.offset", "m.mse")


def sequence_mse(a: DataFrame, b: DataFrame, every: int = 10) -> DataFrame:
    """(pair, mse): mean over every tenth common place of the mean squared difference; 0 where none is common."""
    left = a.where(F.col("k") % every == 0).select("pair", "k", F.col("px").alias("pa"))
    joined = left.join(b.select("pair", "k", F.col("px").alias("pb")), ["pair", "k"])
    means = joined.groupBy("pair").agg(F.avg(arrays.mean_squared_error(F.col("pa"), F.col("pb"))).alias("mse"))
    return a.select("pair").distinct().join(means, "pair", "left").select("pair", F.coalesce("mse", F.lit(0.0)).alias("mse"))


def frame_skip(of: DataFrame, n: DataFrame) -> DataFrame:
    """The first n frames of the canonical that a skipped cycle repeats: of (video, k, ...) with n (video, n)."""
    return of.join(n, "video").where("k < n").drop("n")


def closed_loop(frames: DataFrame, background: DataFrame, table: tuple[int, ...], run: int = RUN) -> DataFrame:
    """(video, k, type, levels, decoded): each P frame codes the change from the decoded frame before it.

    frames: (video, k, px of 64 cells), background: (video, mean). I frames code the change from the
    background and so make groups of run + 1 frames independent: those groups are the tasks.
    """
    q, b = np.array(table, np.float64), basis()

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            levels, decoded = [], []
            prev = None
            for k, px, mean in zip(pdf["k"], pdf["px"], pdf["mean"], strict=True):
                ref = np.trunc(np.clip(mean, 0, 255)) if k % (run + 1) == 0 or prev is None else prev
                level = np.clip(np.rint((b @ (np.trunc(px) - np.trunc(ref))) / q), -32767, 32767)
                prev = np.clip(ref + np.trunc(b.T @ (level * q)), 0, 255)
                levels.append(level.astype(np.int32))
                decoded.append(prev)
            yield pd.DataFrame({"video": pdf["video"], "k": pdf["k"], "type": np.where(pdf["k"] % (run + 1) == 0, "I", "P"), "levels": levels, "decoded": decoded})

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(code(iter([pdf.sort_values("k")])))

    joined = frames.select("video", "k", "px").join(background.select("video", "mean"), "video").withColumn("g", F.floor(F.col("k") / (run + 1)))
    kind = frames.schema["video"].dataType.simpleString()
    return joined.groupBy("video", "g").applyInPandas(group, f"video {kind}, k int, type string, levels array<int>, decoded array<double>")
