"""Background models of frames, and what they leave as foreground.

Frames are rows (video, frame_idx, px array<double>); cells are their exploded values (video,
frame_idx, cell, v). Statistics are per cell: partial sums before the shuffle, no order needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.transform import clip

# Warm-up frames, floor of the deviation, thresholds, drift.
WARMUP, FLOOR, SIGMA, ABSOLUTE, ALPHA = 300, 2.0, 3.5, 25.0, 0.002


def cells(frames: DataFrame) -> DataFrame:
    return frames.select("video", "frame_idx", F.posexplode("px").alias("cell", "v"))


def statistics(of: DataFrame, warmup: int | None = None) -> DataFrame:
    """(video, cell, n, mean, std) over the frames before warmup; std is at least FLOOR."""
    rows = of if warmup is None else of.where(F.col("frame_idx") < warmup)
    return rows.groupBy("video", "cell").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), F.lit(FLOOR)).alias("std")
    )


def plate(model: DataFrame) -> DataFrame:
    """The background as bytes: means clipped to 0..255 and truncated."""
    return model.select("video", "cell", clip(F.col("mean"), 0.0, 255.0).cast("int").alias("plate"))


def model_arrays(model: DataFrame) -> DataFrame:
    """(video, mean, std) with an array each; a frame's worth of cells for each video."""
    rows = F.array_sort(F.collect_list(F.struct("cell", "mean", "std")))
    return model.groupBy("video").agg(rows.alias("m")).select("video", F.col("m.mean").alias("mean"), F.col("m.std").alias("std"))


def is_foreground(v: Column, mean: Column, std: Column, sigma: float = SIGMA, absolute: float | None = ABSOLUTE) -> Column:
    off = F.abs(v - mean)
    test = off / std > sigma
    return test if absolute is None else test | (off > absolute)


def foreground(frames: DataFrame, model: DataFrame, sigma: float = SIGMA, absolute: float | None = ABSOLUTE) -> DataFrame:
    """frames with mask (array<boolean>) and residual (array<int>, 0 where masked out) added.

    A video without a model has all cells in the foreground, against a background of 0.
    """
    joined = frames.join(model_arrays(model), "video", "left")
    known = F.col("mean").isNotNull()
    mask = F.zip_with(F.arrays_zip("px", "mean", "std"), "px", lambda s, v: is_foreground(v, s["mean"], s["std"], sigma, absolute))
    everything = F.transform("px", lambda v: F.lit(True))
    apart = F.zip_with("px", F.coalesce("mean", F.transform("px", lambda v: F.lit(0.0))), lambda v, m: v.cast("int") - m.cast("int"))
    return joined.withColumn("mask", F.when(known, mask).otherwise(everything)).withColumn(
        "residual", F.zip_with(apart, "mask", lambda d, m: F.when(m, d).otherwise(0))
    ).drop("mean", "std")


def energy(residual: Column, mask: Column) -> Column:
    """Mean absolute residual of the foreground, 0 where there is none."""
    n = F.size(F.filter(mask, lambda m: m))
    held = F.aggregate(F.zip_with(residual, mask, lambda d, m: F.when(m, F.abs(d)).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(n > 0, held / n).otherwise(0.0)


def bounding_box(mask: Column, width: int, height: int, margin: int = 8) -> Column:
    """struct<y0,x0,y1,x1> about the true cells, with a margin, within the frame; all of it if none is true."""
    at = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    ys, xs = F.transform(at, lambda i: F.floor(i / width).cast("int")), F.transform(at, lambda i: i % width)
    none = F.size(at) == 0

    def edge(of: Column, least: bool, size: int) -> Column:
        inner = F.greatest(F.array_min(of) - margin, F.lit(0)) if least else F.least(F.array_max(of) + margin + 1, F.lit(size))
        return F.when(none, 0 if least else size).otherwise(inner).cast("int")

    return F.struct(edge(ys, True, height).alias("y0"), edge(xs, True, width).alias("x0"), edge(ys, False, height).alias("y1"), edge(xs, False, width).alias("x1"))


def drift(frames: DataFrame, model: DataFrame, alpha: float = ALPHA, sigma: float = SIGMA, absolute: float = ABSOLUTE, stripe: int = 4096) -> DataFrame:
    """(video, frame_idx, cell, mu): the mean after each of frames (video, frame_idx, px), moved by alpha where the cell is background.

    The deviation stays as the warm-up left it. A mean depends on the one before through the test for
    foreground, so a cell is truly sequential, but cells are independent: stripes of cells are the
    tasks. A stripe's frames stream by in order, and its means are all that is held.
    """
    size = F.greatest(F.ceil(F.size("px") / stripe), F.lit(1)).cast("int")
    parts = frames.select("video", "frame_idx", "px", F.explode(F.sequence(F.lit(0), size - 1)).alias("stripe"))
    parts = parts.select("video", "stripe", "frame_idx", F.slice("px", F.col("stripe") * stripe + 1, F.lit(stripe)).alias("px"))
    start = model.select("video", F.floor(F.col("cell") / stripe).cast("int").alias("stripe"), F.struct("cell", "mean", "std").alias("m")).groupBy("video", "stripe").agg(F.array_sort(F.collect_list("m")).alias("m"))
    # the model comes before all frames
    first = start.select("video", "stripe", F.lit(None).cast("long").alias("frame_idx"), F.col("m.mean").alias("px"), F.col("m.std").alias("std"))
    rows = first.unionByName(parts.select("video", "stripe", F.col("frame_idx").cast("long").alias("frame_idx"), "px", F.lit(None).cast("array<double>").alias("std")))
    kind = frames.schema["video"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mu, std = None, None, None
        for batch in batches:
            keep, out = [], []
            for k, (video, part, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                px = batch.column(3)[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
                if at is None:
                    key, mu, std = (video, part), px, batch.column(4)[k].values.to_numpy(zero_copy_only=False)
                    continue
                if key != (video, part):
                    continue  # no model
                off = px - mu
                far = np.abs(off)
                mu = np.where((far / std > sigma) | (far > absolute), mu, mu + alpha * off)
                keep.append(k)
                out.append(mu)
            at = pa.array(keep, pa.int64())
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0), *out])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), lists], ["video", "stripe", "frame_idx", "mu"])

    ordered = rows.repartition("video", "stripe").sortWithinPartitions("video", "stripe", F.col("frame_idx").asc_nulls_first())
    moved = ordered.mapInArrow(step, f"video {kind}, stripe int, frame_idx long, mu array<double>")
    return moved.select("video", "frame_idx", "stripe", F.posexplode("mu").alias("k", "mu")).select("video", "frame_idx", (F.col("stripe") * stripe + F.col("k")).alias("cell"), "mu")
