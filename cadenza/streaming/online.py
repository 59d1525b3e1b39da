"""Streams: incremental background, change energy, orientation, and windows of events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.background import ABSOLUTE, ALPHA, FLOOR, SIGMA, WARMUP
from cadenza.operators.cycles import LONGEST, SHORTEST, VALLEY, WIDTH
from cadenza.operators.sequence import gaussian_kernel
from cadenza.session import shared_dir


def folder(spark: SparkSession) -> str:
    """A new folder in the folder that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files at path, a folder or one file, with the schema of those there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{place}/[{name[0]}]{name[1:]}")  # a pattern may also match a file, a plain path must be a folder


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give its result; exactly once, by batch number.

    append and update: every batch's rows; complete: those of the last batch.
    """
    spark = stream.sparkSession
    out, checkpoint = folder(spark), folder(spark)
    state = spark.conf.get("spark.sql.shuffle.partitions")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", state)
    seen = spark.read.schema(stream.schema)
    return seen.parquet(out) if mode == "complete" else seen.option("basePath", out).parquet(f"{out}/batch=*").select(*stream.columns)


def background(cells: DataFrame) -> DataFrame:
    """(video, cell, n, mean, std) of a stream of cells: moments that merge, so the order of arrival doesn't matter."""
    return cells.groupBy("video", "cell").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), F.lit(FLOOR)).alias("std")
    )


def drift(frames: DataFrame, warmup: int = WARMUP, alpha: float = ALPHA, sigma: float = SIGMA, absolute: float = ABSOLUTE) -> DataFrame:
    """(video, frame_idx, warm, foreground, level) of a stream of frames: the whole background model as state.

    The first warmup frames add up to mean and deviation; then the deviation is frozen and the mean
    of each background cell moves by alpha. foreground counts a frame's cells off the mean before it (all
    while it isn't warm), level is the mean of the means after it.
    """
    kind = frames.schema["video"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("frame_idx")
        n, mean, spread = (state.get[0], *map(np.array, state.get[1:])) if state.exists else (0, None, None)
        warm, off, level = [], [], []
        for px in pdf["px"]:
            px = np.asarray(px, float)
            warm.append(n >= warmup)
            if n < warmup:  # spread: sum of squares about the mean
                off.append(len(px))
                mean, spread = (np.zeros(len(px)), np.zeros(len(px))) if n == 0 else (mean, spread)
                n += 1
                before = px - mean
                mean = mean + before / n
                spread = spread + before * (px - mean)
                if n == warmup:
                    spread = np.maximum(np.sqrt(spread / max(n - 1, 1)), FLOOR)
            else:
                n += 1
                far = np.abs(px - mean)
                fore = (far / spread > sigma) | (far > absolute)
                off.append(int(fore.sum()))
                mean = np.where(fore, mean, mean + alpha * (px - mean))
            level.append(float(mean.mean()))
        state.update((n, mean.tolist(), spread.tolist()))
        yield pd.DataFrame({"video": key[0], "frame_idx": pdf["frame_idx"], "warm": warm, "foreground": off, "level": level})

    return frames.groupBy("video").applyInPandasWithState(
        step, f"video {kind}, frame_idx long, warm boolean, foreground long, level double", "n long, mean array<double>, spread array<double>", "append", GroupStateTimeout.NoTimeout
    )


def cuts(signal: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, width: int = WIDTH, valley: float = VALLEY) -> DataFrame:
    """(video, t): the cuts of a stream of energies (video, t from 0, energy), each as soon as it is certain.

    They are those of cycles.boundaries(), whose smoothing and neighbours look width + 1 points ahead: a
    cut is known that many points later, and the last width + 1 points of a stream are still open. The state
    is what smoothing still needs, the largest smooth value, and the last cut; no list of energies grows.
    """
    kernel = np.array(gaussian_kernel(width))
    kind = signal.schema["video"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("t")
        # first: the place of the first energy held; at: the next place to judge
        first, at, top, last, held = state.get if state.exists else (0, 0, float("-inf"), 0, [])
        x = np.concatenate([np.array(held, float), pdf["energy"].to_numpy(float)])
        end, out = first + len(x) - width - 1, []  # places before end are certain
        if first + len(x) >= 2 * width + 1 and at < end:
            padded = np.concatenate([np.zeros(width), x]) if first == 0 else x
            start = 0 if first == 0 else first + width
            smooth = np.convolve(padded, kernel, "valid")  # of places from start on
            for t in range(at, end):
                s = smooth[t - start]
                top = max(top, s)
                low = t > 0 and s < top * valley and s <= smooth[t - 1 - start] and s <= smooth[t + 1 - start]
                if t > 0 and t - last >= shortest and (t - last > longest or low):
                    out.append(t)
                    last = t
            at = end
            keep = max(0, at - 1 - width)
            x, first = x[keep - first :], keep
        state.update((int(first), int(at), float(top), int(last), x.tolist()))
        yield pd.DataFrame({"video": [key[0]] * len(out), "t": np.array(out, np.int64)})

    return signal.groupBy("video").applyInPandasWithState(step, f"video {kind}, t long", "first long, at long, top double, last long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def matched(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """Rows (key, ts, id) of two streams that share a key, right at most an interval after left: (id, other_id).

    Both watermarks bound the state: a row is forgotten once no partner can come.
    """
    a = left.select(F.col(key).alias("_a"), F.col("ts").cast("timestamp").alias("_at"), F.col("id")).withWatermark("_at", late)
    b = right.select(F.col(key).alias("_b"), F.col("ts").cast("timestamp").alias("_bt"), F.col("id").alias("other_id")).withWatermark("_bt", late)
    return a.join(b, F.expr(f"_a = _b AND _bt >= _at AND _bt <= _at + INTERVAL {within}")).select("id", "other_id")


def motion_energy(frames: DataFrame) -> DataFrame:
    """(video, frame_idx, energy) of a stream of frames: the state of a video is its last frame."""
    kind = frames.schema["video"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("frame_idx")
        prev = np.array(state.get[0]) if state.exists else None
        energy = []
        for px in pdf["px"]:
            energy.append(0.0 if prev is None else float(np.abs(px - prev).mean()))
            prev = px
        state.update((prev.tolist(),))
        yield pd.DataFrame({"video": key[0], "frame_idx": pdf["frame_idx"], "energy": energy})

    return frames.groupBy("video").applyInPandasWithState(step, f"video {kind}, frame_idx long, energy double", "px array<double>", "append", GroupStateTimeout.NoTimeout)


def orientation(samples: DataFrame) -> DataFrame:
    """(video, seq, x, y, z, w) of a stream of gyro samples (video, seq, gx, gy, gz, dt): the state is the quaternion."""
    kind = samples.schema["video"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("seq")
        q, out = np.array(state.get) if state.exists else np.array([0.0, 0.0, 0.0, 1.0]), []
        for g, dt in zip(pdf[["gx", "gy", "gz"]].to_numpy(), pdf["dt"], strict=True):
            rate = np.linalg.norm(g)
            if rate * dt > 1e-10:
                v, c = g / rate * np.sin(rate * dt / 2), np.cos(rate * dt / 2)
                q = np.append(q[3] * v + c * q[:3] + np.cross(q[:3], v), q[3] * c - q[:3] @ v)
                q /= np.linalg.norm(q)
            out.append(q)
        state.update(tuple(float(x) for x in q))
        yield pd.DataFrame({"video": key[0], "seq": pdf["seq"], **dict(zip("xyzw", np.array(out).T, strict=True))})

    return samples.groupBy("video").applyInPandasWithState(
        step, f"video {kind}, seq long, x double, y double, z double, w double", "x double, y double, z double, w double", "append", GroupStateTimeout.NoTimeout
    )


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of windows that the watermark has closed."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
