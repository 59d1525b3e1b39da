from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cadenza.streaming import online


def test_energy_over_several_batches(spark, tmp_path):
    """The state carries the last frame from batch to batch."""
    rng = np.random.default_rng(0)
    px = rng.uniform(0, 255, (12, 4))
    for part in range(4):
        rows = [(v, k, px[k].tolist()) for v in range(2) for k in range(3 * part, 3 * part + 3)]
        spark.createDataFrame(rows, "video int, frame_idx long, px array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = online.source(spark, f"{tmp_path}/in", files_per_trigger=1)
    out = {(r.video, r.frame_idx): r.energy for r in online.drain(online.motion_energy(stream)).collect()}
    for v in range(2):
        for k in range(12):
            assert np.isclose(out[(v, k)], 0 if k == 0 else np.abs(px[k] - px[k - 1]).mean())


def test_cuts_as_in_batch(spark, tmp_path):
    """In batches of a few points, whatever the cuts between them."""
    from cadenza.operators import cycles as seg

    rng = np.random.default_rng(4)
    signals = {0: np.clip((np.cos(np.linspace(0, 14 * np.pi, 160)) + 1) / 2 + rng.normal(0, 0.05, 160), 0, None), 1: np.ones(90), 2: rng.random(9)}
    for part in range(8):
        rows = [(v, t, float(x)) for v, s in signals.items() for t, x in enumerate(s) if part * len(s) // 8 <= t < (part + 1) * len(s) // 8]
        spark.createDataFrame(rows, "video int, t long, energy double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    limits = {"shortest": 5, "longest": 40, "width": 4, "valley": 0.6}
    got = online.drain(online.cuts(online.source(spark, f"{tmp_path}/in", files_per_trigger=1), **limits)).collect()
    want = seg.boundaries(spark.read.parquet(f"{tmp_path}/in"), **limits).collect()
    assert sorted((r.video, r.t) for r in got) == sorted((r.video, r.t) for r in want if 0 < r.t < len(signals[r.video]) - 5) and len(got) > 5


def test_drift_over_several_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    px = rng.normal(100, 4, (30, 6))
    px[22, 2] = 250
    for part in range(6):
        spark.createDataFrame([(0, k, px[k].tolist()) for k in range(5 * part, 5 * part + 5)], "video int, frame_idx long, px array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r.frame_idx: r for r in online.drain(online.drift(online.source(spark, f"{tmp_path}/in", files_per_trigger=1), warmup=12)).collect()}
    mu, std = px[:12].mean(axis=0), np.maximum(px[:12].std(axis=0, ddof=1), 2)
    for k in range(30):
        assert got[k].warm == (k >= 12)
        if k >= 12:
            far = np.abs(px[k] - mu)
            fore = (far / std > 3.5) | (far > 25)
            mu = np.where(fore, mu, mu + 0.002 * (px[k] - mu))
            assert got[k].foreground == fore.sum() and np.isclose(got[k].level, mu.mean())
    assert got[22].foreground >= 1


def test_windows_close_with_the_watermark(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k // 3} 0{k}:00:00", "a", 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = online.drain(online.windows(online.source(spark, f"{tmp_path}/in"), "1 day")).collect()
    assert sorted((str(r.start)[:10], r.n) for r in got) == [("2024-01-01", 3), ("2024-01-02", 3)]
