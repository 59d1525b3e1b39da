from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import transform
from cadenza.operators import background as bg
from cadenza.operators import cycles as seg
from cadenza.operators import imu, metrics, prediction, relational, sequence, vq


def frames(spark, arrays, video=0):
    return spark.createDataFrame([(video, i, [float(v) for v in a]) for i, a in enumerate(arrays)], "video int, frame_idx long, px array<double>")


def test_background_of_constant_frames(spark):
    of = frames(spark, [[128] * 16] * 5)
    model = bg.statistics(bg.cells(of))
    assert all(r["mean"] == 128 and r["std"] == 2.0 and r.n == 5 for r in model.collect())
    out = bg.foreground(of, model).first()
    assert not any(out["mask"]) and set(out.residual) == {0}


def test_foreground_patch_and_box(spark):
    flat = [100] * 64
    patch = [200 if 2 <= k // 8 < 5 and 3 <= k % 8 < 6 else 100 for k in range(64)]
    model = bg.statistics(bg.cells(frames(spark, [flat] * 4)))
    row = bg.foreground(frames(spark, [patch]), model).select("mask", bg.bounding_box(F.col("mask"), 8, 8, 1).alias("b"), bg.energy(F.col("residual"), F.col("mask")).alias("e")).first()
    assert row["mask"][3 * 8 + 4] and not row["mask"][0] and row.e == 100.0
    assert tuple(row.b) == (1, 2, 6, 7)


def test_box_without_foreground_is_the_frame(spark):
    row = spark.range(1).select(bg.bounding_box(F.array_repeat(F.lit(False), 64), 8, 8).alias("b")).first()
    assert tuple(row.b) == (0, 0, 8, 8)


def test_no_model_means_all_foreground(spark):
    of = frames(spark, [[1] * 4])
    row = bg.foreground(of, bg.statistics(bg.cells(of.where("false")))).first()
    assert row["mask"] == [True] * 4 and row.residual == [1] * 4


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_with_previous_is_lag(spark, bucket):
    rows = [(k % 2, t, t * 10) for k in range(2) for t in (0, 1, 2, 5, 6, 7, 20, 21)]
    df = spark.createDataFrame(rows, "key int, t long, v int")
    got = {(r.key, r.t): r.prev_v for r in sequence.with_previous(df, "key", "t", ["v"], bucket).collect()}
    ts = sorted({t for _, t, _ in rows})
    for k in range(2):
        for a, b in zip([None, *ts], ts):
            assert got[(k, b)] == (None if a is None else a * 10)


def plain_cuts(energy, shortest, longest, width, valley):
    n = len(energy)
    s = np.array(energy)
    if n >= 2 * width + 1:
        s = np.convolve(s, sequence.gaussian_kernel(width), mode="same")
    top, cuts, last = np.maximum.accumulate(s), [0], 0
    for i in range(1, n - 1):
        if i - last >= shortest and (i - last > longest or (s[i] < top[i] * valley and s[i] <= s[i - 1] and s[i] <= s[i + 1])):
            cuts.append(i)
            last = i
    return [*cuts, n]


def test_cycles_cover_all_frames(spark):
    rng = np.random.default_rng(0)
    periodic = np.clip((np.cos(np.linspace(0, 12 * np.pi, 300)) + 1) / 2 + rng.normal(0, 0.05, 300), 0, None)
    for energy in (periodic, np.ones(180)):
        df = spark.createDataFrame([(0, t, float(e)) for t, e in enumerate(energy)], "video int, t long, energy double")
        cuts = seg.boundaries(df, shortest=5, width=3, valley=0.5)
        assert [r.t for r in cuts.orderBy("ord").collect()] == plain_cuts(energy, 5, 3600, 3, 0.5)
        rows = seg.representatives(seg.cycles(df, cuts)).orderBy("cycle_id").collect()
        assert rows[0].start_frame == 0 and rows[-1].end_frame == len(energy)
        assert all(a.end_frame == b.start_frame for a, b in zip(rows, rows[1:]))
        assert any(r.is_canonical for r in rows) and all(rows[r.canonical_cycle].is_canonical for r in rows)


def test_frame_types_have_period_26(spark):
    kinds = [r.t for r in spark.range(60).select(prediction.frame_type(F.col("id")).alias("t")).collect()]
    assert [k for k, t in enumerate(kinds) if t == "I"] == [0, 26, 52]


def test_phase_offset_finds_a_shift(spark):
    rng = np.random.default_rng(2)
    base = rng.uniform(-50, 50, (40, 4))
    a = spark.createDataFrame([(0, k, base[k].tolist()) for k in range(30)], "pair int, k int, px array<double>")
    b = spark.createDataFrame([(0, k, base[k - 3].tolist() if k >= 3 else [99.0] * 4) for k in range(30)], "pair int, k int, px array<double>")
    best = prediction.best_offset(prediction.phase_offsets(a, b)).first()
    assert best.offset == 3 and best.mse == 0.0


def test_sequence_mse(spark):
    a = spark.createDataFrame([(0, k, [100.0] * 4) for k in range(10)], "pair int, k int, px array<double>")
    b = spark.createDataFrame([(0, k, [200.0] * 4) for k in range(10)], "pair int, k int, px array<double>")
    assert prediction.sequence_mse(a, a).first().mse == 0 and prediction.sequence_mse(a, b).first().mse == 10_000


def test_closed_loop_does_not_drift(spark):
    rng = np.random.default_rng(3)
    px = np.clip(np.cumsum(rng.normal(0, 3, (60, 64)), axis=0) + 120, 0, 255)
    of = spark.createDataFrame([(0, k, px[k].tolist()) for k in range(60)], "video int, k int, px array<double>")
    back = spark.createDataFrame([(0, [120.0] * 64)], "video int, mean array<double>")
    out = prediction.closed_loop(of, back, transform.quant_table(90)).orderBy("k").collect()
    errors = [((np.array(r.decoded) - px[r.k]) ** 2).mean() for r in out]
    assert len(out) == 60 and max(errors) < 20 and np.mean(errors[20:26]) < 3 * np.mean(errors[1:6]) + 1


def test_vq_nearest_and_code_zero(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 20, (4, 64))
    blocks = spark.createDataFrame([(k, (centres[k % 4] + rng.normal(0, 2, 64)).tolist()) for k in range(80)], "id int, levels array<double>")
    book = vq.train(blocks, 4)
    rows = book.orderBy("code").collect()
    norms = [np.linalg.norm(r.centroid) for r in rows]
    assert norms[0] == min(norms)
    x, c = {r.id: np.array(r.levels) for r in blocks.collect()}, np.array([r.centroid for r in rows])
    for r in vq.encode(blocks, book).collect():
        d = ((c - x[r.id]) ** 2).sum(axis=1)
        assert r.code == d.argmin() and np.isclose(r.dist, d.min())
    back = book.select("centroid", vq.unpack_half(vq.pack_half("centroid")).alias("b")).collect()
    assert all(np.allclose(r.centroid, r.b, atol=0.1) for r in back)


def test_fewer_blocks_than_codes(spark):
    blocks = spark.createDataFrame([(1, [1.0] * 64)], "id int, levels array<double>")
    rows = vq.train(blocks, 3).orderBy("code").collect()
    assert sum(rows[0].centroid) == 0.0 and sorted(sum(r.centroid) for r in rows) == [0.0, 0.0, 64.0]


def test_static_gyro_keeps_the_identity(spark):
    df = spark.createDataFrame([(0, k, 0.0, 0.0, 0.0, 0.005) for k in range(1, 201)], "video int, seq long, gx double, gy double, gz double, dt double")
    last = imu.integrate(df).orderBy(F.desc("seq")).first().q
    assert tuple(last) == (0.0, 0.0, 0.0, 1.0)
    assert df.where(imu.emits(F.col("seq"))).count() == 30


def test_integration_across_runs(spark):
    n = 5000
    df = spark.range(1, n + 1).select(F.lit(0).alias("video"), F.col("id").alias("seq"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.3).alias("gz"), F.lit(0.005).alias("dt"))
    q = imu.integrate(df).where(F.col("seq") == n).first().q
    half = 0.3 * 0.005 * n / 2
    assert abs(abs(q.z * np.sin(half) + q.w * np.cos(half)) - 1) < 1e-6


def test_quaternion_inverse(spark):
    q = imu.normalise(imu.quaternion(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.9)))
    p = spark.range(1).select(imu.multiply(q, imu.conjugate(q)).alias("p")).first().p
    assert np.allclose(tuple(p), (0, 0, 0, 1))


def test_warp_by_identity(spark):
    px = [float(v) for v in range(64)]
    df = spark.createDataFrame([(0, 0, px)], "video int, frame_idx int, px array<double>").withColumn("q", imu.quaternion(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert np.allclose(imu.warp(df, 8, 8).first().px, px)


def test_banding_and_ssim(spark):
    rows = [(0, k, [float(k)] * 64, [float(k + (20 if k == 3 else 0))] * 64) for k in range(6)]
    pairs = spark.createDataFrame(rows, "video int, frame_idx long, a array<double>, b array<double>")
    got = metrics.banding(metrics.jumps(pairs)).first()
    assert got.transitions == 5 and got.worst_frame == 3 and got.score == pytest.approx(2 / 5)
    same = pairs.select(metrics.ssim(8, 8)("a", "a").alias("s"), metrics.block_ssim(F.col("a"), F.col("a")).alias("b")).collect()
    assert all(abs(r.s - 1) < 1e-9 and abs(r.b - 1) < 1e-9 for r in same)


def test_interval_and_as_of_joins(spark):
    a = spark.createDataFrame([(1, 0), (1, 10), (1, 25), (2, 10)], "k int, t long")
    b = spark.createDataFrame([(1, 5, "x"), (1, 20, "y"), (2, 11, "z")], "k int, u long, name string")
    pairs = relational.interval_join(a, b, ["k"], F.col("t"), F.col("u"), 5).select("k", "t", "name").collect()
    assert sorted(map(tuple, pairs)) == [(1, 0, "x"), (1, 10, "x"), (1, 25, "y"), (2, 10, "z")]
    left = a.withColumn("id", F.col("t"))
    right = b.select("k", F.col("u").alias("t"), F.col("u").alias("id"), "name")
    got = {(r.k, r.t): r.last_name for r in relational.as_of(left, right, "k", "t", "id", ["name"]).collect()}
    assert got == {(1, 0): None, (1, 10): "x", (1, 25): "y", (2, 10): None}
