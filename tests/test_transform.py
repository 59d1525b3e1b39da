from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrays, transform
from cadenza.operators import rle
from cadenza.sources import frames as io


def test_quant_table_bounds():
    assert transform.quant_table(50) == transform.LUMA
    assert set(transform.quant_table(100)) == {1}
    assert max(transform.quant_table(1)) == 255
    assert transform.quant_table(50, luma=False)[0] == 17


def test_dct_round_trip_and_nulls(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.uniform(-128, 127, 64).tolist()) for k in range(30)] + [(30, None)]
    out = spark.createDataFrame(rows, "k int, px array<double>").withColumn("back", transform.idct(transform.dct("px"))).collect()
    for r in out:
        assert (r.px is None and r.back is None) or np.allclose(r.px, r.back, atol=1e-9)


def test_dct_of_a_flat_block(spark):
    c = spark.range(1).select(transform.dct(F.array_repeat(F.lit(10.0), 64)).alias("c")).first().c
    assert math.isclose(c[0], 80.0, abs_tol=1e-9) and max(map(abs, c[1:])) < 1e-9


@pytest.mark.parametrize(("value", "level"), [(2.5, 2), (3.5, 4), (-2.5, -2), (1e9, 32767)])
def test_quantise_halves_to_even(spark, value, level):
    got = spark.range(1).select(transform.quantise(F.array(F.lit(value)), F.array(F.lit(1.0))).alias("q")).first().q
    assert got == [level]


def test_colour_round_trip(spark):
    rows = [(float(b), float(g), float(r)) for b, g, r in [(0, 0, 0), (255, 255, 255), (128, 64, 192), (-50, 30, -10), (10, 200, 3)]]
    df = spark.createDataFrame(rows, "b double, g double, r double")
    y, cb, cr = transform.ycbcr(F.col("b"), F.col("g"), F.col("r"))
    back = transform.bgr(y, cb, cr)
    for row in df.select("b", "g", "r", *(c.alias(f"{n}2") for n, c in zip("bgr", back, strict=True))).collect():
        assert all(abs(row[n] - row[f"{n}2"]) < 0.01 for n in "bgr")


def plain_rle(values):
    out, i = [], 0
    while i < len(values):
        if values[i]:
            out.append((values[i], 1))
            i += 1
            continue
        j = i
        while j < len(values) and values[j] == 0 and j - i < 255:
            j += 1
        out.append((0, j - i))
        i = j
    return out


def test_rle_against_a_loop(spark):
    rng = random.Random(1)
    series = [[], [0], [5], [0] * 254, [0] * 255, [0] * 256, [0] * 510 + [1], [0] * 600 + [3] + [0] * 300]
    series += [[rng.choice([0, 0, 0, 7, -300]) for _ in range(rng.randint(1, 600))] for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(series)), "id int, v array<int>")
    coded = df.withColumn("p", rle.encode(F.col("v")))
    back = coded.withColumn("d", rle.decode(io.unpack_pairs(io.inflate(io.deflate()(io.pack_pairs("p")))), F.size("v")))
    for r in back.collect():
        assert [tuple(x) for x in r.p] == plain_rle(r.v) and list(r.d) == list(r.v)
    rows = rle.encode_rows(df.select("id", F.posexplode("v").alias("pos", "v")), ["id"]).collect()
    for k, v in enumerate(series):
        assert [(r.value, r.run) for r in sorted((r for r in rows if r.id == k), key=lambda r: r.start)] == plain_rle(v)


def test_rle_decode_is_tolerant(spark):
    pairs = spark.range(1).select(F.expr("array(named_struct('value', 3, 'run', 9), named_struct('value', 0, 'run', 2))").alias("p"))
    assert pairs.select(rle.decode(F.col("p"), F.lit(5)).alias("d")).first().d == [3, 0, 0, 0, 0]
    assert pairs.select(rle.decode(F.col("p"), F.lit(2)).alias("d")).first().d == [3, 0]


def test_psnr_of_equal_frames(spark):
    row = spark.range(1).select(arrays.psnr(F.lit(0.0)).alias("same"), arrays.psnr(F.lit(255.0**2)).alias("worst")).first()
    assert row.same == 100.0 and abs(row.worst) < 1e-9
