"""Queries of orientation, quality and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import imu, metrics
from cadenza.plans.coding import _BACK, _round_trip
from cadenza.plans.inputs import FRAMES, frames, table
from cadenza.plans.registry import query

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
#: A row of lineitem as an axis and an angle, and so a unit quaternion.
_QUATS = """q0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity / 50 AS x, l_discount * 5 AS y, l_tax * 5 AS z, CAST(1 AS DOUBLE) AS w FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM q0))"""


def _quats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = imu.quaternion(F.col("l_quantity") / 50, F.col("l_discount") * 5, F.col("l_tax") * 5, F.lit(1.0))
    return table(spark, sf_dir, "lineitem").select(*_KEY, raw.alias("q")).withColumn("q", imu.normalise(F.col("q")))


def _fields(df: DataFrame, **columns) -> DataFrame:
    return df.select(*_KEY, *((F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in columns.items()))


_ID = ", ".join(_KEY)


@query(f"WITH {_QUATS} SELECT {_ID}, round(w * x + x * w, 6) + 0.0 AS x, round(w * y + y * w, 6) + 0.0 AS y, round(w * z + z * w, 6) + 0.0 AS z, round(w * w - x * x - y * y - z * z, 6) + 0.0 AS w FROM q")
def quat_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quaternion times itself: twice the turn."""
    p = imu.multiply(F.col("q"), F.col("q"))
    return _fields(_quats(spark, sf_dir).withColumn("p", p), **{c: F.col(f"p.{c}") for c in "xyzw"})


@query(f"WITH {_QUATS} SELECT {_ID}, round(-x, 6) + 0.0 AS x, round(-y, 6) + 0.0 AS y, round(-z, 6) + 0.0 AS z, round(w, 6) + 0.0 AS w, CAST(1 AS DOUBLE) AS unit FROM q")
def quat_conjugate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse, and the scalar part of the product with it."""
    c = _quats(spark, sf_dir).withColumn("c", imu.conjugate(F.col("q")))
    return _fields(c, **{k: F.col(f"c.{k}") for k in "xyzw"}, unit=imu.multiply(F.col("q"), F.col("c"))["w"])


_R = """r AS (SELECT *, 1 - 2 * (y * y + z * z) AS r00, 2 * (x * y - z * w) AS r01, 2 * (x * z + y * w) AS r02, 2 * (x * y + z * w) AS r10, 1 - 2 * (x * x + z * z) AS r11,
 2 * (y * z - x * w) AS r12, 2 * (x * z - y * w) AS r20, 2 * (y * z + x * w) AS r21, 1 - 2 * (x * x + y * y) AS r22 FROM q)"""


@query(f"WITH {_QUATS}, {_R} SELECT {_ID}, {', '.join(f'round(r{i}{j}, 6) + 0.0 AS r{i}{j}' for i in range(3) for j in range(3))} FROM r")
def quat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = imu.rotation(F.col("q"))
    return _fields(_quats(spark, sf_dir), **{f"r{i}{j}": r[i][j] for i in range(3) for j in range(3)})


_F, _CX, _CY = 1920 / (2 * 0.9999999999999999), 960.0, 540.0
_KR = {f"k{i}{j}": (f"{_F!r} * r0{j} + {_CX} * r2{j}", f"{_F!r} * r1{j} + {_CY} * r2{j}", f"r2{j}")[i] for i in range(3) for j in range(3)}


@query(f"""WITH {_QUATS}, {_R}, kr AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _KR.items())} FROM r)
SELECT {_ID}, {', '.join(f'round(k{i}0 / {_F!r}, 6) + 0.0 AS h{i}0, round(k{i}1 / {_F!r}, 6) + 0.0 AS h{i}1, round(k{i}2 - k{i}0 * ({_CX} / {_F!r}) - k{i}1 * ({_CY} / {_F!r}), 6) + 0.0 AS h{i}2' for i in range(3))} FROM kr""")
def homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = imu.homography(F.col("q"))
    return _fields(_quats(spark, sf_dir), **{f"h{i}{j}": h[i][j] for i in range(3) for j in range(3)})


_SAMPLES = "s AS (SELECT CAST(l_orderkey % 8 AS BIGINT) AS video, row_number() OVER (PARTITION BY l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gyro samples: lineitem in key order, as eight recordings."""
    rows = table(spark, sf_dir, "lineitem").withColumn("video", F.col("l_orderkey") % 8)
    seq = F.row_number().over(W.partitionBy("video").orderBy(*_KEY)).cast("long")
    return rows.select("video", seq.alias("seq"), F.col("l_tax").alias("gx"), F.col("l_discount").alias("gy"), (F.col("l_quantity") / 50).alias("gz"), F.lit(1 / 200).alias("dt"))


@query(f"WITH {_SAMPLES} SELECT video, seq, seq * 30 // 200 - 1 AS frame FROM s WHERE seq * 30 // 200 > (seq - 1) * 30 // 200")
def imu_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    return _samples(spark, sf_dir).where(imu.emits(seq)).select("video", "seq", imu.frame_of(seq).alias("frame"))


def scan_sql(source: str, levels: int = 17) -> str:
    """CTEs from d (video, seq, gx, gy, gz, dt) to scanned (video, seq, x, y, z, w): products of all turns so far, by doubling."""
    out = f"""d AS ({source}), rates AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS rate FROM d),
s0 AS (SELECT video, seq, CASE WHEN rate * dt <= 1e-10 THEN 0 ELSE gx / rate * sin(rate * dt / 2) END AS x, CASE WHEN rate * dt <= 1e-10 THEN 0 ELSE gy / rate * sin(rate * dt / 2) END AS y,
  CASE WHEN rate * dt <= 1e-10 THEN 0 ELSE gz / rate * sin(rate * dt / 2) END AS z, CASE WHEN rate * dt <= 1e-10 THEN 1 ELSE cos(rate * dt / 2) END AS w FROM rates)"""
    for k in range(levels):
        lags = ", ".join(f"coalesce(lag({c}, {1 << k}) OVER o, {int(c == 'w')}) AS a{c}" for c in "xyzw")
        out += f""", l{k} AS (SELECT *, {lags} FROM s{k} WINDOW o AS (PARTITION BY video ORDER BY seq)),
s{k + 1} AS (SELECT video, seq, aw * x + ax * w + ay * z - az * y AS x, aw * y + ay * w + az * x - ax * z AS y, aw * z + az * w + ax * y - ay * x AS z, aw * w - ax * x - ay * y - az * z AS w FROM l{k})"""
    return out + f""", scanned AS (SELECT video, seq, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM s{levels}))"""


_GYRO = "SELECT CAST(l_orderkey % 8 AS BIGINT) AS video, row_number() OVER (PARTITION BY l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_tax AS gx, l_discount AS gy, l_quantity / 50 AS gz, 1 / 200.0 AS dt FROM lineitem"


@query(f"""WITH {scan_sql(_GYRO)} SELECT video, seq * 30 // 200 - 1 AS frame, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in 'xyzw')} FROM scanned WHERE seq * 30 // 200 > (seq - 1) * 30 // 200""")
def imu_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orientation at each camera frame."""
    out = imu.integrate(_samples(spark, sf_dir)).where(imu.emits(F.col("seq")))
    return out.select("video", imu.frame_of(F.col("seq")).alias("frame"), *((F.round(f"q.{c}", 6) + F.lit(0.0)).alias(c) for c in "xyzw"))


#: The angle of a frame's turn about the view's axis.
_ANGLE = "(frame_idx % 10 * 0.01)"


@query(f"""WITH {FRAMES}, spots AS (SELECT f.video, f.frame_idx, f.px, least(greatest(4 + cos({_ANGLE}) * (p % 8 - 4) + sin({_ANGLE}) * (p // 8 - 4), 0), 7) AS u,
  least(greatest(4 - sin({_ANGLE}) * (p % 8 - 4) + cos({_ANGLE}) * (p // 8 - 4), 0), 7) AS v FROM frames f, range(64) g(p)),
whole AS (SELECT *, least(CAST(floor(u) AS BIGINT), 6) AS u0, least(CAST(floor(v) AS BIGINT), 6) AS v0 FROM spots)
SELECT video, frame_idx, round(sum((px[v0 * 8 + u0 + 1] * (1 - u + u0) + px[v0 * 8 + u0 + 2] * (u - u0)) * (1 - v + v0) + (px[v0 * 8 + u0 + 9] * (1 - u + u0) + px[v0 * 8 + u0 + 10] * (u - u0)) * (v - v0)) / 64, 6) AS mean FROM whole GROUP BY video, frame_idx""")
def stabilise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block frames warped by a small turn about the view's axis that grows with the frame; the mean of the result."""
    a = F.col("frame_idx") % 10 * 0.01
    q = imu.quaternion(F.lit(0.0), F.lit(0.0), F.sin(a / 2), F.cos(a / 2))
    return imu.warp(frames(spark, sf_dir).withColumn("q", q), 8, 8).select("video", "frame_idx", F.round(F.aggregate("px", F.lit(0.0), lambda s, x: s + x) / 64, 6).alias("mean"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir).select("video", "frame_idx", F.col("px").alias("a"), F.col("back").alias("b"))


_PSNR = _BACK + """, errors AS (SELECT video, frame_idx, avg((a - b) ** 2) AS mse FROM pairs GROUP BY video, frame_idx),
psnr AS (SELECT *, CASE WHEN mse < 1e-10 THEN 100.0 ELSE 10 * log10(65025.0 / mse) END AS psnr FROM errors),
rolled AS (SELECT video, count(*) AS n, avg(psnr) AS mean, min(psnr) AS min, max(psnr) AS max, stddev_pop(psnr) AS std FROM psnr GROUP BY video)"""


@query(f"WITH {_PSNR} SELECT video, frame_idx, round(mse, 6) AS mse, round(psnr, 6) AS psnr FROM psnr")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frame_psnr(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mse", "psnr")})


@query(f"WITH {_PSNR} SELECT video, n, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std FROM rolled")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rollup(metrics.frame_psnr(_pairs(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("mean", "min", "max", "std")})


@query(f"WITH {_PSNR} SELECT round(sum(mean * n) / sum(n), 6) AS weighted, CAST(sum(n) AS BIGINT) AS n FROM rolled")
def weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted(metrics.rollup(metrics.frame_psnr(_pairs(spark, sf_dir)))).withColumn("weighted", F.round("weighted", 6))


_JUMPS = _BACK + """, moved AS (SELECT video, frame_idx, cell, abs(a - lag(a) OVER w) AS da, abs(b - lag(b) OVER w) AS db FROM pairs WINDOW w AS (PARTITION BY video, cell ORDER BY frame_idx)),
jumps AS (SELECT video, frame_idx, avg(da) AS orig_jump, avg(db) AS dec_jump, avg(db) / (avg(da) + 0.5) AS ratio FROM moved WHERE da IS NOT NULL GROUP BY video, frame_idx)"""


@query(f"WITH {_JUMPS} SELECT video, frame_idx, round(orig_jump, 6) AS orig_jump, round(dec_jump, 6) AS dec_jump, round(ratio, 6) AS ratio FROM jumps")
def frame_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.jumps(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("orig_jump", "dec_jump", "ratio")})


@query(f"WITH {_JUMPS} SELECT video, count(*) AS transitions, round(avg(CASE WHEN ratio > 2 THEN 1.0 ELSE 0.0 END), 6) AS score, arg_max(frame_idx, (round(ratio, 9), -frame_idx)) AS worst_frame, round(max(ratio), 6) AS worst_ratio FROM jumps GROUP BY video")
def banding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.banding(metrics.jumps(_pairs(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("score", "worst_ratio")})


@query(f"WITH {_JUMPS} SELECT video, frame_idx, round(ratio, 6) AS ratio FROM jumps ORDER BY round(ratio, 9) DESC, frame_idx LIMIT 10")
def top_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst jumps."""
    out = metrics.jumps(_pairs(spark, sf_dir)).orderBy(F.round("ratio", 9).desc(), "frame_idx").limit(10)
    return out.select("video", "frame_idx", F.round("ratio", 6).alias("ratio"))


_SSIM = _BACK + """, moments AS (SELECT video, frame_idx, avg(a) AS ma, avg(b) AS mb, avg(a * a) - avg(a) ** 2 AS va, avg(b * b) - avg(b) ** 2 AS vb, avg(a * b) - avg(a) * avg(b) AS c FROM pairs GROUP BY video, frame_idx)"""


@query(f"WITH {_SSIM} SELECT video, frame_idx, round(((2 * ma * mb + 6.5025) * (2 * c + 58.5225)) / ((ma ** 2 + mb ** 2 + 6.5025) * (va + vb + 58.5225)), 6) AS ssim FROM moments")
def ssim_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("video", "frame_idx", F.round(metrics.block_ssim(F.col("a"), F.col("b")), 6).alias("ssim"))


#: How often each of 8 places is met by the 11 of a window about each, mirrored at the edges; then the moments of windows.
_WINDOWS = _BACK + """, hits AS (SELECT p, CASE WHEN p + o < 0 THEN -1 - p - o WHEN p + o > 7 THEN 15 - p - o ELSE p + o END AS q, count(*) AS n FROM range(8) a(p), range(-5, 6) b(o) GROUP BY 1, 2),
local AS (SELECT c.video, c.frame_idx, y.p AS y, x.p AS x, sum(y.n * x.n * a) / 121 AS ma, sum(y.n * x.n * b) / 121 AS mb, sum(y.n * x.n * a * a) / 121 AS saa, sum(y.n * x.n * b * b) / 121 AS sbb, sum(y.n * x.n * a * b) / 121 AS sab
  FROM pairs c JOIN hits y ON y.q = c.cell // 8 JOIN hits x ON x.q = c.cell % 8 GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_WINDOWS} SELECT video, frame_idx, round(avg(((2 * ma * mb + 6.5025) * (2 * (sab - ma * mb) + 58.5225)) / ((ma ** 2 + mb ** 2 + 6.5025) * (saa - ma ** 2 + sbb - mb ** 2 + 58.5225))), 6) AS ssim
FROM local GROUP BY video, frame_idx""")
def ssim_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index under a sliding window of 11 x 11, mirrored at the edges."""
    return _pairs(spark, sf_dir).select("video", "frame_idx", F.round(metrics.ssim(8, 8)("a", "b"), 6).alias("ssim"))


@query("""SELECT source, count(*) AS chunks, round(avg(length(text)), 6) AS mean_length, CAST(sum(length(text)) + 21 + 6 * count(*) AS BIGINT) AS bytes FROM documents GROUP BY source""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunks of their source's container: count, mean length and what the file would weigh."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("mean_length"), (F.sum(n) + 21 + 6 * F.count("*")).alias("bytes")
    )


@query("""SELECT c_custkey, CAST(floor(2000.0 * (1280 * 720 / 2073600.0) * 1000 / 8 * (greatest(c_acctbal, 0) / 30.0)) AS BIGINT) AS video_bytes,
round(1280 * 720 * 3 * greatest(c_acctbal, 0) / greatest(floor(2000.0 * (1280 * 720 / 2073600.0) * 1000 / 8 * (greatest(c_acctbal, 0) / 30.0)), 1), 6) AS ratio FROM customer""")
def h265_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balance as a number of frames at 720 lines: the estimate, and raw against it."""
    n = F.greatest("c_acctbal", F.lit(0.0))
    out = table(spark, sf_dir, "customer").select("c_custkey", n.alias("n")).withColumn("video_bytes", metrics.video_bytes(F.col("n"), F.lit(30.0), F.lit(1280), F.lit(720)))
    return out.select("c_custkey", "video_bytes", F.round(F.lit(1280 * 720 * 3) * F.col("n") / F.greatest("video_bytes", F.lit(1)), 6).alias("ratio"))


_GRID = [(h, q, r) for h in (540, 720, 1080) for q in (10, 20, 35, 50, 65, 80, 95) for r in (0.5, 0.85)]
_VALUES = ", ".join(f"({h}, {q}, CAST({r} AS DOUBLE))" for h, q, r in _GRID)
_CALC = f"""sc(height, quality, "repeat") AS (VALUES {_VALUES}), sizes(height, a, b, c, kbps) AS (VALUES (540, 81920.0, 204800.0, 460800.0, 500), (720, 153600.0, 409600.0, 921600.0, 1000), (1080, 307200.0, 819200.0, 1843200.0, 2000)),
sized AS (SELECT s.*, z.kbps, CASE WHEN quality <= 20 THEN a WHEN quality <= 50 THEN floor(a + (quality - 20) / 30.0 * (b - a) + 0.5) WHEN quality <= 80 THEN floor(b + (quality - 50) / 30.0 * (c - b) + 0.5)
  ELSE floor(c + (quality - 80) / 20.0 * (c * 0.5) + 0.5) END AS cycle FROM sc s JOIN sizes z ON s.height = z.height),
total AS (SELECT *, 204800 + 3 * cycle + 5757 * ("repeat" * 4 + (1 - "repeat") * cycle * 0.15) AS coded, kbps * 1000 / 8 * 28800.0 AS video FROM sized)"""


@query(f"""WITH {_CALC} SELECT height, quality, "repeat", round(CAST(coded AS DOUBLE), 3) AS coded_bytes, CAST(video AS DOUBLE) AS video_bytes, round(CAST(video / coded AS DOUBLE), 6) AS ratio,
round(CAST(coded * 8000 / 5e8 AS DOUBLE), 6) AS coded_upload_s, round(CAST(video * 8000 / 5e8 AS DOUBLE), 6) AS video_upload_s FROM total""")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight hours of a thousand workers over 500 Mbit/s, for three pictures, seven qualities and two shares of repeats."""
    rows = F.explode(F.array(*(F.struct(F.lit(h).alias("height"), F.lit(q).alias("quality"), F.lit(r).alias("repeat")) for h, q, r in _GRID)))
    scenarios = spark.range(1).select(rows.alias("s")).select("s.*", F.lit(1000).alias("workers"), F.lit(8).alias("hours"), F.lit(500).alias("mbps"))
    out = metrics.calculator(scenarios)
    return out.select("height", "quality", "repeat", F.round("coded_bytes", 3).alias("coded_bytes"), "video_bytes", *(F.round(c, 6).alias(c) for c in ("ratio", "coded_upload_s", "video_upload_s")))


@query(f"WITH {_CALC} SELECT height, quality, CAST(min(cycle) AS DOUBLE) AS cycle_bytes, round(CAST(min(cycle) * 3 / 1024.0 AS DOUBLE), 6) AS representatives_kb FROM total GROUP BY height, quality")
def size_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a representative cycle by picture and quality."""
    rows = F.explode(F.array(*(F.struct(F.lit(h).alias("height"), F.lit(q).alias("quality")) for h, q, r in _GRID if r == 0.5)))
    out = spark.range(1).select(rows.alias("s")).select("s.*")
    out = out.withColumn("cycle_bytes", metrics.cycle_bytes(F.col("height"), F.col("quality")))
    return out.withColumn("representatives_kb", F.round(F.col("cycle_bytes") * 3 / 1024.0, 6))


