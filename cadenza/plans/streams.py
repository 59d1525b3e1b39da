"""Streaming queries, drained once over the tables; SQL gives the same result in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.inputs import CELLS, FRAMES, MODEL, signal, stream_path
from cadenza.plans.measures import scan_sql
from cadenza.plans.registry import query
from cadenza.plans.segments import _CUTS, LONGEST, SHORTEST, VALLEY
from cadenza.streaming import online


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = online.source(spark, stream_path(spark, sf_dir, "embeddings"))
    return e.select(F.col("label").alias("video"), F.col("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double") * 255).alias("px"))


@query(f"WITH {MODEL} SELECT video, cell, n, round(mean, 6) AS mean, round(std, 6) AS std FROM model")
def stream_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _frames(spark, sf_dir).select("video", "frame_idx", F.posexplode("px").alias("cell", "v"))
    return online.drain(online.background(cells), "complete").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""WITH {FRAMES}, lagged AS (SELECT video, frame_idx, px, lag(px) OVER (PARTITION BY video ORDER BY frame_idx) AS prev FROM frames),
parts AS (SELECT video, frame_idx, unnest(px) AS a, unnest(coalesce(prev, px)) AS b FROM lagged)
SELECT video, frame_idx, round(avg(abs(a - b)), 6) AS energy FROM parts GROUP BY video, frame_idx""")
def stream_motion_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.drain(online.motion_energy(_frames(spark, sf_dir))).withColumn("energy", F.round("energy", 6))


_DRIFT = CELLS + """, series AS (SELECT *, row_number() OVER (PARTITION BY video, cell ORDER BY frame_idx) AS i FROM cells),
warm AS (SELECT video, cell, avg(v) AS mean, greatest(stddev_samp(v), 2.0) AS std FROM series WHERE i <= 20 GROUP BY video, cell),
drift AS (SELECT video, cell, CAST(20 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS frame_idx, mean AS mu, std, false AS fore FROM warm
  UNION ALL SELECT d.video, d.cell, s.i, s.frame_idx, CASE WHEN abs(s.v - d.mu) / d.std > 3.5 OR abs(s.v - d.mu) > 25 THEN d.mu ELSE d.mu + 0.002 * (s.v - d.mu) END, d.std,
    abs(s.v - d.mu) / d.std > 3.5 OR abs(s.v - d.mu) > 25 FROM drift d JOIN series s ON d.video = s.video AND d.cell = s.cell AND s.i = d.i + 1)"""


@query(f"WITH RECURSIVE {_DRIFT} SELECT video, frame_idx, count(*) FILTER (WHERE fore) AS foreground, round(avg(mu), 6) AS level FROM drift WHERE i > 20 GROUP BY video, frame_idx")
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drifting background after a warm-up of 20 frames."""
    out = online.drain(online.drift(_frames(spark, sf_dir), warmup=20)).where("warm")
    return out.select("video", "frame_idx", "foreground", F.round("level", 6).alias("level"))


@query(f"WITH RECURSIVE {_CUTS} SELECT 0 AS video, t FROM cuts, n WHERE t > 0 AND t < n.n - 16")
def stream_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cuts of the hourly signal that are certain before it ends."""
    path = online.folder(spark)
    signal(spark, sf_dir).select("video", F.col("t").cast("long").alias("t"), "energy").write.parquet(path)
    return online.drain(online.cuts(online.source(spark, path), SHORTEST, LONGEST, valley=VALLEY))


@query("""SELECT a.event_id AS id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of their user within twelve hours after, as a join of two streams."""
    side = lambda kind: online.source(spark, stream_path(spark, sf_dir, "events")).where(F.col("event_type") == kind).withColumn("id", F.col("event_id"))
    return online.drain(online.matched(side("click"), side("purchase"), "user_id", "12 HOURS"))


_GYRO = "SELECT user_id AS video, event_id AS seq, sin(value) AS gx, cos(value) AS gy, 0.5 AS gz, 1 / 200.0 AS dt FROM events"


@query(f"WITH {scan_sql(_GYRO, 14)} SELECT video, seq, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in 'xyzw')} FROM scanned")
def stream_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = online.source(spark, stream_path(spark, sf_dir, "events"))
    samples = e.select(F.col("user_id").alias("video"), F.col("event_id").alias("seq"), F.sin("value").alias("gx"), F.cos("value").alias("gy"), F.lit(0.5).alias("gz"), F.lit(1 / 200).alias("dt"))
    return online.drain(online.orientation(samples)).select("video", "seq", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xyzw"))


@query("""WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that an hour's watermark has closed."""
    out = online.drain(online.windows(online.source(spark, stream_path(spark, sf_dir, "events")), "1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, event_type, value FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events twice over, without the repeats."""
    e = online.source(spark, stream_path(spark, sf_dir, "events"))
    twice = e.withColumn("_", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_")
    return online.drain(online.first_seen(twice, "event_id")).select("event_id", "event_type", "value")
