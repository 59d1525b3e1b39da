"""Queries of background models and foreground."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import background as bg
from cadenza.operators import prediction
from cadenza.operators.sequence import with_previous
from cadenza.plans.inputs import CELLS, FRAMES, MODEL, frames
from cadenza.plans.registry import query


def _r(c, n: int = 6):
    return F.round(c, n)


@query(f"""WITH {FRAMES}, lagged AS (SELECT video, frame_idx, px, lag(px) OVER (PARTITION BY video ORDER BY frame_idx) AS prev FROM frames),
parts AS (SELECT video, frame_idx, unnest(px) AS a, unnest(coalesce(prev, px)) AS b FROM lagged)
SELECT video, frame_idx, round(avg(abs(a - b)), 6) AS energy FROM parts GROUP BY video, frame_idx""")
def motion_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.motion_energy(frames(spark, sf_dir)).withColumn("energy", _r("energy"))


@query(f"WITH {MODEL} SELECT video, cell, n, round(mean, 6) AS mean, round(std, 6) AS std FROM model")
def background_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.statistics(bg.cells(frames(spark, sf_dir))).withColumns({"mean": _r("mean"), "std": _r("std")})


@query(f"""WITH {CELLS}, warm AS (SELECT * FROM cells WHERE frame_idx < 300)
SELECT video, cell, count(v) AS n, round(avg(v), 6) AS mean, round(greatest(coalesce(stddev_samp(v), 0), 2.0), 6) AS std FROM warm GROUP BY video, cell""")
def background_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.statistics(bg.cells(frames(spark, sf_dir)), bg.WARMUP).withColumns({"mean": _r("mean"), "std": _r("std")})


@query(f"WITH {MODEL} SELECT video, cell, CAST(trunc(least(greatest(mean, 0), 255)) AS INTEGER) AS plate FROM model")
def background_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.plate(bg.statistics(bg.cells(frames(spark, sf_dir))))


def _foreground(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    of = frames(spark, sf_dir)
    return bg.foreground(of, bg.statistics(bg.cells(of)), **kw)


_FG = MODEL + """, fg AS (SELECT c.video, c.frame_idx, c.cell, c.v, m.mean, abs(c.v - m.mean) / m.std > 3.5 AS sigma,
  abs(c.v - m.mean) / m.std > 3.5 OR abs(c.v - m.mean) > 25 AS mask,
  CAST(trunc(c.v) AS INTEGER) - CAST(trunc(m.mean) AS INTEGER) AS d FROM cells c JOIN model m ON c.video = m.video AND c.cell = m.cell)"""


@query(f"WITH {_FG} SELECT video, frame_idx, count(*) FILTER (WHERE mask) AS fg_cells FROM fg GROUP BY video, frame_idx")
def foreground_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _foreground(spark, sf_dir).select("video", "frame_idx", F.size(F.filter("mask", lambda m: m)).cast("long").alias("fg_cells"))


@query(f"WITH {_FG} SELECT video, frame_idx, count(*) FILTER (WHERE sigma) AS fg_cells FROM fg GROUP BY video, frame_idx")
def foreground_mask_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _foreground(spark, sf_dir, absolute=None).select("video", "frame_idx", F.size(F.filter("mask", lambda m: m)).cast("long").alias("fg_cells"))


@query(f"""WITH {_FG}, known AS (SELECT * FROM fg WHERE video < 5)
SELECT video, frame_idx, count(*) FILTER (WHERE mask) AS fg_cells FROM known GROUP BY video, frame_idx
UNION ALL SELECT video, frame_idx, 64 FROM frames WHERE video >= 5""")
def public_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos from 5 on have no model yet: all is foreground."""
    of = frames(spark, sf_dir)
    out = bg.foreground(of, bg.statistics(bg.cells(of.where("video < 5"))))
    return out.select("video", "frame_idx", F.size(F.filter("mask", lambda m: m)).cast("long").alias("fg_cells"))


@query(f"WITH {_FG} SELECT video, frame_idx, CAST(sum(CASE WHEN mask THEN d ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN mask THEN abs(d) ELSE 0 END) AS BIGINT) AS magnitude FROM fg GROUP BY video, frame_idx")
def background_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return _foreground(spark, sf_dir).select(
        "video", "frame_idx", F.aggregate("residual", zero, lambda s, x: s + x).alias("total"), F.aggregate("residual", zero, lambda s, x: s + F.abs(x)).alias("magnitude")
    )


@query(f"WITH {_FG} SELECT video, frame_idx, round(coalesce(avg(abs(d)) FILTER (WHERE mask), 0), 6) AS energy FROM fg GROUP BY video, frame_idx")
def foreground_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _foreground(spark, sf_dir).select("video", "frame_idx", _r(bg.energy(F.col("residual"), F.col("mask"))).alias("energy"))


@query(f"""WITH {_FG}, box AS (SELECT video, frame_idx, min(cell // 8) FILTER (WHERE sigma) AS a, max(cell // 8) FILTER (WHERE sigma) AS b,
  min(cell % 8) FILTER (WHERE sigma) AS c, max(cell % 8) FILTER (WHERE sigma) AS d FROM fg GROUP BY video, frame_idx)
SELECT video, frame_idx, CAST(CASE WHEN a IS NULL THEN 0 ELSE greatest(a - 1, 0) END AS INTEGER) AS y0, CAST(CASE WHEN a IS NULL THEN 0 ELSE greatest(c - 1, 0) END AS INTEGER) AS x0,
  CAST(CASE WHEN a IS NULL THEN 8 ELSE least(b + 2, 8) END AS INTEGER) AS y1, CAST(CASE WHEN a IS NULL THEN 8 ELSE least(d + 2, 8) END AS INTEGER) AS x1 FROM box""")
def fg_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _foreground(spark, sf_dir, absolute=None)
    return out.select("video", "frame_idx", bg.bounding_box(F.col("mask"), 8, 8, 1).alias("b")).select("video", "frame_idx", "b.*")


@query(f"""WITH {_FG}, both_masks AS (SELECT video, frame_idx, cell, mask, coalesce(lag(mask) OVER (PARTITION BY video, cell ORDER BY frame_idx), false) AS prev FROM fg)
SELECT video, frame_idx, count(*) FILTER (WHERE mask OR prev) AS cells, count(*) FILTER (WHERE NOT mask AND prev) AS uncovered FROM both_masks GROUP BY video, frame_idx""")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are foreground now or were in the frame before, and those just uncovered."""
    out = _foreground(spark, sf_dir)
    out = with_previous(out.select("video", "frame_idx", "mask"), "video", "frame_idx", ["mask"])
    out = out.withColumn("prev", F.coalesce("prev_mask", F.transform("mask", lambda m: F.lit(False))))
    count = lambda test: F.size(F.filter(F.zip_with("mask", "prev", test), lambda m: m)).cast("long")
    return out.select("video", "frame_idx", count(lambda a, b: a | b).alias("cells"), count(lambda a, b: ~a & b).alias("uncovered"))


@query(f"""WITH RECURSIVE {MODEL}, series AS (SELECT video, frame_idx, v, cell, row_number() OVER (PARTITION BY video, cell ORDER BY frame_idx) AS i FROM cells),
drift AS (SELECT m.video, m.cell, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS frame_idx, m.mean AS mu, m.std FROM model m
  UNION ALL SELECT d.video, d.cell, s.i, s.frame_idx, CASE WHEN abs(s.v - d.mu) / d.std > 3.5 OR abs(s.v - d.mu) > 25 THEN d.mu ELSE d.mu + 0.002 * (s.v - d.mu) END, d.std
  FROM drift d JOIN series s ON d.video = s.video AND d.cell = s.cell AND s.i = d.i + 1)
SELECT video, CAST(cell AS INTEGER) AS cell, frame_idx, round(mu, 6) AS mu FROM drift WHERE i > 0""")
def ema_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = frames(spark, sf_dir)
    return bg.drift(of, bg.statistics(bg.cells(of))).withColumn("mu", _r("mu"))
