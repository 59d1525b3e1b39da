"""Queries of segmentation and representatives, over the hourly signal of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import cycles as seg
from cadenza.operators import sequence
from cadenza.plans.inputs import SIGNAL, signal
from cadenza.plans.registry import query

#: Cycle lengths and the valley for a signal of some hundred hours.
SHORTEST, LONGEST, VALLEY = 6, 48, 0.9
_KERNEL = sequence.gaussian_kernel(15)
_WEIGHTS = ", ".join(f"({j}, {w!r})" for j, w in zip(range(-15, 16), _KERNEL, strict=True))
_SMOOTH = SIGNAL + f""", n AS (SELECT count(*) AS n FROM signal), kernel(j, w) AS (VALUES {_WEIGHTS}),
smoothed AS (SELECT s.video, s.t, CASE WHEN min(n.n) < 31 THEN min(s.energy) ELSE sum(k.w * coalesce(o.energy, 0)) END AS smooth
  FROM signal s CROSS JOIN kernel k CROSS JOIN n LEFT JOIN signal o ON o.t = s.t + k.j GROUP BY s.video, s.t)"""


@query(f"WITH {SIGNAL} SELECT video, t, round(energy, 6) AS energy FROM signal")
def energy_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("video", F.col("t").cast("long").alias("t"), F.round("energy", 6).alias("energy"))


@query(f"WITH {_SMOOTH} SELECT video, t, round(smooth, 6) AS smooth FROM smoothed")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.smooth(signal(spark, sf_dir), "video", "t", "energy")
    return out.select("video", F.col("t").cast("long").alias("t"), F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {SIGNAL}, n AS (SELECT count(*) AS n FROM signal), kernel(j, w) AS (VALUES {_WEIGHTS})
SELECT s.video, s.t, round(sum(k.w * o.energy), 6) AS smooth FROM signal s CROSS JOIN kernel k CROSS JOIN n JOIN signal o ON o.t = least(greatest(s.t + k.j, 0), n.n - 1) GROUP BY s.video, s.t""")
def gaussian_smooth_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.smooth(signal(spark, sf_dir), "video", "t", "energy", padding="edge")
    return out.select("video", F.col("t").cast("long").alias("t"), F.round("smooth", 6).alias("smooth"))


@query(f"WITH {SIGNAL} SELECT video, t, round(max(energy) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS cummax FROM signal")
def cumulative_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.cumulative_max(signal(spark, sf_dir), "video", "t", "energy")
    return out.select("video", F.col("t").cast("long").alias("t"), F.round("cummax", 6).alias("cummax"))


_CUTS = _SMOOTH.replace("WITH ", "") + f""", marks AS (SELECT t, smooth < {VALLEY} * max(smooth) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)
    AND smooth <= lag(smooth) OVER (ORDER BY t) AND smooth <= lead(smooth) OVER (ORDER BY t) AS low FROM smoothed),
cut AS (SELECT CAST(0 AS BIGINT) AS t UNION ALL
  SELECT (SELECT min(m.t) FROM marks m, n WHERE m.t >= 1 AND m.t < n.n - 1 AND m.t - cut.t >= {SHORTEST} AND (m.t - cut.t > {LONGEST} OR m.low)) FROM cut WHERE cut.t IS NOT NULL),
cuts AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS ord, t FROM (SELECT t FROM cut WHERE t IS NOT NULL UNION ALL SELECT n FROM n)),
spans AS (SELECT ord AS cycle_id, t AS start_frame, lead(t) OVER (ORDER BY ord) AS end_frame FROM cuts),
cycles AS (SELECT cycle_id, start_frame, end_frame, coalesce((SELECT avg(energy) FROM signal s WHERE s.t >= start_frame AND s.t < end_frame), 0) AS energy FROM spans WHERE end_frame IS NOT NULL)"""


def _cuts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    of = signal(spark, sf_dir).withColumn("t", F.col("t").cast("long"))
    return of, seg.boundaries(of, SHORTEST, LONGEST, valley=VALLEY)


@query(f"WITH RECURSIVE {_CUTS} SELECT 0 AS video, ord, t FROM cuts")
def cycle_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {_CUTS} SELECT 0 AS video, cycle_id, start_frame, end_frame, round(energy, 6) AS energy FROM cycles")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.cycles(*_cuts(spark, sf_dir)).withColumn("energy", F.round("energy", 6))


def _chosen(median: str) -> str:
    """Five rounds of the choice, a CTE each."""
    middle = "median(energy)" if median == "mean" else "list_sort(list(energy))[CAST(floor(count(*) / 2) AS BIGINT) + 1]"
    out = _CUTS + f""", feats AS (SELECT *, energy / (max(energy) OVER () + 1e-6) AS fe, (end_frame - start_frame) / (max(end_frame - start_frame) OVER () + 1e-6) AS fl FROM cycles),
middle AS (SELECT {middle} AS m FROM feats), chosen0 AS (SELECT 0 AS idx, arg_min(cycle_id, (abs(energy - m), cycle_id)) AS cycle_id FROM feats, middle)"""
    for k in range(1, 5):
        out += f""", far{k} AS (SELECT f.cycle_id, min(sqrt((f.fe - g.fe) ** 2 + (f.fl - g.fl) ** 2)) AS d FROM feats f, chosen{k - 1} c JOIN feats g ON g.cycle_id = c.cycle_id
  WHERE f.cycle_id NOT IN (SELECT cycle_id FROM chosen{k - 1}) GROUP BY f.cycle_id),
chosen{k} AS (SELECT * FROM chosen{k - 1} UNION ALL SELECT {k}, cycle_id FROM (SELECT cycle_id, d FROM far{k} ORDER BY d DESC, cycle_id LIMIT 1) WHERE d >= 0.05)"""
    return out + """, near AS (SELECT f.cycle_id, arg_min(c.idx, (sqrt((f.fe - g.fe) ** 2 + (f.fl - g.fl) ** 2), c.idx)) AS idx FROM feats f, chosen4 c JOIN feats g ON g.cycle_id = c.cycle_id GROUP BY f.cycle_id),
assigned AS (SELECT f.*, o.idx IS NOT NULL AS is_canonical, CAST(coalesce(o.idx, n.idx) AS INTEGER) AS canonical_idx FROM feats f JOIN near n ON n.cycle_id = f.cycle_id LEFT JOIN chosen4 o ON o.cycle_id = f.cycle_id)"""


def _representatives(spark: SparkSession, sf_dir: str, median: str = "mean") -> DataFrame:
    return seg.representatives(seg.cycles(*_cuts(spark, sf_dir)), median=median)


@query(f"WITH RECURSIVE {_chosen('mean')} SELECT 0 AS video, cycle_id, canonical_idx FROM assigned WHERE is_canonical")
def canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representatives(spark, sf_dir).where("is_canonical").select("video", "cycle_id", "canonical_idx")


@query(f"WITH RECURSIVE {_chosen('mean')} SELECT 0 AS video, cycle_id FROM chosen0")
def canonical_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representatives(spark, sf_dir).where("is_canonical and canonical_idx = 0").select("video", "cycle_id")


@query(f"WITH RECURSIVE {_chosen('upper')} SELECT 0 AS video, cycle_id FROM chosen0")
def canonical_seed_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representatives(spark, sf_dir, "upper").where("is_canonical and canonical_idx = 0").select("video", "cycle_id")


@query(f"WITH RECURSIVE {_chosen('mean')} SELECT 0 AS video, a.cycle_id, a.canonical_idx, c.cycle_id AS canonical_cycle FROM assigned a JOIN chosen4 c ON c.idx = a.canonical_idx")
def nearest_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representatives(spark, sf_dir).select("video", "cycle_id", "canonical_idx", F.col("canonical_cycle"))
