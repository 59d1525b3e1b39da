"""How the operators' inputs come from the tables, in Spark and in SQL.

Block frames are embeddings: a label is a video, a vec_id a frame, 64 numbers times 255 its cells.
The signal is the hourly mean value of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import prediction
from cadenza.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("video"), F.col("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double") * 255).alias("px"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.numbered(frames(spark, sf_dir))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, t, energy): change of the hourly mean of value, hours without events left out."""
    hourly = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts")).alias("h")).agg(F.avg("value").alias("x"))
    w = W.partitionBy("video").orderBy("h")
    return hourly.withColumn("video", F.lit(0)).select("video", (F.row_number().over(w) - 1).alias("t"), F.coalesce(F.abs(F.col("x") - F.lag("x").over(w)), F.lit(0.0)).alias("energy"))


FRAMES = "frames AS (SELECT label AS video, vec_id AS frame_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 255) AS px FROM embeddings)"
NUMBERED = FRAMES + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS k FROM frames)"
CELLS = FRAMES + ", cells AS (SELECT video, frame_idx, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS cell FROM frames)"
MODEL = CELLS + ", model AS (SELECT video, cell, count(v) AS n, avg(v) AS mean, greatest(coalesce(stddev_samp(v), 0), 2.0) AS std FROM cells GROUP BY video, cell)"
SIGNAL = """hourly AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS x FROM events GROUP BY 1),
signal AS (SELECT 0 AS video, row_number() OVER (ORDER BY h) - 1 AS t, coalesce(abs(x - lag(x) OVER (ORDER BY h)), 0) AS energy FROM hourly)"""


def stream_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A table's path, for streams."""
    ship(spark)
    return f"{sf_dir}/{name}.parquet"
