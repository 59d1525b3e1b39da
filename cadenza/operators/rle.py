"""Run-length coding of integer levels: zeros as (0, run up to 255), any other value as (value, 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONGEST = 255


def encode(levels: Column) -> Column:
    """array<int> to array<struct<value, run>>, a fold within the row."""
    pair = "array<struct<value:int,run:int>>"
    start = F.struct(F.lit(0).alias("zeros"), F.array().cast(pair).alias("out"))

    def one(value: Column, run: Column) -> Column:
        return F.array(F.struct(value.cast("int").alias("value"), run.cast("int").alias("run")))

    def step(s: Column, v: Column) -> Column:
        z = s["zeros"]
        zero = F.when(z + 1 == LONGEST, F.struct(F.lit(0).alias("zeros"), F.concat(s["out"], one(F.lit(0), F.lit(LONGEST))).alias("out"))).otherwise(
            F.struct((z + 1).alias("zeros"), s["out"].alias("out"))
        )
        other = F.struct(F.lit(0).alias("zeros"), F.concat(F.when(z > 0, F.concat(s["out"], one(F.lit(0), z))).otherwise(s["out"]), one(v, F.lit(1))).alias("out"))
        return F.when(v == 0, zero).otherwise(other)

    return F.aggregate(levels, start, step, lambda s: F.when(s["zeros"] > 0, F.concat(s["out"], one(F.lit(0), s["zeros"]))).otherwise(s["out"]))


def encode_rows(cells: DataFrame, keys: list[str], pos: str = "pos", value: str = "v") -> DataFrame:
    """The same over rows (keys, pos, v) as gaps and islands: (keys, start, value, run), for series too long for a row."""
    w = W.partitionBy(*keys).orderBy(pos)
    marked = cells.withColumn("_island", F.sum((F.col(value) != 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    zeros = marked.where(F.col(value) == 0).withColumn("_part", F.floor((F.row_number().over(W.partitionBy(*keys, "_island").orderBy(pos)) - 1) / LONGEST))
    runs = zeros.groupBy(*keys, "_island", "_part").agg(F.min(pos).alias("start"), F.count("*").cast("int").alias("run"))
    ones = marked.where(F.col(value) != 0).select(*keys, F.col(pos).alias("start"), F.col(value).cast("int").alias("value"), F.lit(1).alias("run"))
    return ones.unionByName(runs.select(*keys, "start", F.lit(0).alias("value"), "run"))


def decode(pairs: Column, n: Column) -> Column:
    """array<struct<value, run>> to n levels; what is short is filled with zeros, what is long is cut."""
    flat = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["value"], F.when(p["value"] == 0, p["run"]).otherwise(F.lit(1)))))
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0), n)), F.lit(1), n)
