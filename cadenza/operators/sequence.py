"""Sequential operators over ordered rows that scale past one task for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, order: str, columns: Sequence[str], bucket: int = 65_536, prefix: str = "prev_") -> DataFrame:
    """Each row with the columns of the row before it in its key, null for the first.

    order is a unique integer within the key. Rows are windowed by (key, order div bucket), so one
    long key spreads over many tasks; only the last row of each bucket crosses to the next bucket.
    """
    part = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    w = W.partitionBy(key, "_bucket").orderBy(order)
    lagged = part.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns} | {"_n": F.row_number().over(w)})
    ends = part.groupBy(key, "_bucket").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_last"))
    # one row for each bucket
    carried = ends.withColumn("_last", F.lag("_last").over(W.partitionBy(key).orderBy("_bucket")))
    joined = lagged.join(carried, [key, "_bucket"], "left")
    first = F.col("_n") == 1
    return joined.select(*df.columns, *(F.when(first, F.col("_last")[c]).otherwise(F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in columns))


def gaussian_kernel(width: int) -> list[float]:
    """2 * width + 1 weights of sum 1, with a deviation of half the width."""
    from math import exp

    w = [exp(-0.5 * (j / (width / 2)) ** 2) for j in range(-width, width + 1)]
    return [x / sum(w) for x in w]


def smooth(signal: DataFrame, key: str, order: str, value: str, width: int = 15, padding: str = "zero", out: str = "smooth") -> DataFrame:
    """Gaussian smoothing of a scalar signal; a series shorter than 2 * width + 1 stays as it is.

    padding: "zero" counts what is beyond the ends as 0, "edge" repeats the first and last value.
    """
    if padding not in ("zero", "edge"):
        raise ValueError(f"padding is zero or edge, not {padding}")
    w = W.partitionBy(key).orderBy(order)
    whole = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    low, high = (F.lit(0.0), F.lit(0.0)) if padding == "zero" else (F.first(value).over(whole), F.last(value).over(whole))
    total: Column = F.lit(0.0)
    for j, weight in zip(range(-width, width + 1), gaussian_kernel(width), strict=True):
        near = F.col(value) if j == 0 else F.coalesce(F.lead(value, j).over(w), high) if j > 0 else F.coalesce(F.lag(value, -j).over(w), low)
        total = total + near * weight
    return signal.withColumn(out, F.when(F.count("*").over(W.partitionBy(key)) < 2 * width + 1, F.col(value)).otherwise(total))


def cumulative_max(signal: DataFrame, key: str, order: str, value: str, out: str = "cummax") -> DataFrame:
    return signal.withColumn(out, F.max(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
