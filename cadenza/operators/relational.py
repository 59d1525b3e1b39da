"""Joins that Spark has no operator for, as compositions that it can spread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, order: str, columns: list[str], prefix: str = "last_", bucket_s: int = 86_400) -> DataFrame:
    """Each row of left with the columns of the last row of right in its key before it, by (time, order).

    time is a timestamp, or a number of seconds. Both sides are unioned and windowed by key and bucket of time, so that a
    hot key is many tasks; a bucket's last row of right is carried to the buckets after it, a row each.
    No row is paired that isn't the answer.
    """
    held = F.struct(*columns)
    kind = dict(left.dtypes)[time]
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000 if kind.startswith(("timestamp", "date")) else F.col(time)
    bucket = F.floor(seconds / bucket_s)
    theirs = right.select(F.col(key), F.col(time), F.col(order), held.alias("_r"), F.lit(0).alias("_side"))
    both = left.select("*", F.lit(None).cast(theirs.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side")).unionByName(theirs, allowMissingColumns=True).withColumn("_bucket", bucket)
    last = F.last("_r", ignorenulls=True).over(W.partitionBy(key, "_bucket").orderBy(time, order, F.col("_side").desc()).rowsBetween(W.unboundedPreceding, -1))
    ends = both.groupBy(key, "_bucket").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct(time, order))).alias("_end"))
    carried = ends.select(key, "_bucket", F.last("_end", ignorenulls=True).over(W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    joined = both.withColumn("_last", last).where("_side = 1").join(carried.withColumnsRenamed({key: "_k", "_bucket": "_b"}), (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_bucket").eqNullSafe(F.col("_b"))), "left")
    return joined.withColumn("_last", F.coalesce("_last", "_carried")).select(*left.columns, *(F.col(f"_last.{c}").alias(f"{prefix}{c}") for c in columns))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, reach: int, tag: str = "_b") -> DataFrame:
    """Pairs in a key whose integers lie at most reach apart: an equi-join on buckets of width reach.

    A row of left goes to its bucket and both neighbours; the keys of right must be named apart from
    the other columns of left.
    """
    a = left.withColumn("_la", left_at).withColumn(tag, F.explode(F.array(*(F.floor(left_at / reach) + d for d in (-1, 0, 1)))))
    b = right.withColumn("_ra", right_at).withColumn(tag, F.floor(right_at / reach))
    return a.join(b, [*keys, tag]).where(F.abs(F.col("_la") - F.col("_ra")) <= reach).drop(tag, "_la", "_ra")


def beside(key: str, *aggregates: DataFrame) -> DataFrame:
    """The columns of aggregates by the same key, in one row of each; null is a key too.

    For what shouldn't share one aggregation: beside a distinct count, Spark keeps and shuffles the states of all other
    aggregates for each distinct value, and a sketch or a percentile's map is large.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggregates)
    return every.groupBy(key).agg(*(F.max(c).alias(c) for c in every.columns if c != key))
