"""User-defined aggregates and a table function, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def geometric_mean(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, middle): the geometric mean of the positive numbers of each key; null where there are none.

    Each batch gives the sum of logarithms and the count of its keys. These states add up, so no task holds a key's
    values and a frequent key is many tasks.
    """
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            logs = pc.ln(pc.if_else(pc.greater(v, 0.0), v, None))
            of = pa.table([batch.column(0), logs], [key, "log"]).group_by(key).aggregate([("log", "sum"), ("log", "count")])
            yield from of.select([key, "log_sum", "log_count"]).to_batches()

    pairs = rows.select(key, value.cast("double").alias("_v"))
    state = T.StructType([pairs.schema[0], T.StructField("log_sum", T.DoubleType()), T.StructField("log_count", T.LongType())])
    sums = pairs.mapInArrow(states, state).groupBy(key).agg(F.sum("log_sum").alias("s"), F.sum("log_count").alias("n"))
    return sums.select(key, F.exp(F.try_divide("s", "n")).alias("middle"))


@F.udtf(returnType=T.StructType().add("pos", "integer").add("word", "string"))
class Words:
    """A row for each word of a text, numbered from 0; none of null."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())
