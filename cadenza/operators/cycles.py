"""Segmentation of an energy signal into cycles, and the choice of representatives.

A signal is rows (video, t, energy) with t counting from 0. Cutting is a fold over a video's
ordered scalars, since each cut depends on the one before; everything else is set-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.sequence import cumulative_max, smooth

# Shortest and longest cycle, smoothing, valley, representatives and their least distance.
SHORTEST, LONGEST, WIDTH, VALLEY, MOST, APART = 90, 3600, 15, 0.25, 5, 0.05


def boundaries(signal: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, width: int = WIDTH, valley: float = VALLEY) -> DataFrame:
    """(video, ord, t): 0, the cuts, and the length of the signal."""
    w = W.partitionBy("video").orderBy("t")
    s = cumulative_max(smooth(signal, "video", "t", "energy", width), "video", "t", "smooth")
    low = (F.col("smooth") < F.col("cummax") * valley) & (F.col("smooth") <= F.lag("smooth").over(w)) & (F.col("smooth") <= F.lead("smooth").over(w))
    inner = F.lag("t").over(w).isNotNull() & F.lead("t").over(w).isNotNull()
    points = s.select("video", "t", (low & inner).alias("low"), inner.alias("inner"))
    rows = points.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("t", "low", "inner"))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array(F.lit(0).cast("long")).alias("cuts"))

    def step(state: Column, x: Column) -> Column:
        gap = x["t"] - state["last"]
        cut = x["inner"] & (gap >= shortest) & ((gap > longest) | x["low"])
        return F.when(cut, F.struct(x["t"].cast("long").alias("last"), F.array_append(state["cuts"], x["t"].cast("long")).alias("cuts"))).otherwise(state)

    cuts = F.array_append(F.aggregate("p", start, step)["cuts"], F.size("p").cast("long"))
    return rows.select("video", F.posexplode(cuts).alias("ord", "t"))


def cycles(signal: DataFrame, cuts: DataFrame) -> DataFrame:
    """(video, cycle_id, start_frame, end_frame, energy): the mean energy of each cycle, 0 if it is empty."""
    spans = cuts.withColumn("end_frame", F.lead("t").over(W.partitionBy("video").orderBy("ord"))).where("end_frame is not null")
    spans = spans.select("video", F.col("ord").alias("cycle_id"), F.col("t").alias("start_frame"), "end_frame")
    starts = spans.select("video", F.col("start_frame").alias("t"), "cycle_id").where("start_frame < end_frame")
    # each point belongs to the last cycle that began: a window instead of a range join
    tagged = signal.join(starts, ["video", "t"], "left").withColumn(
        "cycle_id", F.last("cycle_id", ignorenulls=True).over(W.partitionBy("video").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    )
    means = tagged.groupBy("video", "cycle_id").agg(F.avg("energy").alias("energy"))
    return spans.join(means, ["video", "cycle_id"], "left").select("video", "cycle_id", "start_frame", "end_frame", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def features(of: DataFrame) -> DataFrame:
    """cycles with fe and fl: energy and length as parts of the video's largest."""
    w = W.partitionBy("video")
    length = F.col("end_frame") - F.col("start_frame")
    return of.withColumn("fe", F.col("energy") / (F.max("energy").over(w) + 1e-6)).withColumn("fl", length / (F.max(length).over(w) + 1e-6))


def representatives(of: DataFrame, most: int = MOST, apart: float = APART, median: str = "mean") -> DataFrame:
    """cycles with is_canonical, canonical_idx and canonical_cycle added.

    The first representative is the cycle nearest the median energy; each further one is the cycle
    furthest from those chosen, until most are chosen or none is apart enough; a cycle belongs to the
    nearest. Ties go to the lower cycle. canonical_idx is the order of choice. median: "mean" of the
    middle pair, or "upper" of it.
    """
    rows = F.array_sort(F.collect_list(F.struct("cycle_id", "energy", "fe", "fl", "start_frame", "end_frame")))
    held = features(of).groupBy("video").agg(rows.alias("c"))
    energies = F.array_sort(F.col("c.energy"))
    n = F.size("c")
    upper = F.element_at(energies, (F.floor(n / 2) + 1).cast("int"))
    middle = upper if median == "upper" else F.when(n % 2 == 1, upper).otherwise((F.element_at(energies, (F.floor(n / 2)).cast("int")) + upper) / 2)

    def distance(a: Column, b: Column) -> Column:
        return F.sqrt((a["fe"] - b["fe"]) * (a["fe"] - b["fe"]) + (a["fl"] - b["fl"]) * (a["fl"] - b["fl"]))

    off = F.transform("c", lambda x: F.abs(x["energy"] - F.col("middle")))
    held = held.withColumn("middle", middle).withColumn("chosen", F.array(F.array_position(off, F.array_min(off)).cast("int") - 1))

    def grow(chosen: Column, _: Column) -> Column:
        least = F.transform("c", lambda x, i: F.when(F.array_contains(chosen, i), F.lit(-1.0)).otherwise(F.array_min(F.transform(chosen, lambda k: distance(x, F.get(F.col("c"), k))))))
        best = F.array_max(least)
        more = (F.size(chosen) < n) & (best >= apart)
        return F.when(more, F.array_append(chosen, F.array_position(least, best).cast("int") - 1)).otherwise(chosen)

    rounds = F.sequence(F.lit(2), F.lit(most)) if most > 1 else F.array().cast("array<int>")
    held = held.withColumn("chosen", F.aggregate(rounds, F.col("chosen"), grow))
    to = F.transform("c", lambda x: F.transform("chosen", lambda k: distance(x, F.get(F.col("c"), k))))
    held = held.withColumn("near", F.transform(to, lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1))
    rows = held.select("video", "chosen", "near", F.posexplode("c").alias("i", "x"))
    own = F.array_position("chosen", F.col("i")).cast("int") - 1
    index = F.when(own >= 0, own).otherwise(F.get("near", F.col("i")))
    return rows.select(
        "video", "x.cycle_id", "x.start_frame", "x.end_frame", "x.energy", (own >= 0).alias("is_canonical"), index.alias("canonical_idx"),
        F.get("chosen", index).alias("canonical_cycle"),
    )
