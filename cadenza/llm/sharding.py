"""Sharding by a k-d tree over metadata.

All rows of one text are a group and stay together. A group has four dimensions (smallest doc_id,
length, smallest language, smallest source) and weighs its bytes. From the root, each node is cut
along its widest dimension at the weighted median (or the weighted quantile that its odd number of
shards asks for), until a leaf is one shard. A dimension is 20 bits, with 40 bits of the group's
hash below, so that a cut can fall between groups that are equal in the dimension.

Medians are found for all nodes of a level at once by histograms of 1,024 bins, refined about the
cut until the bin is a small part of a shard. A driver sees a thousand sums for each node, never a
list of groups; each pass is a sum over a narrow table.

A group of copies can weigh as much as a shard. Groups of HEAVY of a shard or more, of which there
are at most shards / HEAVY, are dealt first, the heaviest to the lightest shard; the tree then deals
the others in proportion to the room that each shard has left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import written

BINS, VALUE_BITS, HASH_BITS = 10, 20, 40
TOP = 1 << (VALUE_BITS + HASH_BITS)
#: A cut is fine enough where the bin about it weighs this part of a shard.
TOLERANCE = 0.002
#: Groups of this part of a shard are dealt before the tree.
HEAVY = 0.02
ROWS_IN_BUCKET = 200_000
DIMENSIONS = 4


@dataclass
class Node:
    first: int
    shards: int
    dimension: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def shard(self) -> Column:
        """The first shard of the leaf that a group falls into."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(f"c{self.dimension}") < F.lit(self.cut), self.left.shard()).otherwise(self.right.shard())


def _case(of: Column, values: dict[int, Column]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def deal(heavy: list[int], rest: int, shards: int) -> tuple[list[int], list[float]]:
    """For heavy weights, in descending order, their shards; and the room of each shard for the rest."""
    sums, to = [0] * shards, []
    for w in heavy:
        to.append(sums.index(min(sums)))
        sums[to[-1]] += w
    level, below = 0.0, sorted(sums)
    for n in range(1, shards + 1):  # the rest fills the n lightest shards to one level
        level = (rest + sum(below[:n])) / n
        if n == shards or level <= below[n]:
            break
    return to, [max(0.0, level - s) for s in sums]


def tree(groups: DataFrame, room: list[float]) -> Node:
    """The k-d tree of groups (c0 .. c3, weight) over shards with so much room."""
    shards = len(room)
    root = Node(0, shards)
    total = groups.agg(F.sum("weight")).first()[0] or 0
    while wide := [n for n in root.leaves() if n.shards > 1]:
        here = groups.withColumn("node", root.shard()).where(F.col("node").isin([n.first for n in wide]))
        dims = [f(f"c{d}").alias(f"{x}{d}") for d in range(DIMENSIONS) for x, f in (("min", F.min), ("max", F.max))]
        boxes = {r["node"]: r for r in here.groupBy("node").agg(F.sum("weight").alias("weight"), *dims).collect()}
        seek: dict[int, list[int]] = {}  # node: start of the bins, shift, weight before
        for n in wide:
            if (box := boxes.get(n.first)) is None:  # nothing fell here
                n.dimension, n.cut = 0, 0
                continue
            width = [(box[f"max{d}"] >> HASH_BITS) - (box[f"min{d}"] >> HASH_BITS) for d in range(DIMENSIONS)]
            n.dimension = width.index(max(width))
            seek[n.first] = [0, VALUE_BITS + HASH_BITS - BINS, 0]
        by_first = {n.first: n for n in wide}
        while seek:
            place = _case(F.col("node"), {k: F.shiftright(F.col(f"c{by_first[k].dimension}") - F.lit(s[0]), s[1]) for k, s in seek.items()})
            bins = here.select("node", place.alias("bin"), "weight").where(f"bin >= 0 and bin < {1 << BINS}")
            found: dict[int, list[tuple[int, int]]] = {}
            for r in bins.groupBy("node", "bin").agg(F.sum("weight").alias("weight")).collect():
                found.setdefault(r["node"], []).append((r["bin"], r["weight"]))
            for k, s in list(seek.items()):
                n = by_first[k]
                mine = room[n.first : n.first + n.shards]
                goal = boxes[k]["weight"] * sum(mine[: n.shards // 2]) / max(sum(mine), 1e-9)
                before = s[2]
                for b, w in sorted(found[k]):
                    if before + w >= goal:
                        break
                    before += w
                start = s[0] + (b << s[1])
                if s[1] == 0 or w <= TOLERANCE * total / shards:
                    n.cut = start if goal - before < before + w - goal else start + (1 << s[1])
                    del seek[k]
                else:
                    seek[k] = [start, max(0, s[1] - BINS), before]
        for n in wide:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
    return root


def _bits(value: Column, low: float | None, high: float | None) -> Column:
    """value in low..high as VALUE_BITS bits; null counts as low."""
    if low is None or high == low:
        return F.lit(0).cast("long")
    top = (1 << VALUE_BITS) - 1
    return F.least(F.greatest(F.floor((F.coalesce(value, F.lit(low)) - low) / (high - low) * top), F.lit(0)), F.lit(top)).cast("long")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text, lang, source, ...).

    size is the UTF-8 bytes of the text plus 8; shards have nearly equal sums of it, as far as groups
    of equal texts, which stay whole, allow. slot numbers a shard's rows from 0 without gaps. A null
    text counts as empty, with text_crc32 0. A null doc_id, lang or source counts as the least value;
    lang and source may be missing. Repeated rows are a row each; rows of one doc_id and text in one
    bucket take their slots in any order. An empty table gives an empty result. Other columns are not
    read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    word = [(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string")).bitwiseAND(F.lit(0xFFFF))) if c in docs.columns else F.lit(0)).cast("double").alias(c) for c in ("lang", "source")]
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), *word,
        ),
        "digests",
    )
    key = ["h", "text_crc32", "size"]
    whole = rows.groupBy(*key).agg(
        F.sum("size").alias("weight"), F.min("doc_id").cast("double").alias("d0"), F.min("lang").alias("d2"), F.min("source").alias("d3")
    ).withColumn("d1", F.log2("size"))
    whole = written(whole, "groups")
    ranges = whole.agg(*(f(f"d{d}").alias(f"{x}{d}") for d in range(DIMENSIONS) for x, f in (("min", F.min), ("max", F.max)))).first()
    low = F.col("h").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    coded = written(
        whole.select(*key, "weight", *((F.shiftleft(_bits(F.col(f"d{d}"), ranges[f"min{d}"], ranges[f"max{d}"]), HASH_BITS) + low).alias(f"c{d}") for d in range(DIMENSIONS))),
        "coded",
    )
    total = coded.agg(F.sum("weight")).first()[0] or 0
    limit = max(1.0, HEAVY * total / shards)
    heavy = coded.where(F.col("weight") >= limit).select("weight", *key).orderBy(F.desc("weight"), *key).collect()
    to, room = deal([r["weight"] for r in heavy], total - sum(r["weight"] for r in heavy), shards)
    light = coded.where(F.col("weight") < limit)
    named = light.select(*key, tree(light, room).shard().cast("int").alias("shard"))
    if heavy:
        rows_of = [(*(r[c] for c in key), t) for r, t in zip(heavy, to, strict=True)]
        named = named.unionByName(rows.sparkSession.createDataFrame(rows_of, "h long, text_crc32 long, size long, shard int"))
    placed = rows.select("doc_id", *key).join(named, key)
    buckets = -(-max(1, rows.count()) // ROWS_IN_BUCKET)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "h"))
    return placed.withColumn("number", number).join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number") - 1).alias("slot")
    )
