"""SimHash near-dedup by exact comparison of tiles of fingerprints.

Distinct fingerprints are sorted by the population counts of their halves and cut into tiles.
A pair of tiles is compared, with numpy exclusive-or and bit counts, only if the population
counts can lie within the radius: |popcount(x) - popcount(y)| <= hamming(x, y) holds for the
word, its halves and its quarters, and the differences of disjoint parts add up. No pair within
the radius is missed and no pair beyond it is linked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Forest, components, partitions, row_marks, scratch, written

#: Fingerprints in a tile at most, tiles of a cell that one task compares with, about, and cells of the exclusive-or made at once.
TILE, SHARE, AREA = 16_384, 64, 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of UTF-8 bytes; null, empty or blank text has fingerprint 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), seed)
    joined = b" ".join(w)
    length = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(length + 1) - 1
    spans = zip((end - length)[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)
    h = np.array([digest(joined[a:z], seed) for a, z in spans], np.uint64)
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel() * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, keep: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, fp) and the columns keep for every row of docs (doc_id, text); fp is the signed form of the 64 bits."""
    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.columns[-1].cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("fp", "long"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p1, p2, fp) in order to tiles (p1, p2, tile, fps) of one cell each."""
    held: list[np.ndarray] = []
    cell, count = None, 0

    def flush():
        fps = np.concatenate(held)
        return pa.RecordBatch.from_pydict({"p1": pa.array([cell[0]], pa.int32()), "p2": pa.array([cell[1]], pa.int32()), "tile": [int(fps[0])], "fps": [fps.tobytes()]})

    for batch in batches:
        p1, p2, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.nonzero((np.diff(p1) != 0) | (np.diff(p2) != 0))[0] + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            while a < z:
                here = (int(p1[a]), int(p2[a]))
                if count and (here != cell or count == TILE):
                    yield flush()
                    held, count = [], 0
                cell = here
                b = min(z, a + TILE - count)
                held.append(fp[a:b].astype(np.int64))
                count += b - a
                a = b
    if count:
        yield flush()


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _runs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by quarters, starts of runs of equal quarters (and the end), the quarters of each run."""
    key = q @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(key, kind="stable")
    starts = np.nonzero(np.diff(key[order], prepend=-1))[0]
    return order, np.append(starts, len(key)), q[order[starts]]


def near(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with hamming(left[i], right[j]) <= radius, a part at a time."""

    def compare(a: np.ndarray, b: np.ndarray):
        step = max(1, AREA // len(b))
        for k in range(0, len(a), step):
            part = a[k : k + step]
            i, j = np.nonzero(np.bitwise_count(left[part][:, None] ^ right[b][None, :]) <= radius)
            if len(i):
                yield part[i], b[j]

    if len(left) * len(right) <= AREA // 4:
        yield from compare(np.arange(len(left)), np.arange(len(right)))
        return
    (lo, ls, lq), (ro, rs, rq) = _runs(_quarters(left)), _runs(_quarters(right))
    for k in range(len(lq)):
        mine = lo[ls[k] : ls[k + 1]]
        close = np.nonzero(np.abs(rq - lq[k]).sum(axis=1) <= radius)[0]
        if len(close):
            yield from compare(mine, np.concatenate([ro[rs[c] : rs[c + 1]] for c in close]))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) over distinct fp whose components are those of all pairs within the radius."""
    spark = fps.sparkSession
    cells = fps.select(
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("p1"),
        F.bit_count(F.shiftrightunsigned("fp", 32)).alias("p2"),
        "fp",
    )
    tiles = written(
        cells.repartitionByRange(partitions(spark), "p1", "p2", "fp").sortWithinPartitions("p1", "p2", "fp")
        .mapInArrow(_tiles, "p1 int, p2 int, tile long, fps binary"),
        "tiles",
    )
    steps = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x, y) >= (0, 0)]
    step = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps))).alias("step")
    # at most 33 x 33 cells; a cell's tiles are dealt to as many keys as they need
    cells = F.broadcast(tiles.groupBy("p1", "p2").agg(F.ceil(F.count("*") / SHARE).cast("long").alias("salts")))
    right = tiles.join(cells, ["p1", "p2"]).select("p1", "p2", F.pmod(F.xxhash64("tile"), F.col("salts")).alias("salt"), F.col("tile").alias("r_tile"), F.col("fps").alias("r"))
    left = tiles.select("p1", "p2", F.col("tile").alias("l_tile"), F.col("fps").alias("l"), step).select(
        (F.col("p1") + F.col("step.x")).alias("p1"), (F.col("p2") + F.col("step.y")).alias("p2"),
        ((F.col("step.x") == 0) & (F.col("step.y") == 0)).alias("home"), "l_tile", "l",
    ).join(cells, ["p1", "p2"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    pairs = left.join(right, ["p1", "p2", "salt"]).where("not home or l_tile <= r_tile").select("l", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                ids = np.concatenate([left, right]).view(np.int64)
                forest = Forest(len(ids))
                for i, j in near(left, right, radius):
                    forest.link(i, j + len(left))
                x, y = forest.edges(ids)
                apart = x != y
                if apart.any():
                    yield pa.RecordBatch.from_pydict({"a": x[apart], "b": y[apart]})

    return pairs.mapInArrow(run, "a long, b long")


def classes(firsts: DataFrame, radius: int) -> DataFrame:
    """From (fp, first), a row for each fp: (fp, component, first), component the smallest fp reachable by links, and its least first."""
    with scratch(firsts.sparkSession) as keep:
        joined = components(links(firsts.select("fp"), radius))
        rooted = firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
        heads = rooted.groupBy("component").agg(F.min("first").alias("least"))
        out = written(rooted.join(heads, "component").select("fp", "component", F.col("least").alias("first")), "classes")
        keep.append(out)
    return out


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable by links of at most radius differing bits,
    itself included; null if all of these are null. Texts that are null, empty or blank have
    fingerprint 0 and link like any other; a text of fewer than `words` words is one shingle, texts of
    any length are read whole. Rows that repeat a doc_id are answered each. Only doc_id and text are
    read, so other columns cannot clash. An empty table gives an empty result.
    """
    marks = written(fingerprints(docs, words, seed), "fingerprints")
    named = classes(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), radius)
    return marks.join(named.select("fp", F.col("first").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with all their columns, one for each component of near_duplicates().

    It is the row of the smallest doc_id; null comes last, and rows of one doc_id are ordered by a hash
    of all their columns. Rows equal in every column are one. An empty table gives an empty result.
    Columns need a type that can be hashed and grouped, as all but maps have.
    """
    h1, h2 = (h.alias(n) for h, n in zip(row_marks(docs), ("_row1", "_row2"), strict=True))
    with scratch(docs.sparkSession) as keep:
        marks = written(fingerprints(docs, words, seed, [h1, h2]), "fingerprints")
        rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row1", "_row2")
        named = classes(marks.groupBy("fp").agg(F.min(rank).alias("first")), radius)
        chosen = written(named.select("first._row1", "first._row2").distinct(), "chosen")
        keep.append(chosen)
        if marks.groupBy("_row1", "_row2").count().where("count > 1").limit(1).count():
            docs = docs.distinct()
    return docs.withColumns({"_row1": h1, "_row2": h2}).join(chosen, ["_row1", "_row2"], "left_semi").select(*docs.columns)
