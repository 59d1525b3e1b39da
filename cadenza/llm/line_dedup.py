"""Line dedup by a sharded minimal perfect hash.

A line's key is hashed to 128 bits. Keys found in two documents or more are dealt to shards by
their hash; each shard gets a minimal perfect hash that numbers its keys 0..n-1 and indexes three
compact arrays: a 64-bit fingerprint, the count of documents and the smallest doc_id. (A key of one
document can lose no line, so it isn't indexed; the fingerprint tells it apart.) Documents send
their hashes, a packed row for each batch and shard, to where the shard's arrays are and get back
what to drop: lines are never joined with lines, a shard and one packed row are in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import partitions, written

#: Keys shorter than this many code points are never dropped; keys in a shard, about.
LEAST, SHARD_KEYS = 10, 250_000
#: Stands for a null doc_id: it comes after all others.
LAST = (1 << 63) - 1
_PAIR = np.dtype([("lo", "<u8"), ("hi", "<u8")])


def key_of(line: bytes) -> bytes | None:
    """The line's key, or None where it is too short to count."""
    key = line.strip().lower()
    return key if len(key) >= 4 * LEAST or (len(key) >= LEAST and len(key.decode("utf-8", "replace")) >= LEAST) else None


def hashes(lines: list[bytes]) -> list[bytes | None]:
    """16 bytes for each line that counts."""
    digest = xxhash.xxh3_128_digest
    return [None if (k := key_of(x)) is None else digest(k) for x in lines]


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys["lo"] ^ (keys["hi"] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0x9FB21C651E98DF25)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Distinct 128-bit keys to 0..n-1: levels of bits, a key's place is the rank of its own bit.

    On each level a key that hits a place alone sets its bit; the others go on to the next level.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sizes = [int(np.bitwise_count(b).sum()) for b in levels]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(b))]).astype(np.int64) for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            words = len(keys) * 2 // 64 + 1
            at = _mix(keys, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for other keys any number, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = _mix(keys[left], k) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.base[k] + self.ranks[k][word[hit]] + below
            left = left[~hit]
        return out


class Shard:
    """A perfect hash with its arrays."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.hash = PerfectHash.build(keys)
        at = self.hash.find(keys)
        self.mark, self.count, self.first = np.empty(len(keys), "<u8"), np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8")
        self.mark[at], self.count[at], self.first[at] = keys["hi"], np.minimum(count, 2**32 - 1), first

    def pack(self) -> bytes:
        levels = self.hash.levels
        head = np.array([len(self.mark), len(levels), *map(len, levels)], "<u8")
        return b"".join([head.tobytes(), *(b.tobytes() for b in levels), self.mark.tobytes(), self.count.tobytes(), self.first.tobytes()])

    @classmethod
    def unpack(cls, content: pa.Buffer) -> Shard:
        out, at = cls.__new__(cls), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(content, kind, n, at - n * np.dtype(kind).itemsize)

        n, deep = take("<u8", 2).tolist()
        out.hash = PerfectHash([take("<u8", m) for m in take("<u8", deep).tolist()])
        out.mark, out.count, out.first = take("<u8", n), take("<u4", n), take("<i8", n)
        return out

    def repeated(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each key is in two documents or more, of which this one isn't the first."""
        at = self.hash.find(keys)
        known = at >= 0
        known[known] = self.mark[at[known]] == keys["hi"][known]
        out = np.zeros(len(keys), bool)
        out[known] = (self.count[at[known]] >= 2) & (self.first[at[known]] != docs[known])
        return out


def _occurrences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, doc_ids) of a batch (doc_id, text): each key once for each document."""
    out: list[bytes] = []
    size = np.zeros(batch.num_rows, np.int64)
    for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
        found = set(hashes((text or b"").split(b"\n"))) - {None}
        out.extend(found)
        size[k] = len(found)
    docs = batch.column(0).fill_null(LAST).to_numpy()
    return np.frombuffer(b"".join(out), _PAIR), np.repeat(docs, size)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, docs = _occurrences(batch)
        order = np.lexsort((docs, keys["hi"], keys["lo"]))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.nonzero(new)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys["lo"][starts].view(np.int64)), pa.array(keys["hi"][starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(keys)))), pa.array(docs[starts])],
            ["lo", "hi", "n", "first"],
        )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, lo, hi, n, first) in order of shard to a row (shard, kind 0, packed arrays) for each."""
    shard, held = None, []

    def flush():
        lo, hi, n, first = (np.concatenate(x) for x in zip(*held, strict=True))
        keys = np.empty(len(lo), _PAIR)
        keys["lo"], keys["hi"] = lo.view(np.uint64), hi.view(np.uint64)
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "kind": pa.array([0], pa.int32()), "content": [Shard(keys, n, first).pack()]})

    for batch in batches:
        of, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.nonzero(np.diff(of) != 0)[0] + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            if a < z:
                if held and of[a] != shard:
                    yield flush()
                    held = []
                shard = int(of[a])
                held.append([c[a:z].copy() for c in columns])
    if held:
        yield flush()


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (shard, kind): arrays are loaded, the packed hashes after them looked up."""
    shard, arrays = None, None
    for batch in batches:
        for of, kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == 0:
                shard, arrays = of, Shard.unpack(pa.py_buffer(content.as_py()))
                continue
            if of != shard:
                continue  # no key of this shard repeats
            raw = np.frombuffer(content.as_buffer(), np.uint8)
            n = len(raw) // 24
            keys, docs = raw[: 16 * n].view(_PAIR), raw[16 * n :].view("<i8")
            drop = arrays.repeated(keys, docs)
            if drop.any():
                keys, docs = keys[drop], docs[drop]
                order = np.argsort(docs, kind="stable")
                keys, docs = keys[order], docs[order]
                starts = np.nonzero(np.diff(docs, prepend=docs[0] - 1))[0]
                ends = np.append(starts[1:], len(docs))
                yield pa.RecordBatch.from_pydict({"doc_id": docs[starts], "drops": [keys[a:z].tobytes() for a, z in zip(starts, ends, strict=True)]})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, drops in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            gone = {d[k : k + 16] for d in drops or () for k in range(0, len(d), 16)}
            stay = [x for x, h in zip(lines, hashes(lines), strict=True) if h not in gone] if gone else lines
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept"],
        )


def dedup_lines(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of docs (doc_id, text, ...).

    A key of LEAST code points or more that two documents hold stays only in the smallest doc_id,
    where all its lines stay. A null or empty text is one empty line. Rows that repeat a doc_id are
    one document; a null doc_id comes after all others. Other columns are not read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.mapInArrow(_count, "lo long, hi long, n long, first long").groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    repeated = written(counted.where("n >= 2"), "lines")
    shards = max(partitions(spark), -(-repeated.count() // shard_keys))
    shard = F.pmod(F.col("lo"), F.lit(shards)).cast("int").alias("shard")
    index = (
        repeated.select(shard, "lo", "hi", "n", "first").repartition(partitions(spark), "shard").sortWithinPartitions("shard")
        .mapInArrow(_index, "shard int, kind int, content binary")
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = _occurrences(batch)
            to = (keys["lo"].view(np.int64) % shards).astype(np.int32)
            order = np.argsort(to, kind="stable")
            keys, docs, to = keys[order], docs[order], to[order]
            starts = np.nonzero(np.diff(to, prepend=-1))[0]
            ends = np.append(starts[1:], len(to))
            content = [keys[a:z].tobytes() + docs[a:z].astype("<i8").tobytes() for a, z in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[starts]), pa.array(np.ones(len(starts), np.int32)), pa.array(content, pa.binary())], ["shard", "kind", "content"])

    asked = index.union(rows.mapInArrow(send, "shard int, kind int, content binary"))
    found = asked.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "kind").mapInArrow(_look_up, "doc_id long, drops binary")
    drops = found.groupBy("doc_id").agg(F.collect_list("drops").alias("drops"))
    last = F.coalesce("doc_id", F.lit(LAST))
    joined = rows.withColumn("at", last).join(drops.withColumnRenamed("doc_id", "at"), "at", "left")
    return joined.select("doc_id", "text", "drops").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept string")
