"""Shared parts: written intermediate tables, union-find, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import shared_dir

#: For each open scratch() the paths made in it.
_made: list[list[str]] = []
#: In a Python worker: the large object that it made last, under its key.
_worker: dict[Hashable, object] = {}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cadenza-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cadenza_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete what written() made, once nothing reads it any more."""
    if df is not None:
        delete_path(df.sparkSession, getattr(df, "_cadenza_path", None))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written within are deleted at the end, but for those put into the list, which stay for what is around."""
    keep: list[DataFrame] = []
    _made.append([])
    try:
        yield keep
    finally:
        stay = {getattr(df, "_cadenza_path", None) for df in keep}
        for path in _made.pop():
            if path not in stay:
                delete_path(spark, path)
            elif _made:
                _made[-1].append(path)


def delete_path(spark: SparkSession, path: str | None) -> None:
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_marks(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash of all columns, equal for rows that are equal in every column; nulls count as such."""
    named = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    columns = [x for c in named for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def for_worker[T](key: Hashable, make: Callable[[], T]) -> T:
    """What make() gives, held by this Python worker for its next tasks until another key is asked for.

    Workers serve all operators of a session in turn, and hold the tables of one of them at a time.
    """
    if key not in _worker:
        _worker.clear()
        pa.default_memory_pool().release_unused()
        _worker[key] = make()
    return _worker[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Forest:
    """Union-find over 0..n-1 in numpy; a root is the smallest index of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for all i."""
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
        self.root = root

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A star for each tree of two or more: at most one edge for each member."""
        inner = np.nonzero(self.root != np.arange(len(self.root)))[0]
        return ids[inner], ids[self.root[inner]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, component), component the smallest node.

    Alternating large-star and small-star steps on DataFrames: a logarithmic number of rounds,
    each a few joins and sums over the edges, written to the shared folder. Nodes come only from
    edges; self-edges and repeated edges do no harm. No group is gathered in one place: the steps
    need minima only, which are pre-aggregated, and joins, which AQE can split at hot nodes.
    """
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(clean, "edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge of large points down (a > b), as the small-star step needs
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        after = written(small, "edges")
        dropped(now)
        now = after
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
