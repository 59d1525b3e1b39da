"""Embedding near-dedup by an epsilon grid order join.

Unit vectors whose cosine is at least t lie within eps = sqrt(2 - 2t) of each other, and so do their
projections on any orthonormal axes. Vectors are projected on the leading principal axes of all
vectors, put into grid cells of width eps and sorted by cell; the sequence is cut into blocks. Only
blocks whose first cells are equal or neighbours are paired, and only if their bounding boxes lie
within eps. A pair of blocks is joined recursively: intervals of the two sequences are halved,
intervals whose boxes lie further apart than eps are skipped, and what is left is compared exactly,
in double precision. No pair is missed: the projection only ever shortens distances.

Equal vectors of a label are one class; classes are compared, weighted by their sizes. A pair of
blocks gives a count for each class and a spanning forest, never a row for each link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Forest, components, partitions, scratch, written

#: Leading axes, vectors in a block, blocks of an interval, and vectors of an interval that is compared at once.
AXES, BLOCK, INTERVAL, LEAF = 8, 1024, 32, 128
#: Room for rounding in distances of projections.
SLACK = 1e-9


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to (vec_id, label, width, vec): vec is null where nothing can link."""
    for batch in batches:
        lists = batch.column(2)
        width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten()
        x = np.ascontiguousarray(values.to_numpy(zero_copy_only=False))
        bad = ~np.isfinite(x) | values.is_null().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(width)), width)
        ends = np.cumsum(width)
        good = (width > 0) & (np.bincount(row, bad, len(width)) == 0) & (np.bincount(row, x != 0, len(width)) > 0) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        raw = x.tobytes()
        vec = [raw[(e - w) * x.itemsize : e * x.itemsize] if ok else None for e, w, ok in zip(ends.tolist(), width.tolist(), good.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(good, width, 0), pa.int32(), mask=~good), pa.array(vec, pa.binary())], ["vec_id", "label", "width", "vec"])


def _matrix(vectors: bytes | memoryview, width: int, kind: str) -> np.ndarray:
    """Rows in double precision, scaled by powers of two (which changes no cosine) so that no square overflows or vanishes."""
    x = np.frombuffer(vectors, kind).reshape(-1, width).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def axes(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """For each width of vector its leading principal axes, as columns; from all classes."""

    def add(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for width, gram in parts:
            sums[width] = sums.get(width, 0) + gram
        for width, gram in sums.items():
            yield pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "gram": [np.ascontiguousarray(gram).tobytes()]})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                widths = batch.column(0).to_numpy()
                for w in np.unique(widths).tolist():
                    u = _units(_matrix(b"".join(batch.column(1).filter(pa.array(widths == w)).to_pylist()), w, kind))
                    yield w, u.T @ u

        return add(parts())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add((w, np.frombuffer(g, np.float64).reshape(w, w)) for b in batches for w, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    shape = "width int, gram binary"
    # a matrix for each task and width, then for each of eight, then one, which the driver gets
    rows = classes.select("width", "vec").mapInArrow(first, shape).repartition(8).mapInArrow(second, shape).repartition(1).mapInArrow(second, shape).collect()
    return {r["width"]: np.linalg.eigh(np.frombuffer(r["gram"], np.float64).reshape(r["width"], -1))[1][:, ::-1][:, :AXES] for r in rows}


def join_intervals(p: np.ndarray, q: np.ndarray, eps2: float, same: bool) -> Iterator[tuple[slice, slice]]:
    """Pairs of small intervals of the sequences p and q (projections) that aren't provably distant."""

    def walk(a: int, b: int, c: int, d: int):
        if same and c >= b and a == c and b == d:
            return
        gap = np.maximum(0, np.maximum(p[a:b].min(axis=0) - q[c:d].max(axis=0), q[c:d].min(axis=0) - p[a:b].max(axis=0)))
        if (gap**2).sum() > eps2:
            return
        if b - a <= LEAF and d - c <= LEAF:
            yield slice(a, b), slice(c, d)
        elif same and (a, b) == (c, d):
            m = (a + b) // 2
            yield from walk(a, m, a, m)
            yield from walk(a, m, m, b)
            yield from walk(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            yield from walk(a, m, c, d)
            yield from walk(m, b, c, d)
        else:
            m = (c + d) // 2
            yield from walk(a, b, c, m)
            yield from walk(a, b, m, d)

    if len(p) and len(q):
        yield from walk(0, len(p), 0, len(q))


def join_blocks(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, ax: np.ndarray, threshold: float, same: bool):
    """Links between the rows of x and y (of sizes n and m): their numbers for x and y, and a forest over both."""
    eps2 = 2 - 2 * threshold + SLACK
    nx, ny = np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))
    p, q = x / nx[:, None] @ ax, y / ny[:, None] @ ax
    for_x, for_y, forest = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), Forest(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    for a, b in join_intervals(p, q, eps2, same):
        hit = x[a] @ y[b].T >= threshold * np.multiply.outer(nx[a], ny[b])
        own = same and a == b
        if own:
            np.fill_diagonal(hit, False)
        if hit.any():
            for_x[a] += hit @ m[b]
            if not own:
                (for_x if same else for_y)[b] += n[a] @ hit
            i, j = np.nonzero(hit)
            forest.link(i + a.start, j + b.start + shift)
    return for_x, for_y, forest


def links(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """From classes (cid, label, width, vec, n): rows (a, b, n): n links of class a where n > 0, else an edge."""
    spark = classes.sparkSession
    ax = axes(classes, kind)
    eps = float(np.sqrt(2 - 2 * threshold + SLACK))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            cells = np.zeros((batch.num_rows, AXES), np.int64)
            for w in np.unique(widths).tolist():
                of = widths == w
                p = _units(_matrix(b"".join(batch.column(3).filter(pa.array(of)).to_pylist()), w, kind)) @ ax[w]
                cells[of, : p.shape[1]] = np.floor(p / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cells.T)], [*batch.schema.names, *(f"c{k}" for k in range(AXES))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in grid order to blocks of one label, width and first cell, with their bounding boxes and intervals."""
        held, count, key = [], 0, None
        interval = [None, 0, 0]  # key, blocks so far, name: the first block's

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            w = key[1]
            p = _units(_matrix(b"".join(t.column("vec").to_pylist()), w, kind)) @ ax[w]
            cid = t.column("cid").to_numpy()
            if interval[0] != key or interval[1] == INTERVAL:
                interval[:] = [key, 0, int(cid[0])]
            interval[1] += 1
            box = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (np.pad(p.min(axis=0), (0, AXES - p.shape[1])), np.pad(p.max(axis=0), (0, AXES - p.shape[1])))]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([w], pa.int32()), pa.array([key[2]]), pa.array([interval[2]]), pa.array([int(cid[0])]), *box, pa.array([cid.tobytes()]), pa.array([t.column("n").to_numpy().tobytes()]), pa.array([b"".join(t.column("vec").to_pylist())])],
                ["label", "width", "c0", "interval", "block", "low", "high", "cids", "ns", "vecs"],
            )

        for batch in batches:
            labels, widths, first = batch.column("label").to_pylist(), batch.column("width").to_pylist(), batch.column("c0").to_pylist()
            rows = batch.select(["cid", "n", "vec"])
            a = 0
            while a < batch.num_rows:
                here = (labels[a], widths[a], first[a])
                if count and (here != key or count == BLOCK):
                    yield flush()
                    held, count = [], 0
                key, z = here, a + 1
                while z < batch.num_rows and z - a < BLOCK - count and (labels[z], widths[z], first[z]) == here:
                    z += 1
                held.append(rows.slice(a, z - a))
                count += z - a
                a = z
        if count:
            yield flush()

    grid = [f"c{k}" for k in range(AXES)]
    shape = "cid long, label string, width int, vec binary, n long, " + ", ".join(f"{c} long" for c in grid)
    placed = classes.select("cid", "label", "width", "vec", "n").mapInArrow(project, shape)
    blocks = written(
        placed.repartitionByRange(partitions(spark), "label", "width", *grid, "cid").sortWithinPartitions("label", "width", *grid, "cid")
        .mapInArrow(cut, "label string, width int, c0 long, interval long, block long, low array<double>, high array<double>, cids binary, ns binary, vecs binary"),
        "blocks",
    )
    def gap(a: str, b: str) -> Column:
        """The square of the distance of two boxes."""
        out = F.lit(0.0)
        for k in range(AXES):
            between = F.greatest(F.lit(0.0), F.col(f"{a}low")[k] - F.col(f"{b}high")[k], F.col(f"{b}low")[k] - F.col(f"{a}high")[k])
            out = out + between * between
        return out

    # only boxes are paired: of intervals, at most INTERVAL blocks each, then of their blocks
    intervals = written(
        blocks.groupBy("label", "width", "c0", "interval").agg(
            F.array(*(F.min(F.col("low")[k]) for k in range(AXES))).alias("low"), F.array(*(F.max(F.col("high")[k]) for k in range(AXES))).alias("high"), F.collect_list(F.struct("block", "low", "high")).alias("of")
        ),
        "intervals",
    )
    right = intervals.select("label", "width", "c0", *(F.col(c).alias(f"r_{c}") for c in ("interval", "low", "high", "of")))
    left = intervals.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("c0", F.col("c0") + F.col("step"))
    near = left.join(right, ["label", "width", "c0"]).where(((F.col("step") == 1) | (F.col("interval") <= F.col("r_interval"))) & (gap("", "r_") <= eps * eps))
    inner = near.select("width", ((F.col("step") == 0) & (F.col("interval") == F.col("r_interval"))).alias("home"), F.explode("of").alias("x"), "r_of").select("width", "home", "x", F.explode("r_of").alias("y"))
    close = inner.where((~F.col("home") | (F.col("x.block") <= F.col("y.block"))) & (gap("x.", "y.") <= eps * eps)).select("width", F.col("x.block").alias("block"), F.col("y.block").alias("r_block"))
    mine, theirs = blocks.select("block", "cids", "ns", "vecs"), blocks.select(*(F.col(c).alias(f"r_{c}") for c in ("block", "cids", "ns", "vecs")))
    pairs = close.join(mine, "block").join(theirs, "r_block").select("width", (F.col("block") == F.col("r_block")).alias("same"), "cids", "ns", "vecs", "r_cids", "r_ns", "r_vecs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                cid, n, r_cid, m = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in (2, 3, 5, 6))
                x, y = (_matrix(batch.column(c)[k].as_buffer(), w, kind) for c in (4, 7))
                for_x, for_y, forest = join_blocks(x, y, n, m, ax[w], threshold, same)
                child, parent = forest.edges(cid if same else np.concatenate([cid, r_cid]))
                for a, count in ((cid, for_x), (r_cid, for_y)):
                    some = count > 0
                    if some.any():
                        yield pa.RecordBatch.from_pydict({"a": a[some], "b": a[some], "n": count[some]})
                if len(child):
                    yield pa.RecordBatch.from_pydict({"a": child, "b": parent, "n": np.zeros(len(child), np.int64)})

    return pairs.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of vectors (vec_id, embedding, label, ...).

    Vectors link if their labels are equal and not null, their widths are equal and their cosine, in
    double precision, is at least threshold. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null vec_id, link with nothing. n_links counts the other
    vec_id linked directly; component_id is the smallest vec_id reachable. Rows that repeat a vec_id
    with the same vector are one vector, answered each; with another vector they are another one of
    that name. An empty table gives an empty result. Other columns are not read.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    wide = "array<double>" if kind == "<f8" else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(wide))
    clean = rows.mapInArrow(_clean, "vec_id long, label string, width int, vec binary")
    usable = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    spark = vectors.sparkSession
    marks = [F.when(usable, F.xxhash64(F.lit(k), "label", "width", "vec")).alias(f"_h{k}") for k in (1, 2)]
    with scratch(spark) as keep:
        members = written(clean.select("vec_id", "label", "width", "vec", *marks), "vectors")
        # numbered as they are written, so that a number stays a class's
        classes = written(
            members.where("_h1 is not null").groupBy("_h1", "_h2").agg(
                F.any_value("label").alias("label"), F.any_value("width").alias("width"), F.any_value("vec").alias("vec"), F.count_distinct("vec_id").alias("n"), F.min("vec_id").alias("first")
            ).withColumn("cid", F.monotonically_increasing_id()),
            "classes",
        )
        found = written(links(classes, kind, threshold), "links")
        counts = found.where("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
        roots = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "cid")
        rooted = classes.select("_h1", "_h2", "cid", "n", "first").join(roots, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
        heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        answer = rooted.join(heads, "root").join(counts, "cid", "left").select("_h1", "_h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
        answer = written(answer, "answer")
        keep += [members, answer]
    return members.select("vec_id", "_h1", "_h2").join(answer, ["_h1", "_h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
