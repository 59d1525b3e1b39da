"""Vector quantisation of coefficient blocks with a codebook."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import arrays

# Codes, training blocks, iterations, seed.
CODES, TRAINING, ROUNDS, SEED = 256, 5000, 50, 42


def nonzero(blocks: DataFrame, column: str = "levels") -> DataFrame:
    """Blocks with any level other than 0."""
    return blocks.where(F.exists(column, lambda v: v != 0))


def train(blocks: DataFrame, codes: int = CODES, column: str = "levels") -> DataFrame:
    """(code, centroid) by k-means over a bounded sample of TRAINING blocks; code 0 has the least norm.

    No more different blocks than codes: they are the centroids, made up with zero blocks.
    """
    spark = blocks.sparkSession
    sample = blocks.select(F.col(column).cast("array<double>").alias("x")).orderBy(F.xxhash64(F.col(column)), column).limit(TRAINING)
    different = [r["x"] for r in sample.distinct().limit(codes + 1).collect()]
    if len(different) <= codes:
        centroids = sorted(different) + [[0.0] * 64] * (codes - len(different))
    else:
        model = KMeans(k=codes, maxIter=ROUNDS, seed=SEED, tol=1e-4).fit(sample.select(array_to_vector("x").alias("features")))
        centroids = [c.tolist() for c in model.clusterCenters()]
    least = min(range(len(centroids)), key=lambda i: sum(v * v for v in centroids[i]))
    centroids[0], centroids[least] = centroids[least], centroids[0]
    return spark.createDataFrame(list(enumerate(centroids)), "code int, centroid array<double>")


def encode(blocks: DataFrame, codebook: DataFrame, column: str = "levels") -> DataFrame:
    """blocks with code and dist: the nearest codeword by squared distance, the lowest code of equals.

    The codebook is at most CODES rows of 64 numbers, a fixed bound, so it travels as one literal
    matrix and each Arrow batch is one matrix product.
    """
    rows = sorted(codebook.select("code", "centroid").collect())
    if len(rows) > CODES:
        raise ValueError(f"a codebook has at most {CODES} codes")
    codes, centroids = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64)

    @F.arrow_udf("struct<code:int,dist:double>")
    def nearest(column: pa.Array) -> pa.Array:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, centroids.shape[1])
        rough = (centroids**2).sum(axis=1) - 2 * x @ centroids.T
        code, dist = np.zeros(len(valid), np.int32), np.zeros(len(valid))
        # the product ranks; what it leaves within rounding of the best is measured exactly
        close = rough <= rough.min(axis=1, keepdims=True) + 1e-6 * (1 + np.abs(rough).max(axis=1, keepdims=True))
        row, of = np.nonzero(close)
        d = ((centroids[of] - x[row]) ** 2).sum(axis=1)
        order = np.lexsort((of, d, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        code[valid], dist[valid] = codes[of[first]], d[first]
        return pa.StructArray.from_arrays([pa.array(code, mask=~valid), pa.array(dist, mask=~valid)], ["code", "dist"])

    return blocks.withColumn("_n", nearest(F.col(column).cast("array<double>"))).select(*blocks.columns, "_n.code", "_n.dist")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """codes with their centroid. The codebook is sent to all tasks: it has at most CODES rows of 64 numbers."""
    if codebook.limit(CODES + 1).count() > CODES:
        raise ValueError(f"a codebook has at most {CODES} codes")
    return codes.join(F.broadcast(codebook), "code")


def distortion(decoded: DataFrame, column: str = "levels") -> DataFrame:
    return decoded.withColumn("mse", arrays.squared_distance(F.col(column).cast("array<double>"), F.col("centroid")) / F.size(column))


@F.arrow_udf(T.BinaryType())
def pack_half(centroid: pa.Array) -> pa.Array:
    """Numbers as little-endian half floats."""
    return pa.array([None if v is None else np.array(v, "<f2").tobytes() for v in centroid.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unpack_half(packed: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.frombuffer(v, "<f2").astype(float).tolist() for v in packed.to_pylist()], pa.list_(pa.float64()))
