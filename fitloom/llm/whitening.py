"""Whitening of vectors with distributed block matrices.

Vectors become whole numbers, so that their sums and deviations are exact. The centred rows are
indexed into blocks; the transpose times the blocks gives the scatter matrix, whose eigenvectors are found
on the driver (its size is the dimension squared), and the blocks times the whitening matrix give the
projected rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import fresh, row_id, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Entries of a block, about: 2 MB. Columns of a block at most.
BLOCK_ENTRIES, BLOCK_COLUMNS = 1 << 18, 1024
# Blocks of rows that one task multiplies and adds up.
BLOCKS_PER_TASK = 8
# Larger entries have no whole number; so differences of two fit in 62 bits.
LARGEST = 1 << 60


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the whole numbers floor(1024 c) + 100000 of every usable vector.

    Not usable: null and empty vectors, those with a null or non-finite entry or one beyond 2^60 / 1024, and those
    whose length is not the most frequent one (the smallest of equally frequent ones).
    """
    entry = F.transform(F.col(vector), lambda c: c.cast("double") * SCALE)
    scaled = vectors.select("vec_id", entry.alias("x")).filter(
        (F.size("x") > 0) & F.forall("x", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))))
    whole = stored(scaled.withColumn("x", F.transform("x", lambda c: F.floor(c) + SHIFT)))
    lengths = whole.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    best = lengths.agg(F.max(F.struct("n", -F.col("dim"))).alias("best")).first()["best"]
    return whole.filter(F.size("x") == (0 if best is None else -best[1]))


def exact_centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[list[int], np.ndarray]:
    """Sum over the dimensions of (n x - S)^2 for every row, exact, and the rows x - S / n, rounded once."""
    quotient, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    near = x - quotient
    bound = n * (int(np.abs(near).max(initial=0)) + 1)
    if bound * bound * x.shape[1] >= 1 << 63:
        near, rest = near.astype(object), rest.astype(object)
    off = near * n - rest
    return (off * off).sum(axis=1).tolist(), (off / n).astype(float)


def _centred(vectors: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """vec_id, deviation, centred of every vector; a deviation that no long holds is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            deviation, rows = exact_centred(x, n, sums)
            ends = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], ["vec_id", "deviation", "centred"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, centred array<double>")


def indexed(df: DataFrame) -> DataFrame:
    """``df``, a stored table, with ``index``: 0, 1, 2, ... without a gap and without a shuffle of the rows.

    The rows of every part are counted; the counts, one for each part of the scan, are added up in one
    window.
    """
    marked = df.withColumn("at", row_id())
    marked = marked.select(*df.columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    counts = marked.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return marked.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).alias("index"), *df.columns)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, with the sum over the inner dimension split over ``splits`` tasks for each block
    of the result. PySpark's own method has no such argument: it would add up all row blocks in one task."""
    of = lambda m: m._java_matrix_wrapper._java_model
    return BlockMatrix(of(left).multiply(of(right), splits), left.rowsPerBlock, right.colsPerBlock)


def to_blocks(rows: DataFrame, index: str, vector: str, n: int, dim: int) -> BlockMatrix:
    """Rows with a number and an array of doubles as a matrix of n x dim in blocks."""
    frame = MLUtils.convertVectorColumnsFromML(rows.select(index, array_to_vector(vector).alias("vector")), "vector")
    columns = min(dim, BLOCK_COLUMNS)
    return IndexedRowMatrix(frame, n, dim).toBlockMatrix(max(1, BLOCK_ENTRIES // columns), columns)


def from_blocks(matrix: BlockMatrix, name: str) -> DataFrame:
    """index and ``name``, the rows of a matrix as arrays of doubles; rows of zeros may be missing."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias(name))


def local_block(matrix: np.ndarray, spark, rows: int) -> BlockMatrix:
    """A small matrix as blocks of ``rows`` rows, to be multiplied with blocks of as many columns."""
    parts = [((k, 0), DenseMatrix(len(m), m.shape[1], m.ravel(order="F").tolist()))
             for k, m in enumerate(matrix[a:a + rows] for a in range(0, len(matrix), rows))]
    return BlockMatrix(spark.sparkContext.parallelize(parts), rows, matrix.shape[1], *matrix.shape)


def axes(scatter: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitening matrix (dim x components), eigenvalues and their shares of the variance, largest first.

    An eigenvector's largest entry is positive. Eigenvalues that are zero within rounding have a column of zeros.
    """
    covariance = scatter / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    real = values > trace * len(covariance) * np.finfo(float).eps
    values = np.where(real, values, 0.0)
    return np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0), values, values / trace if trace > 0 else np.zeros(len(values))


def identity_error(whitened: DataFrame, n: int, real: list[int]) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, over the ``real`` components."""
    if not real:
        return 0.0
    w = F.col("whitened")
    means = whitened.agg(*(F.sum(w[k]).alias(f"m{k}") for k in real)).first()
    off = {k: w[k] - F.lit((means[f"m{k}"] or 0.0) / n) for k in real}
    # a row that is missing is one of zeros
    found = whitened.agg(F.count("*").alias("rows"), *(F.sum(off[a] * off[b]).alias(f"c{a}_{b}") for a in real for b in real if a <= b)).first()
    zeros = n - found["rows"]
    of = lambda a, b: (found[f"c{a}_{b}"] or 0.0) + zeros * (means[f"m{a}"] or 0.0) / n * (means[f"m{b}"] or 0.0) / n
    return max(abs(of(a, b) / n - (a == b)) for a in real for b in real if a <= b)


def whitened_vectors(vectors: DataFrame, most: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector (`whole_vectors`).

    component: 1, 2, ... up to ``most`` and the dimension, by falling eigenvalue; n: vectors; deviation: sum
    over the dimensions of (n x - S)^2, exact (null beyond a long); whitened: x - S / n on the
    component over the root of its eigenvalue; explained: the eigenvalue's share of the variance;
    identity_error: how far the covariance of all whitened values is from the identity. A component
    without variance has null for whitened and 0 for explained, also where all vectors are equal.
    Repeated rows and missing ids stay apart and all count. Tables without a usable vector give no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(vectors["vec_id"], F.col(vector).alias(fresh(vectors, "vector"))) if vector == "vec_id" else vectors
    x = whole_vectors(named, vector)
    sums = x.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).collect()
    if not sums:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, dim = sums[0]["n"], len(sums)
    rows = stored(indexed(stored(_centred(x, n, [int(r["s"]) for r in sorted(sums, key=lambda r: r["pos"])]))))
    blocks = to_blocks(rows, "index", "centred", n, dim)
    splits = max(1, -(-n // blocks.rowsPerBlock) // BLOCKS_PER_TASK)
    scatter = product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    matrix, values, shares = axes(scatter, n, most)
    projected = stored(from_blocks(product(blocks, local_block(matrix, spark, blocks.colsPerBlock), 1), "whitened"))
    error = identity_error(projected, n, np.flatnonzero(values > 0).tolist())
    of = rows.select("index", "vec_id", "deviation").join(projected, "index", "left")
    return of.select("vec_id", "deviation", F.explode(F.array(*(
        F.struct(F.lit(k + 1).alias("component"),
                 (F.coalesce(F.col("whitened")[k], F.lit(0.0)) if values[k] > 0 else F.lit(None).cast("double")).alias("whitened"),
                 F.lit(float(shares[k])).alias("explained")) for k in range(len(values))))).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
