"""Embedding whitening with distributed block matrices.

Entries become integers, so that sums and deviations are exact. The centred rows are numbered and form a ``BlockMatrix`` of
row blocks; its transpose times itself is the scatter matrix, of the size of a vector's length squared. ``eigh`` on the
driver gives the principal components, and the block matrix times the whitening matrix projects all rows.

A product's middle dimension is the number of rows. Left alone, one task would gather all blocks for the one block of the
scatter matrix; splitting the middle dimension (``numMidDimSplits`` of ``BlockMatrix.multiply``, which the Python wrapper
lacks but its Java object has) gives every task some blocks and adds up small matrices.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from fleetweave.llm.scratch import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK_ROWS = 1024
SPLIT_BLOCKS = 8  # row blocks that one task multiplies
GREATEST = 2.0 ** 36  # entries must be smaller, so that a batch's sums fit into 64 bits
ZERO = 1e-12  # eigenvalues below this share of the greatest are rounding
_LARGEST = 2 ** 63 - 1


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``size`` usable entries, and these entries as integers."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == size)
    found = flat[starts[rows][:, None] + np.arange(size)]
    good = (np.abs(found) < GREATEST).all(axis=1)
    return rows[good], np.floor(SCALE * found[good]).astype(np.int64) + SHIFT


def _integers(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(id, x) of the rows that remain."""
    def run(batches):
        for batch in batches:
            rows, x = _matrix(batch.column(1), size)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))],
                                             names=["id", "x"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "id long, x array<long>")


def _length(vectors: DataFrame, vector_col: str) -> int:
    """The commonest length of usable vectors, the longest of equally common ones; 0 if there are none."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: F.coalesce(F.abs(x) < GREATEST, F.lit(False)))  # NaN is above all numbers
    found = vectors.where(usable & (F.size(v) > 0)).groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return 0 if found is None else found["size"]


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with gapless numbers, by part and place; as many counts as parts are sent to every task."""
    rows = stored(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    counts = sorted(rows.groupBy("part").agg(F.max("place").alias("last")).collect())
    firsts, number = [], 0
    for part, last in counts:
        firsts.append((part, number))
        number += last + 1
    firsts = rows.sparkSession.createDataFrame(firsts, "part int, first long")
    return rows.join(F.broadcast(firsts), "part").withColumn("index", F.col("first") + F.col("place")).drop("part", "place", "first")


def _sums(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of every dimension."""
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, size)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))], names=["n", "s"])

    parts = rows.select("x").mapInArrow(run, "n long, s array<long>")
    # exact beyond 64 bits too
    listed = parts.select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * size
    for r in listed:
        sums[r["pos"]] = int(r["s"])
    return (listed[0]["n"] if listed else 0), np.array(sums, object)


def _centred(rows: DataFrame, n: int, sums: np.ndarray, size: int) -> DataFrame:
    """(index, id, deviation, values): integers less their mean; the deviation is null if it is beyond 64 bits."""
    mean = (sums / n).astype(np.float64)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, size)
            widest = max(abs(int(x.max()) * n - int(sums.min())), abs(int(x.min()) * n - int(sums.max()))) if len(x) else 0
            if widest * widest * size <= _LARGEST and n * int(np.abs(x).max(initial=0)) <= _LARGEST:
                deviation = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d <= _LARGEST else None for d in ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()]
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("id"), pa.array(deviation, pa.int64()),
                                              pa.ListArray.from_arrays(offsets, pa.array((x - mean).reshape(-1)))],
                                             names=["index", "id", "deviation", "values"])

    return rows.select("index", "id", "x").mapInArrow(run, "index long, id long, deviation long, values array<double>")


def _blocks(centred: DataFrame, n: int, size: int) -> BlockMatrix:
    vectors = centred.select("index", array_to_vector("values").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, size).toBlockMatrix(BLOCK_ROWS, size)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


def _gram(matrix: BlockMatrix, n: int) -> np.ndarray:
    """The transpose times the matrix."""
    splits = max(1, -(-n // (BLOCK_ROWS * SPLIT_BLOCKS)))
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component.

    Rows go whose vector is null or empty, holds entries that are null, not finite or ``GREATEST`` and beyond, or is of
    another length than most of the others (of equally common lengths, the longest stays). Entries c become
    floor(1024 c) + 100000. Components are those with the greatest variance, numbered from 1, as many as asked for or as
    there are dimensions. ``deviation`` is null where it does not fit into 64 bits. Where a component has no variance, as
    with a single row or equal rows, ``whitened`` and ``explained`` are 0, and ``identity_error`` leaves it out. Repeated
    rows and null ids stay; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = _length(vectors, vector_col)
    if size == 0:
        return spark.createDataFrame([], schema)
    rows = _numbered(_integers(vectors, id_col, vector_col, size))
    n, sums = _sums(rows, size)
    centred = stored(_centred(rows, n, sums, size))
    matrix = _blocks(centred, n, size)
    values, axes = np.linalg.eigh(_gram(matrix, n) / n)
    falling = np.argsort(-values, kind="stable")[:components]
    trace = float(values.sum())
    values, axes = values[falling], axes[:, falling]
    live = values > ZERO * max(trace, 0.0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)

    whitening = DenseMatrix(size, len(falling), (axes * scale).reshape(-1, order="F"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), whitening)], 1), size, len(falling), size, len(falling))
    projected = matrix.multiply(right)

    def spread(block):
        (row, _), part = block
        first = row * BLOCK_ROWS
        return [Row(index=first + k, found=[float(v) for v in own]) for k, own in enumerate(part.toArray())]

    found = stored(projected.blocks.flatMap(spread).toDF("index long, found array<double>"))
    means = [F.avg(F.get("found", F.lit(k))) for k in range(len(falling))]
    centre = F.array(*[F.lit(float(v)) for v in found.agg(*means).first()])
    again = _blocks(found.select("index", F.zip_with("found", centre, lambda v, m: v - m).alias("values")), n, len(falling))
    covariance = _gram(again, n) / n
    error = float(np.abs(covariance - np.eye(len(falling)))[np.ix_(live, live)].max(initial=0.0))
    explained = F.lit([float(v) if ok else 0.0 for v, ok in zip(values / trace if trace > 0 else values, live)])
    joined = centred.select("index", "id", "deviation").join(found, "index")
    return joined.select("id", "deviation", F.posexplode("found").alias("k", "whitened")).select(
        "id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
