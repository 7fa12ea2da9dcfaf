"""Embedding whitening on MLlib's BlockMatrix.

The rows to fit on are indexed and centred, and stand in distributed blocks of BLOCK_ROWS
rows. The transposed matrix times the matrix gives the scatter, one product for each
MIDDLE row blocks before the sums meet, so that no task holds more. Its eigenvectors are
found locally (the scatter is as wide as a vector, whatever the number of rows), and the
blocks of all rows times the whitening matrix project them.

Vectors are judged as integers ``floor(scale * x) + offset``; sums, and so the centred
numerators ``n * x - S``, are exact. The fit list is every distinct integer vector once.

Defined cases: null vectors and vectors with null or non-finite components are dropped;
shorter vectors go on with zeros up to the longest; components beyond +-2**40 are cut to
that (so that sums stay exact); null and repeated ids are rows like others; a deviation that
no long can hold is null; eigenvalues that are rounding errors of 0 (fewer distinct vectors
than dimensions) give no component, so one distinct vector gives no rows; an empty table
gives none. Each component's largest entry is positive. Columns other than id and vector are
not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from .common import materialise, table
from .topk_search import finite

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block, columns of a block, row blocks that one task of a transposed product takes.
BLOCK_ROWS, BLOCK_COLUMNS, MIDDLE = 1024, 1024, 16
LIMIT, LONG = 1 << 40, (1 << 63) - 1


def integers(rows: DataFrame, id_col: str, vector_col: str, width: int, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): vectors as integers, all of one length."""
    value = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-2.0**50)), F.lit(2.0**50))) + offset, F.lit(-LIMIT)), F.lit(LIMIT))
    zeros = F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size(vector_col))
    return rows.select(F.col(id_col).alias("vec_id"), F.concat(F.transform(vector_col, value), zeros).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """A written table's rows with a dense index: a row's place in its partition after all rows of earlier ones.

    What the driver holds is one count a partition.
    """
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    counts = placed.groupBy(F.shiftright("__at", 33).alias("part")).count().orderBy("part").collect()
    firsts, total = [], 0
    for part, count in counts:
        firsts.append((part, total))
        total += count
    first = F.broadcast(rows.sparkSession.createDataFrame(firsts, "part bigint, first bigint"))
    joined = placed.withColumn("part", F.shiftright("__at", 33)).join(first, "part")
    return joined.select((F.col("first") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("index"), *rows.columns)


def sums(fit: DataFrame) -> list[int]:
    """Exact sums of each dimension; each task adds its rows before the shuffle."""

    def add(batches):
        total = None
        for batch in batches:
            # up to 2**10 rows of 2**40 stay in a long
            for at in range(0, batch.num_rows, 1024):
                part = batch.column(0).slice(at, 1024)
                one = part.flatten().to_numpy().reshape(len(part), -1).sum(axis=0).astype(object)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0))], names=["at", "s"])

    found = fit.select("x").mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    return [int(r.s) for r in found]


def centred(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """Rows (index, vec_id or none, x) with ``vector``, x - S/n, and ``deviation``, the exact sum of (n*x - S)**2."""
    keep = [c for c in rows.columns if c != "x"]
    mean = np.array(total, dtype=object)
    # differences up to this size have a sum of squares that a long holds
    fits = int((LONG // max(1, len(total))) ** 0.5)

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index("x")
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = part.column(at).flatten().to_numpy().reshape(part.num_rows, -1)
                size = int(np.abs(x).max(initial=0)) * n + max(map(abs, total))
                off = x * n - mean.astype(np.int64) if size < LONG else x.astype(object) * n - mean
                if size < LONG and np.abs(off).max(initial=0) <= fits:
                    deviation = pa.array((off * off).sum(axis=1), pa.int64())
                else:
                    exact = (off.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(d) if d <= LONG else None for d in exact], pa.int64())
                vector = (off / n).astype(np.float64)
                offsets = pa.array(np.arange(len(vector) + 1, dtype=np.int32) * vector.shape[1])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], deviation, pa.ListArray.from_arrays(offsets, pa.array(vector.ravel()))], names=[*keep, "deviation", "vector"])

    schema = rows.select(*keep).schema.add("deviation", LongType()).add("vector", ArrayType(DoubleType()))
    return rows.mapInArrow(work, schema)


def blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Rows (index, vector) as a distributed matrix of blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix, middle: int = MIDDLE) -> np.ndarray:
    """The transposed matrix times the matrix; the middle dimension is cut so that a task takes ``middle`` row blocks."""
    cuts = max(1, -(-matrix.numRows() // (matrix.rowsPerBlock * middle)))
    turned = matrix.transpose()
    # Python's multiply() doesn't pass the number of cuts on
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, cuts)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def times(spark: SparkSession, matrix: BlockMatrix, right: np.ndarray) -> BlockMatrix:
    """The blocks times a local matrix."""
    high, wide = right.shape
    cut = [((i, j), right[i * BLOCK_COLUMNS : (i + 1) * BLOCK_COLUMNS, j * BLOCK_COLUMNS : (j + 1) * BLOCK_COLUMNS]) for i in range(-(-high // BLOCK_COLUMNS)) for j in range(-(-wide // BLOCK_COLUMNS))]
    local = spark.sparkContext.parallelize([(at, DenseMatrix(*part.shape, part.ravel(order="F"))) for at, part in cut], len(cut))
    return matrix.multiply(BlockMatrix(local, BLOCK_COLUMNS, BLOCK_COLUMNS, high, wide))


def as_rows(matrix: BlockMatrix) -> DataFrame:
    """(index, values) of a distributed matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("values"))


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; none that is a rounding error of 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > values[0] * len(values) * np.finfo(float).eps * 8).sum()) if values[0] > 0 else 0)
    vectors = vectors[:, :kept] * np.sign(vectors[np.abs(vectors[:, :kept]).argmax(axis=0), np.arange(kept)])
    return values[:kept], vectors


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each row's whitened components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    fine = rows.where(finite(vector_col))
    width = fine.agg(F.max(F.size(vector_col))).first()[0]
    if not width:
        return none
    every = indexed(materialise(integers(fine, id_col, vector_col, width, scale, offset), "whitening-rows"))
    fit = materialise(every.select("x").distinct(), "whitening-fit")
    n = fit.count()
    total = sums(fit)
    fitted = blocks(centred(indexed(fit), n, total), n, width)
    covariance = scatter(fitted) / n
    values, vectors = eigen(covariance, components)
    if not len(values):
        return none
    to_white = vectors / np.sqrt(values)
    # whitened rows of the fit list, centred once more, must have the identity for covariance
    white = as_rows(times(spark, fitted, to_white))
    means = np.array([r[0] for r in white.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).orderBy("at").select("m").collect()])
    again = blocks(white.select("index", F.zip_with("values", F.array(*map(F.lit, means.tolist())), lambda v, m: v - m).alias("vector")), n, len(values))
    error = float(np.abs(scatter(again) / n - np.eye(len(values))).max())
    held = materialise(centred(every, n, total), "whitening-centred")
    m = held.count()
    projected = as_rows(times(spark, blocks(held, m, width), to_white))
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    joined = held.select("index", "vec_id", "deviation").join(projected, "index")
    out = joined.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
#: Eigenvectors aren't expressible in SQL; tests hold them against NumPy.
ORACLES: dict = {}
