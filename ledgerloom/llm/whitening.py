"""Whitening of embeddings with MLlib's BlockMatrix.

Vectors become integers x = floor(64 c) + 1000000. The *fit list* is each distinct x once. Centred rows of
the fit list are dealt to the blocks of a BlockMatrix A; AᵀA / n is the covariance, whose eigenvectors the
driver takes (a matrix of d x d, bounded by the vectors' length, whatever their number); A's counterpart for
all rows times the whitening matrix gives their projections. The middle dimension of AᵀA is split, so that
blocks of rows are multiplied where they lie and only d x d sums meet.

Defined results: rows without a vector, with a null or non-finite entry or one beyond 2**46 are dropped, and so
are those whose length is not the commonest (of equally common ones the longer); repeated rows stay and count
once in the fit; an empty table gives no rows. Components whose eigenvalue is not above 1e-12 of the largest
have no whitened value (null) and are not held against the identity; with a covariance of zero ``explained`` is
null too. ``deviation`` is null where it exceeds a long. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .shared import shuffle_partitions

COMPONENTS = 16
#: Rows and columns of a block: 8 MB of doubles at most.
BLOCK = 1024
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond are dropped, so that 64 c is a whole number of 53 bits at most.
LARGEST = float(2**46)
#: Of the largest eigenvalue; what is not above is rounding.
RANK_TOLERANCE = 1e-12


def lattice(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    c = F.col("c")
    sound = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & (F.abs(e) <= LARGEST) & ~F.isnan(e))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c")).where(F.coalesce(sound, F.lit(False)))
    x = F.transform(c, lambda e: F.floor(e * SCALE).cast("long") + SHIFT)
    return rows.select("vec_id", x.alias("x"))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Adds ``i``, a dense number from 0 in no particular order; one count a partition is summed up."""
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    sizes = sorted(rows.groupBy("part").agg(F.count("*")).collect())
    starts = np.cumsum([0, *(n for _, n in sizes)])
    offsets = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=False)], "part int, start long")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "part").select(*[c for c in rows.columns if c not in ("at", "part")], place.alias("i"))


def blocks_of(rows: DataFrame, n_rows: int, width: int) -> BlockMatrix:
    """(i, v) as a distributed matrix in blocks; rows that are not there are zero."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("i", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n_rows, width).toBlockMatrix(BLOCK, BLOCK)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """AᵀA. The overload with a split middle dimension is only in the JVM's class."""
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, BLOCK, BLOCK).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(i, w): rows times weights."""
    context = matrix.blocks.context
    starts = lambda n: enumerate(range(0, n, BLOCK))
    cells = {(r, c): weights[i : i + BLOCK, j : j + BLOCK] for r, i in starts(weights.shape[0]) for c, j in starts(weights.shape[1])}
    parts = [(at, DenseMatrix(*cell.shape, cell.flatten(order="F"))) for at, cell in cells.items()]
    product = matrix.multiply(BlockMatrix(context.parallelize(parts, 1), BLOCK, BLOCK)).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("i"), vector_to_array("vector").alias("w"))


def _off_mean(n: int, sums: list[int]) -> Column:
    """n x - S, exactly."""
    return F.zip_with("x", F.array(*map(F.lit, sums)), lambda x, s: x * F.lit(n) - s)


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return values[::-1], vectors[:, ::-1]


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of (vec_id, embedding)."""
    spark = vectors.sparkSession
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], out.format(dict(vectors.dtypes)["vec_id"]))
    sound = lattice(vectors)
    lengths = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(1)
    if not lengths or not lengths[0]["d"]:
        return none
    d, all_rows = lengths[0]["d"], lengths[0]["count"]
    rows = numbered_rows(sound.where(F.size("x") == d))
    fit = cut(rows.groupBy("x").agg(F.min("i").alias("i")))
    totals = fit.select(F.posexplode("x").alias("at", "e")).groupBy("at").agg(F.sum("e").alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    n, sums = totals[0]["n"], [t["s"] for t in totals]
    centred = F.transform(_off_mean(n, sums), lambda e: e.cast("double") / n).alias("v")
    splits = shuffle_partitions(spark)
    covariance = scatter(blocks_of(fit.select("i", centred), all_rows, d), splits) / n
    values, basis = components(covariance)
    k = min(COMPONENTS, d)
    has = int(np.sum(values[:k] > RANK_TOLERANCE * max(values[0], 0)))
    trace = float(np.trace(covariance))
    deviation = F.aggregate(_off_mean(n, sums), F.lit(0).cast("long"), lambda acc, e: F.try_add(acc, F.try_multiply(e, e))).alias("deviation")
    error = None
    if has:
        weights = basis[:, :has] / np.sqrt(values[:has])
        done = cut(projected(blocks_of(rows.select("i", centred), all_rows, d), weights))
        of_fit = done.join(fit.select("i"), "i", "left_semi").select("i", F.col("w").alias("v"))
        error = float(np.abs(scatter(blocks_of(of_fit, all_rows, has), splits) / n - np.eye(has)).max())
        rows = rows.join(done, "i", "left")
    else:
        rows = rows.withColumn("w", F.lit(None).cast("array<double>"))
    shares = [float(v) / trace if trace > 0 else None for v in values[:k]]
    each = F.posexplode(F.array(*[F.lit(s).cast("double") for s in shares])).alias("at", "explained")
    return rows.select("vec_id", deviation, "w", each).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.get("w", F.col("at")).alias("whitened"),
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
