"""Whitening of embeddings: principal components of integer-scaled vectors, on exactly centred rows.

1. Each entry c becomes the integer x = floor(64 * c) + 1000000. The fit list has each distinct x vector once.
2. With n vectors and sums S, n * x - S is an exact integer: rows are centred before anything is multiplied, so that the large
   offset costs no digits. Its quotient by n is a row of a RowMatrix, whose Gramian divided by n is the covariance.
3. The covariance, of as many rows as a vector has entries, is decomposed on the driver; the whitening matrix is broadcast
   and applied to all rows in batches.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import saved

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
#: Rows that are whitened at a time.
BATCH = 2048
#: A component is returned only if its eigenvalue is above this share of the largest: below it there is rounding alone.
LEAST = 1e-12
_LONG = 2**63 - 1


def scaled(vector: Column) -> Column:
    """The integers of a vector; null for one that is null or holds an entry that is null, not finite or beyond a long."""
    c = vector.cast("array<double>")
    usable = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LONG / (2 * SCALE)))
    return F.when(usable, F.transform(c, lambda x: F.floor(x * SCALE) + OFFSET))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as 64-bit integers where they hold it, else as Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if 2 * most < _LONG else object
    return x.astype(kind) * n - np.array(sums, kind)


def deviations(d: np.ndarray) -> list[int | None]:
    """The sums of squares of rows of integers, exactly; None beyond a long."""
    if d.dtype != object and (d.astype(float) ** 2).sum(axis=1).max(initial=0) < 2**62:
        return (d**2).sum(axis=1).tolist()
    found = ((row.astype(object) ** 2).sum() if len(row) else 0 for row in d)
    return [v if v <= _LONG else None for v in found]


def sums_of(fit: DataFrame, d: int) -> list[int]:
    """The sum of each entry over rows x, exactly."""
    entry = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    found = {r["at"]: int(r["s"]) for r in entry.collect()}
    return [found[i] for i in range(d)]


def gramian(rows: DataFrame, d: int) -> np.ndarray:
    """The sum of the outer products of rows v (array of d doubles)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors, 0, d).computeGramianMatrix().toArray()


def components_of(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues that are more than rounding, falling, and unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = np.flatnonzero(values > LEAST * max(values[0], 0.0))[:k] if len(values) else np.zeros(0, int)
    return values[keep], vectors[:, keep]


def _projected(rows: DataFrame, names: list[str], kinds: str, n: int, sums: list[int], matrix: np.ndarray) -> DataFrame:
    """The columns ``names``, deviation and w (the projections of x - sums / n on the columns of the matrix) of rows with x."""
    shared = rows.sparkSession.sparkContext.broadcast((n, sums, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, matrix = shared.value
        for batch in (b.iloc[i : i + BATCH] for b in batches for i in range(0, len(b), BATCH)):
            d = centred(np.stack(batch["x"].to_numpy()), n, sums)
            out = batch[names].copy()
            out["deviation"] = pd.array(deviations(d), "Int64")
            out["w"] = list((d.astype(float) / n) @ matrix)
            yield out

    return rows.mapInPandas(run, f"{kinds}deviation long, w array<double>")


def whitened(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error of every usable row.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, as are those with an entry whose
    integer no long holds. Vectors are of one length: those of another than the most common one (ties: the smaller) are left
    out. Repeated rows and null ids have rows each; the fit counts equal integer vectors once. There are as many components
    as the covariance has eigenvalues above rounding, at most k: none, and so no rows, where all vectors are equal or there
    are none. A deviation beyond a long is null. Other columns are left out, so theirs may have any name.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), scaled(F.col(vector_col)).alias("x")).where("x IS NOT NULL AND size(x) > 0")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], empty)
    d = common["d"]
    rows = rows.where(F.size("x") == d)
    fit = saved(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    sums = sums_of(fit, d)
    centre = _projected(fit, [], "", n, sums, np.eye(d)).select(F.col("w").alias("v"))
    covariance = gramian(centre, d) / n
    values, basis = components_of(covariance, k)
    if not len(values):
        return spark.createDataFrame([], empty)
    matrix = basis / np.sqrt(values)
    white = _projected(fit, [], "", n, sums, matrix).select("w")
    mean = white.select(*[F.avg(F.col("w")[i]) for i in range(len(values))]).first()
    white = white.select(F.zip_with("w", F.array(*map(F.lit, mean)), lambda a, b: a - b).alias("v"))
    error = float(np.abs(gramian(white, len(values)) / n - np.eye(len(values))).max())
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    out = _projected(rows, ["id"], f"id {rows.schema['id'].dataType.simpleString()}, ", n, sums, matrix)
    return out.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_embedding_whitening(spark, sf_dir) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of all usable embeddings; see ``whitened``."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
