"""Vector expressions over array columns of any length; sums run in DOUBLE.

Single-vector forms are higher-order functions on the JVM. `similarities_to` scores a column against a
matrix of query vectors in one Arrow batch product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL where a vector has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(v: Column) -> Column:
    """Unit vector; every component is NULL for a zero vector."""
    length = norm(v)
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), length))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softmax_first(first: Column, second: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(second - first))


def squared_distance_unit(similarity: Column) -> Column:
    """Squared distance of two unit vectors from their cosine."""
    return F.lit(2.0) - F.lit(2.0) * similarity


def squared_euclidean(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d * d)


def to_matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; rows of another length or with gaps become NaN."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.full((len(lengths), dim), np.nan)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    good = np.flatnonzero(lengths == dim)
    if good.size:
        out[good] = flat[starts[good][:, None] + np.arange(dim)]
    return out


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN."""
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    lengths[lengths == 0] = np.nan
    return matrix / lengths


def similarities_to(queries: np.ndarray):
    """Arrow UDF: cosine of each row with every query vector, in query order (NULL where undefined)."""
    units = unit_rows(np.asarray(queries, dtype=np.float64))
    count, dim = units.shape

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        sims = (unit_rows(to_matrix(vectors, dim)) @ units.T).ravel()
        values = pa.array(sims, mask=np.isnan(sims))
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * count)
        return pa.ListArray.from_arrays(offsets, values)

    return score
