"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, each different one counts once in the fit, and the centred fit list X is only ever
multiplied: X v and X'u, alternately, one pass over the stored blocks for each pair. The left vectors u have an
entry for every row of the fit list, so they stay where the rows are: the driver keeps u = X p as its short p
and X'u, every task makes its rows' entries of u from p and adds them up into X'u. With those two, all earlier left
vectors are projected out of a new one without a pass (u_i'u = p_i'X'u). The driver holds vectors
of the embeddings' length only; their small bidiagonal matrix gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .storage import stored

#: A length below this share of the whole matrix's counts as zero.
TINY = 1e-10


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int | None = None) -> tuple[DataFrame, int]:
    """key and ``x``, the entries times 256 rounded down, of the rows whose vector is whole; and the length of a vector.

    Dropped are null vectors and those with a null or non-finite entry; a vector shorter or longer than ``dim``
    (the longest one's length unless given) counts as one with missing entries.
    """
    c = F.col(column)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(c.isNotNull() & finite)
    if dim is None:
        dim = rows.agg(F.max(F.size(c))).first()[0] or 0
    whole = F.transform(c, lambda e: F.floor(F.lit(256.0) * e.cast("double")).cast("long"))
    return rows.where((F.size(c) == dim) & (F.size(c) > 0)).select(F.col(key), whole.alias("x")), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_blocks(whole: DataFrame, dim: int, block_rows: int = 8192) -> DataFrame:
    """Each different ``x`` once, stored as blocks of rows: n, kind (of whole number), data."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, block_rows):
                x = _matrix(batch.column("x").slice(begin, block_rows), dim)
                kind = np.promote_types(np.min_scalar_type(min(x.min(), -1)), np.min_scalar_type(min(-x.max(), -1)))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([kind.str]), pa.array([x.astype(kind).tobytes()], pa.binary())],
                                                 names=["n", "kind", "data"])

    # a batch of Arrow rows is at most 10,000 vectors unless the session says otherwise
    return stored(whole.select("x").distinct().mapInArrow(pack, "n bigint, kind string, data binary"), "whitening-fit")


def _summed(blocks: DataFrame, dim: int, size: int, of_block: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray:
    """The sum over blocks of ``of_block``'s ``size`` numbers. Tasks send one row a number, summed in groups by place."""
    kind, name = (np.int64, "bigint") if whole else (np.float64, "double")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for number, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
                total += of_block(np.frombuffer(data.as_buffer(), number).reshape(-1, dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    out = np.zeros(size, kind)
    for place, value in blocks.mapInArrow(add, f"place int, value {name}").groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], dim: int, length: float, steps: int | None = None,
                  seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of X, falling, and their right vectors (rows), from ``product(p)`` = X'(X p).

    ``length`` is the Frobenius norm of X. Both families of vectors are orthogonalised against all earlier ones,
    twice. Where the process ends early, in a space that X maps onto itself, it begins again with a random
    direction outside, so repeated singular values are found; it stops after ``dim`` steps or when
    X has nothing left outside. ``steps`` bounds the passes for very long vectors: the largest values then come
    out approximately.
    """
    rng = np.random.default_rng(seed)
    right, short, image = np.zeros((0, dim)), np.zeros((0, dim)), np.zeros((0, dim))    # v; p with u = X p; X'u
    diagonal, above = [], []

    def outside() -> np.ndarray | None:
        v = rng.standard_normal(dim)
        for _ in range(3):
            v -= right.T @ (right @ v)
            v /= np.linalg.norm(v)
        return v

    v, beta, fresh = outside(), 0.0, True
    while True:
        right = np.vstack([right, v])
        p = v - beta * short[-1] if beta else v.copy()
        g = product(p)
        for _ in range(2):
            h = short @ g
            p, g = p - short.T @ h, g - image.T @ h
        alpha = float(np.sqrt(max(p @ g, 0.0)))
        zero = alpha <= TINY * length
        diagonal.append(0.0 if zero else alpha)
        short = np.vstack([short, 0 * p if zero else p / alpha])
        image = np.vstack([image, 0 * g if zero else g / alpha])
        if len(right) == min(dim, steps or dim) or zero and fresh:
            break
        follow, beta = image[-1] - diagonal[-1] * v, 0.0
        if not zero:
            for _ in range(2):
                follow -= right.T @ (right @ follow)
            beta = float(np.linalg.norm(follow))
        fresh = beta <= TINY * length
        beta = 0.0 if fresh else beta
        v = outside() if fresh else follow / beta
        above.append(beta)
    _, values, vectors = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
    return values, vectors @ right


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding", dim: int | None = None,
           steps: int | None = None) -> DataFrame:
    """Whitened coordinates of every whole vector on the leading components of the different ones.

    key, component (from 1, by falling eigenvalue), n (different vectors), deviation (sum over dimensions of
    (n x - S)^2, S their sums, exact), whitened (x - S/n on the component, over its deviation), explained (the
    component's share of the variance) and identity_error (largest absolute entry of whitened's covariance over the
    different vectors minus the identity).

    Dropped rows: see ``whole_vectors``. Components without variance are left out, so equal vectors only, one vector, or an
    empty table give no rows. Repeated keys and rows keep their rows, null keys too; further columns are not read.
    A deviation beyond 64 bits is an error.
    """
    whole, dim = whole_vectors(vectors, key, column, dim)
    schema = T.StructType([vectors.schema[key], *T.StructType.fromDDL(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = fit_blocks(whole, dim)
    n = blocks.agg(F.sum("n")).first()[0] or 0

    def sums(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.append(x.sum(0), (x * x).sum())

    *total, squares = [int(v) for v in _summed(blocks, dim, dim + 1, sums, whole=True)]
    scatter = n * squares - sum(s * s for s in total)           # n times the sum of squares about the mean, exact
    if not scatter:
        return vectors.sparkSession.createDataFrame([], schema)
    mean, length = np.array([s / n for s in total]), float(np.sqrt(scatter / n))

    def product(p: np.ndarray) -> np.ndarray:
        def both(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred @ p) @ centred

        return _summed(blocks, dim, dim, both)

    values, basis = bidiagonalise(product, dim, length, steps)
    count = min(components, int((values > TINY * length).sum()))
    scale = (basis[:count] / (values[:count, None] / np.sqrt(n))).T
    middle = _summed(blocks, dim, count, lambda x: ((x - mean) @ scale).sum(0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scale - middle
        return (w.T @ w).ravel()

    error = float(np.abs(_summed(blocks, dim, count * count, spread).reshape(count, count) / n - np.eye(count)).max())
    explained = (values[:count] ** 2 / length ** 2).tolist()
    exact = np.array(total, np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dim)
            rough = ((n * x.astype(float) - exact) ** 2).sum(1)
            if rough.max() > 9.2e18:
                raise OverflowError("a deviation does not fit 64 bits")
            deviation = ((n * x - exact) ** 2).sum(1)
            w = (x - mean) @ scale
            rows = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n, np.int64)),
                 pa.array(deviation[rows]), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))],
                names=schema.names)

    return whole.mapInArrow(project, schema)
