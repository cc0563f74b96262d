"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The rows of X are the distinct vectors, centred. Products Xv and X'u alternate, both in one
pass over the blocks of X per step; the driver holds vectors of the embedding's
dimension only. The singular values and vectors of the small bidiagonal matrix give the
components and deviations.

The left vectors have one entry per row and are kept nowhere: an entry is a function of
its row and of the coefficients so far, so each pass works them out again from the row.
That makes a lost executor cost a reread, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.llm.text import shared_table

SCALE = 256
TOLERANCE = 1e-14
VECTOR = T.ArrayType(T.LongType())


def scaled(vector: Column) -> Column:
    """floor(256 c) of every entry as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite entries."""
    finite = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return F.coalesce(finite, F.lit(False))


@dataclass
class Whitening:
    """``vectors`` (dimension x components, unit columns) by falling ``eigenvalues``; ``sums`` per
    dimension over the ``n`` distinct rows, ``trace`` of their covariance, ``steps`` taken."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int
    identity_error: float | None = None


def _rows(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(column, n, sums) -> np.ndarray:
    """x - S/n, rounded once: n x - S is exact."""
    return (_rows(column) * np.int64(n) - sums) / n


def left_entries(rows: np.ndarray, right: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Entries of the left vectors for these rows, from X V = U R with R upper triangular."""
    u = rows @ right
    for j in range(u.shape[1]):
        if j:
            u[:, j] -= u[:, :j] @ upper[:j, j]
        u[:, j] /= upper[j, j]
    return u


def _sum_by_place(df: DataFrame, partial, size: int) -> np.ndarray:
    """Sum over partitions of the vectors that ``partial`` gives for Arrow batches.

    Vectors are added place by place on the executors, so the driver gets one of them.
    """

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch.column(0))
        places = pa.array(np.arange(size))
        yield pa.RecordBatch.from_arrays([places, pa.array(total)], names=["place", "value"])

    parts = df.select("x").mapInArrow(run, "place long, value double")
    summed = np.zeros(size)
    for place, value in parts.groupBy("place").agg(F.sum("value")).collect():
        summed[place] = value
    return summed


def _step(fit: DataFrame, n, sums, right, upper, new, expected):
    """One pass: w = X new - U expected, and of it U'w, |w| squared and X'w."""
    done, size = upper.shape[0], len(sums)

    def partial(column):
        rows = _centred(column, n, sums)
        w = rows @ new
        if not done:
            return np.concatenate([[w @ w], w @ rows])
        u = left_entries(rows, right, upper)
        w -= u @ expected
        return np.concatenate([w @ u, [w @ w], w @ rows])

    found = _sum_by_place(fit, partial, done + 1 + size)
    return found[:done], found[done], found[done + 1 :]


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(
    fit: DataFrame, n: int, sums: np.ndarray, k: int, scale: float, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest singular values of the centred rows, right vectors, and steps.

    Both sides are reorthogonalised against all earlier vectors. ``scale`` is the
    Frobenius norm. It ends when the ``k`` leading residuals are below ``tolerance`` times
    the largest value, or when the right vectors span the space. When they span an
    invariant subspace, it goes on with a new vector orthogonal to it, so that repeated
    singular values are all found, until X maps such a vector to zero.
    """
    size = len(sums)
    draw = np.random.default_rng(size)
    right, images = np.zeros((size, 0)), np.zeros((size, 0))
    # X right = U upper; ``pivots`` are the columns that gave a new left vector.
    upper, pivots = np.zeros((0, 0)), []
    values, vectors = np.zeros(0), np.zeros((size, 0))
    negligible = 8 * np.finfo(float).eps * scale
    beta = 0.0
    while right.shape[1] < size:
        left = len(pivots)
        restart = beta <= negligible
        if restart:
            rest = _orthogonal(draw.standard_normal(size), right)
            beta = np.linalg.norm(rest)
        new = rest / beta
        expected = np.zeros(left)
        if not restart:
            expected[-1] = beta
        extra, square, product = _step(
            fit, n, sums, right[:, pivots], upper[:, pivots], new, expected
        )
        # What w still has of earlier left vectors goes; their products are known.
        product = product - images @ extra
        alpha = np.sqrt(max(square - extra @ extra, 0.0))
        if restart and alpha <= negligible:
            break
        right = np.column_stack([right, new])
        upper = np.column_stack([upper, expected + extra])
        beta = 0.0
        if alpha > negligible:
            pivots.append(right.shape[1] - 1)
            upper = np.vstack([upper, np.eye(1, right.shape[1], pivots[-1]) * alpha])
            images = np.column_stack([images, product / alpha])
            rest = _orthogonal(images[:, -1], right)
            beta = np.linalg.norm(rest)
        p, values, vt = np.linalg.svd(upper, full_matrices=False)
        vectors = right @ vt.T
        residuals = beta * np.abs(p[-1, :k])
        if beta > negligible and len(pivots) >= k and residuals.max() <= tolerance * values[0]:
            break
    return values[:k], vectors[:, :k], right.shape[1]


def fit_whitening(vectors: DataFrame, k: int = 4, tolerance: float = TOLERANCE) -> Whitening:
    """Components of the distinct rows of column ``x`` (arrays of long).

    Fewer than ``k`` when fewer directions have any variance; none for an empty table or
    equal rows only. Rows of different lengths are an error.
    """
    fit = shared_table(vectors.select("x").distinct(), "vectors")
    n, least, most = fit.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"vectors have between {least} and {most} entries")
    if not n or not most:
        return Whitening(n, [0] * (most or 0), np.zeros((most or 0, 0)), np.zeros(0), 0.0, 0)
    placed = fit.select(F.posexplode("x").alias("place", "value"))
    sums = np.zeros(most, np.int64)
    for place, total in placed.groupBy("place").agg(F.sum("value")).collect():
        sums[place] = total
    spread = _sum_by_place(fit, lambda x: np.square(_centred(x, n, sums)).sum(axis=0), most)
    trace = float(spread.sum()) / n
    if not trace:
        return Whitening(n, sums.tolist(), np.zeros((most, 0)), np.zeros(0), 0.0, 0)
    values, right, steps = bidiagonalise(
        fit, n, sums, min(k, most, n), np.sqrt(trace * n), tolerance
    )
    some = values > 1e-10 * values[0]
    model = Whitening(
        n, sums.tolist(), right[:, some], np.square(values[some]) / n, trace, steps
    )
    model.identity_error = _identity_error(fit, model)
    return model


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    n, sums = model.n, np.array(model.sums)
    project = model.vectors / np.sqrt(model.eigenvalues)
    k = project.shape[1]
    means = _sum_by_place(fit, lambda x: (_centred(x, n, sums) @ project).sum(axis=0), k) / n

    def products(column):
        rows = _centred(column, n, sums) @ project - means
        return (rows.T @ rows).ravel()

    covariance = _sum_by_place(fit, products, k * k).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def _whiten_batches(model: Whitening):
    """Function over Arrow batches (id, x): a row per component."""

    def run(batches):
        import pyarrow as pa

        sums = np.array(model.sums)
        project = model.vectors / np.sqrt(model.eigenvalues)
        k = project.shape[1]
        explained = model.eigenvalues / model.trace if k else model.eigenvalues
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            exact = _rows(batch.column("x")) * np.int64(model.n) - sums
            whitened = exact / model.n @ project
            rows = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    batch.column("deviation").take(pa.array(rows)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)),
                ],
                names=["id", "component", "deviation", "whitened", "explained"],
            )

    return run


def whiten(
    embeddings: DataFrame,
    k: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Whitened coordinates: a row per usable row and component.

    ``id``, ``component`` (from 1), ``n`` (distinct vectors), ``deviation`` (sum of (n x - S)^2, exact),
    ``whitened``, ``explained`` (share of the trace) and ``identity_error`` (largest entry of the
    whitened covariance minus the identity).

    Entries are scaled by 256 and floored to longs first. Rows whose vector is null, or
    holds null, NaN or infinite entries, are dropped; equal vectors count once in the
    fit and all get their rows, null ids too. A direction without variance gives no
    component, so an empty table, a single distinct vector and empty vectors give no rows.
    Vectors of different lengths are an error, and so is a deviation beyond a long.
    Other columns are not read, so none can clash.
    """
    rows = shared_table(
        embeddings.filter(usable(F.col(f"`{vector_col}`"))).select(
            F.col(f"`{id_col}`").alias("id"), scaled(F.col(f"`{vector_col}`")).alias("x")
        ),
        "scaled",
    )
    model = fit_whitening(rows, k, tolerance)
    means = F.array(*[F.lit(s) for s in model.sums]).cast(VECTOR)
    apart = F.zip_with("x", means, lambda x, s: x * F.lit(model.n) - s)
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: total + d * d)
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("component", T.IntegerType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
        ]
    )
    made = rows.withColumn("deviation", deviation).mapInArrow(_whiten_batches(model), schema)
    return made.select(
        "id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
