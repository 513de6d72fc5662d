"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries c become integers x = floor(64 c) + 1,000,000. The covariance V of x is never formed: every pass over the
rows computes V·Y = (1/n) Xcᵀ(Xc·Y) for a block Y of p = k + guard columns, with Xc the rows centred before
multiplying, summed per partition with NumPy and over partitions by a grouped sum of the d·p entries. A Chebyshev
polynomial of V, run by its three-term recurrence, damps the spectrum below the least Ritz value of the block and
raises the wanted part; then QR, and Rayleigh-Ritz on one more pass. This repeats until the residual of every wanted
Ritz pair is below ``tol`` times the largest Ritz value; that last pass also yields the covariance of the whitened
values (QᵀVQ), which certifies the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

#: Entries of this magnitude or more count as non-finite: their x would leave the exact range of a double.
LARGEST = float(2 ** 40)
#: Eigenvalues up to this share of the trace are zero: whitening by them is undefined, so they give no component.
ZERO = 1e-12

SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, eigenvalue double")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as a (rows, d) array of doubles; shorter lists are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(column) and (lengths == d).all():
        return flat.reshape(len(column), d)
    out = np.zeros((len(column), d))
    rows = np.repeat(np.arange(len(column)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, np.arange(len(flat)) - starts] = flat
    return out


def _times(rows: DataFrame, n: int, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """V·block from one distributed pass: Xcᵀ(Xc·block) per partition, summed by entry, over n."""
    d, p = block.shape

    def partial(batches):
        acc = np.zeros((d, p))
        for batch in batches:
            x = _matrix(batch.column(0), d) - mean
            acc += x.T @ (x @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * p, dtype=np.int32)), pa.array(acc.ravel())],
                                         names=["k", "v"])

    sums = (rows.select("_y").mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
            .collect())  # d * p numbers
    out = np.zeros(d * p)
    for r in sums:
        out[r["k"]] = r["v"]
    return out.reshape(d, p) / n


def _ritz(q: np.ndarray, vq: np.ndarray):
    """Rayleigh-Ritz on the block: values falling, the block and its product rotated alike."""
    h = q.T @ vq
    theta, w = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-theta, kind="stable")
    theta, w = theta[order], w[:, order]
    return theta, q @ w, vq @ w


def leading(times, d: int, k: int, trace: float, degree: int = 8, guard: int = 16, tol: float = 1e-12,
            rounds: int = 200, seed: int = 7):
    """The k leading eigenpairs of a symmetric positive semi-definite d x d matrix known only by ``times(Y) = V·Y``.

    Returns values (falling), unit vectors as columns, and V times those vectors. Raises if not certified within
    ``rounds`` filter rounds."""
    p = min(d, k + guard)
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((d, p)))
    theta, q, vq = _ritz(q, times(q))
    for _ in range(rounds):
        wanted = min(k, int((theta > ZERO * trace).sum()))
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * theta[:wanted], axis=0)
        if p == d or wanted == 0 or residual.max() <= tol * theta[0]:
            return theta[:wanted], q[:, :wanted], vq[:, :wanted]
        low, cut = -ZERO * trace, max(theta[-1], ZERO * trace)
        centre, half = (cut + low) / 2, (cut - low) / 2
        before, now = q, (vq - centre * q) / half
        for _ in range(2, degree + 1):
            after = 2 * (times(now) - centre * now) / half - before
            scale = np.linalg.norm(after, axis=0)
            scale[scale == 0] = 1.0
            before, now = now / scale, after / scale
        q, _ = np.linalg.qr(now)
        theta, q, vq = _ritz(q, times(q))
    raise RuntimeError(f"subspace iteration not certified after {rounds} rounds")


def whiten(embeddings: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 32,
           scale: int = 64, offset: int = 1_000_000, degree: int = 8, guard: int = 16, tol: float = 1e-12,
           seed: int = 7) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue)``: each remaining row
    once per component.

    Rows whose vector is null or holds a null, NaN, infinite or huge (``LARGEST``) entry are dropped; the others,
    null ids and repeated rows included, are the fit list. Vectors shorter than the longest are padded with zeros
    (entries c = 0). Components are the unit eigenvectors of the covariance of x (divisor n) by falling eigenvalue,
    at most ``components``, and only those with an eigenvalue above ``ZERO`` times the trace: a table of one row, of
    equal rows or of empty vectors has none and gives no rows, as does an empty table. ``deviation`` is the exact
    sum over dimensions of (n·x − S)²; ``whitened`` is (x − S/n)·q / sqrt(e); ``explained`` is e / trace(V);
    ``identity_error`` the largest entry of |QᵀVQ/sqrt(e eᵀ) − I|, with VQ from the last pass over the rows.
    Further columns of the input are ignored."""
    spark = embeddings.sparkSession
    v = F.col(column)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(LARGEST)))
    y = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = stored(embeddings.where(fine).select(F.col(key).cast("long").alias("_key"), y.alias("_y")), "whiten")
    sums = (rows.select(F.posexplode("_y").alias("i", "y")).groupBy("i")
            .agg(F.sum("y").alias("s"), F.sum(F.col("y").cast("decimal(38,0)") * F.col("y")).alias("q")).collect())
    n = rows.count()
    d = 1 + max((r["i"] for r in sums), default=-1)
    s, squares = [0] * d, [0] * d
    for r in sums:
        s[r["i"]], squares[r["i"]] = int(r["s"]), int(r["q"])
    trace = sum(n * squares[i] - s[i] * s[i] for i in range(d)) / n / n if n else 0.0
    if n < 2 or d == 0 or trace <= 0:
        return spark.createDataFrame([], SCHEMA)
    mean = np.array(s, dtype=np.float64) / n
    values, vectors, products = leading(lambda block: _times(rows, n, mean, block), d, min(components, d), trace,
                                        degree, guard, tol, seed=seed)
    if len(values) == 0:
        return spark.createDataFrame([], SCHEMA)
    root = np.sqrt(values)
    covariance = (vectors.T @ products) / np.outer(root, root)
    identity_error = float(np.abs(covariance - np.eye(len(values))).max())
    projection = vectors / root
    explained = values / trace
    exact_s = np.array(s, dtype=object)

    def emit(batches):
        kk = len(values)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            rows_ = len(x)
            if rows_ == 0:
                continue
            whitened = (x - mean) @ projection
            ints = np.rint(x).astype(np.int64)
            spread = ints * n - np.array(s, dtype=np.int64)
            if np.abs(spread).max(initial=0) < 2 ** 31 // max(1, int(np.sqrt(d))):
                deviation = (spread * spread).sum(axis=1)
            else:  # exact in Python integers where 64 bits could overflow
                wide = ints.astype(object) * n - exact_s
                deviation = np.array([int(sum(t * t for t in row)) for row in wide], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), kk)) if batch.column(0).null_count
                == 0 else pa.array(np.repeat(np.array(batch.column(0).to_pylist(), dtype=object), kk), pa.int64()),
                pa.array(np.tile(np.arange(1, kk + 1, dtype=np.int32), rows_)),
                pa.array(np.full(rows_ * kk, n, dtype=np.int64)),
                pa.array(np.repeat(deviation, kk)),
                pa.array(whitened.ravel()),
                pa.array(np.tile(explained, rows_)),
                pa.array(np.full(rows_ * kk, identity_error)),
                pa.array(np.tile(values, rows_))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
                       "eigenvalue"])

    return rows.select("_key", "_y").mapInArrow(emit, SCHEMA)
