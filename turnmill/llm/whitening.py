"""Whitening of embeddings along the leading eigenvectors of their covariance, found by the Jacobi-Davidson method.

The covariance is never formed.  All that is asked of the data is its product with a few vectors at a time,
``V u = sum((x - m) ((x - m) u)) / n``, every row centred before it is multiplied: each task returns one partial sum per
entry, Spark adds them up, and the driver holds vectors of the embedding's dimension alone.

1. Rayleigh-Ritz: the products of a short orthonormal basis give the Ritz pairs of its span.
2. Pairs whose residual ``V u - e u`` has reached double precision are locked, in falling order.
3. For every other wanted pair the correction equation ``(I - QQ')(V - e I)(I - QQ') t = -r`` is solved roughly by MINRES, Q
   being the locked vectors and the pair's own; the equations of all open pairs share each pass over the data.
4. The corrections join the basis, which is cut back to its leading Ritz vectors when it grows long.

The covariance is taken over the fit list, each different vector once, with its number as divisor.  Vectors are whole numbers
``floor(scale * entry)``.

Rows whose vector is null, has null or non-finite entries, or has another length than most vectors (ties: the longer) have no
result.  Equal rows have equal results, repeated and null ids keep a row each.  A component without variance (fewer different
vectors than components, constant entries) has a null ``whitened`` and ``explained`` 0.  A ``deviation`` beyond the range of a
long is null.  An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import read_only_columns, stage

SCALE = 256
COMPONENTS = 4
INNER = 6
MAX_BASIS = 48
MAX_OUTER = 60
SEED = 11
# Vectors in a block of the fit list.
BLOCK = 2048
EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Fit:
    """What whitening needs to know of the fit list: exact sums, leading eigenpairs, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    products: int = 0
    identity_error: float = 0.0


def minres(product: Product, rhs: np.ndarray, shifts: np.ndarray, bases: list[np.ndarray], steps: int, rtol: float) -> np.ndarray:
    """Solves ``P_j (V - shift_j) P_j t_j = rhs_j`` for all columns j, ``P_j`` projecting off ``bases[j]``; one product a step.

    The columns are independent MINRES runs; a run that has reached ``rtol`` or broken down stands still.
    """
    def project(block: np.ndarray) -> np.ndarray:
        out = block.copy()
        for j, q in enumerate(bases):
            out[:, j] -= q @ (q.T @ out[:, j])
        return out

    r = project(rhs)
    beta = np.linalg.norm(r, axis=0)
    goal = rtol * beta
    live = beta > 0
    v_old, v = np.zeros_like(r), r / np.where(live, beta, 1)
    w_old, w = np.zeros_like(r), np.zeros_like(r)
    x = np.zeros_like(r)
    eta, c_old, c, s_old, s = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    step_beta = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v) - v * shifts)
        alpha = np.sum(v * p, axis=0)
        p = p - alpha * v - step_beta * v_old
        # One more pass against the last two vectors and the bases keeps the short recurrence clean.
        p = project(p - v * np.sum(v * p, axis=0))
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * step_beta
        rho1 = np.hypot(delta, after)
        rho2 = s * alpha + c_old * c * step_beta
        rho3 = s_old * step_beta
        live &= rho1 > 0
        safe = np.where(rho1 > 0, rho1, 1)
        c_new, s_new = delta / safe, after / safe
        direction = (v - rho3 * w_old - rho2 * w) / safe
        x = np.where(live, x + c_new * eta * direction, x)
        w_old, w = w, direction
        eta = -s_new * eta
        c_old, c, s_old, s = c, c_new, s, s_new
        v_old, v, step_beta = v, p / np.where(after > 0, after, 1), after
        live &= (np.abs(eta) > goal) & (after > 0)
    return project(x)


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns of ``block`` made orthonormal to ``basis`` and to each other; those that vanish are left out."""
    kept = basis
    for column in block.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        q = column / size
        for _ in range(3):
            q = q - kept @ (kept.T @ q)
            left = np.linalg.norm(q)
            if left < 1e-10:
                break
            q = q / left
        else:
            kept = np.column_stack([kept, q])
    return kept[:, basis.shape[1]:]


def jacobi_davidson(product: Product, dim: int, wanted: int = COMPONENTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(values, vectors, residual norms)`` of the leading eigenpairs of the operator behind ``product``, by falling value."""
    wanted = min(wanted, dim)
    start = np.random.default_rng(seed).standard_normal((dim, min(dim, 2 * wanted)))
    basis = orthonormal(start, np.zeros((dim, 0)))
    images = product(basis)
    best, idle = np.inf, 0
    for outer in range(MAX_OUTER):
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn[:, :wanted], images @ turn[:, :wanted]
        rest = moved - ritz * theta[:wanted]
        norms = np.linalg.norm(rest, axis=0)
        scale = max(abs(theta[0]), np.finfo(float).tiny)
        tol = 32 * EPS * scale
        # Locked pairs are the leading ones without a gap, so that no larger pair can still turn up before them.
        locked = int(np.argmax(norms > tol)) if (norms > tol).any() else wanted
        worst = norms.max() / scale
        idle = idle + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        whole = basis.shape[1] == dim
        if locked == wanted or (whole and outer) or (best < 1e-12 and idle >= 2):
            break
        if basis.shape[1] + wanted - locked > min(MAX_BASIS, dim):
            keep = turn[:, :2 * wanted]
            basis, images = basis @ keep, images @ keep
        open_pairs = range(locked, wanted)
        bases = [np.column_stack([ritz[:, :locked], ritz[:, j]]) for j in open_pairs]
        fixes = minres(product, -rest[:, locked:], theta[locked:wanted], bases, INNER, 2.0 ** -(outer + 1))
        fresh = orthonormal(fixes, basis)
        if not fresh.shape[1]:  # the corrections lie in the span already: widen it at random
            fresh = orthonormal(np.random.default_rng([seed, outer]).standard_normal((dim, wanted)), basis)
            if not fresh.shape[1]:
                break
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, product(fresh)])
    return theta[:wanted], ritz, norms


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the usable rows: ``x`` is ``floor(scale * entry)`` of every entry, as longs."""
    rows = read_only_columns(embeddings, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    usable = rows.where("size(c) > 0 AND forall(c, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    lengths = stage(usable.groupBy(F.size("c").alias("dim")).agg(F.count(F.lit(1)).alias("n")), "whitening-lengths")
    # One row per length; the longest of the most frequent ones.
    top = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    return usable.where(F.size("c") == (top["dim"] if top else 0)).select("vec_id", F.transform("c", lambda e: F.floor(e * scale)).alias("x"))


def packed(rows: DataFrame) -> DataFrame:
    """``(size, block)``: the rows ``x`` in blocks of ``BLOCK`` vectors, each a string of bytes, for the many passes to come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                data = matrix(part["x"]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([data], pa.binary())], ["size", "block"])

    return rows.mapInArrow(run, "size long, block binary")


def summed(blocks: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of what ``partial`` gives for their vectors: ``size`` numbers, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for rows, block in zip(batch["size"].to_pylist(), batch["block"], strict=True):
                x = np.frombuffer(block.as_buffer(), "<i8").reshape(rows, -1)
                total += partial(x.astype(np.float64)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    found = blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> Fit | None:
    """The leading eigenpairs over the different vectors ``x`` of ``vectors``; None if there are none."""
    listed = stage(vectors.select("x").distinct(), "whitening-fit")
    first = listed.first()
    if first is None:
        return None
    dim = len(first["x"])
    sums = listed.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dim)]).first()
    n, exact = sums["n"], [int(sums[f"s{k}"]) for k in range(dim)]
    mean = np.array([s / n for s in exact])
    blocks = stage(packed(listed), "whitening-blocks")
    count = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal count
        count += 1

        def partial(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)
        return summed(blocks, partial, block.size).reshape(block.shape) / n

    trace = float(summed(blocks, lambda x: np.sum((x - mean) ** 2, axis=0), dim).sum() / n)
    if trace == 0:
        k = min(wanted, dim)
        return Fit(n, exact, np.zeros(k), np.eye(dim)[:, :k], 0.0, np.zeros(k))
    values, axes, residuals = jacobi_davidson(product, dim, wanted)
    flat = values <= dim * EPS * trace
    found = Fit(n, exact, np.where(flat, 0.0, values), axes, trace, residuals, count)
    use = ~flat
    map_ = axes[:, use] / np.sqrt(values[use])
    k = int(use.sum())
    # The covariance of the whitened rows themselves; their mean is taken off first, as it is zero up to rounding only.
    centre = summed(blocks, lambda x: ((x - mean) @ map_).sum(axis=0), k) / n

    def square(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ map_ - centre
        return y.T @ y
    found.identity_error = float(np.abs(summed(blocks, square, k * k).reshape(k, k) / n - np.eye(k)).max())
    return found


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "eigenvalue double")


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable row and component: ``SCHEMA``.

    ``deviation`` is the exact sum of ``(n x - S)^2``; ``whitened`` is the centred row along the component, over the root of
    its eigenvalue; ``explained`` is the eigenvalue's share of the trace; ``identity_error`` is the largest entry by which the
    covariance of the whitened fit list differs from the identity.
    """
    vectors = stage(whole_vectors(embeddings, scale), "whitening-vectors")
    found = fit(vectors, wanted)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    n, sums, mean = found.n, np.array(found.sums, object), np.array([s / found.n for s in found.sums])
    values, axes = found.values, found.vectors
    map_ = axes / np.sqrt(np.where(values > 0, values, 1))
    k = len(values)
    shares = [float(v / found.trace) if found.trace else 0.0 for v in values]
    error = found.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, found_sums))
        if len(found_sums) * reach * reach < 1 << 63:
            gap = n * x - np.array(found_sums, np.int64)
            return np.sum(gap * gap, axis=1).tolist()
        big = [sum((n * int(a) - s) ** 2 for a, s in zip(row, found_sums, strict=True)) for row in x]
        return [b if b < 1 << 63 else None for b in big]

    found_sums = [int(s) for s in sums]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part["x"])
                y = (x - mean) @ map_
                rows = len(x)
                whitened = pa.array(y.reshape(-1), mask=np.tile(values <= 0, rows))
                once = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"].take(pa.array(once)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, n)), pa.array(deviations(x), pa.int64()).take(pa.array(once)), whitened,
                     pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error)), pa.array(np.tile(values, rows))], names)

    return vectors.mapInArrow(run, SCHEMA)
