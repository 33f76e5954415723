"""Whitening of embeddings on their leading principal components, found by a block Jacobi-Davidson method.

The covariance is never formed. All the solver asks for is its product with a few vectors, one pass over the distinct
vectors: each task centres its rows before it multiplies, and partial products beyond ``DIRECT_BYTES`` are added up in
groups before they reach the driver. It holds matrices of (dimensions x search vectors) only; nothing there grows with the rows.

A step takes the Ritz pairs of the search space, locks the leading ones whose residual has reached ``TOLERANCE``, and expands the space by
corrections ``t`` of the others: (I - WW')(V - theta I)(I - WW') t = -r, W being the locked and the current vectors. All
corrections are solved at once by a few steps of MINRES, so a step of all of them costs one pass. A space that is full restarts
from its leading Ritz vectors; one that has as many vectors as dimensions is the whole space, and the pairs are exact then.

Vectors are fixed-point numbers: floor(64 c) + 1000000 of every entry. The fit list holds each distinct vector once, packed in blocks of
``BLOCK_ROWS`` rows in the shared scratch folder; a lost executor repeats its blocks.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out; so are those whose
length isn't the most frequent one (the longer at a tie). Repeated rows are all returned. A component without variance has null
``whitened`` (a table of one distinct vector has no other); ``explained`` is null where there is no variance at all and
``identity_error`` where no component has any. ``deviation`` is null where it doesn't fit in 64 bits. Vectors of fewer
dimensions than components give as many components as dimensions. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import scratch_path

COMPONENTS = 16
# Search directions beside the wanted ones, so that a cluster at the end of the wanted ones is seen whole.
GUARD = 4
SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 4096
# Partial products reach the driver at once where all tasks together give no more; else they are added up in as many groups as fit.
DIRECT_BYTES = 16 << 20
INNER_STEPS = 4
INNER_GAIN = 0.05
# Residual of a locked pair, as a share of the largest eigenvalue.
TOLERANCE = 1e-13
OUTER_STEPS = 200

_MAX_LONG = 2**63 - 1


@dataclass
class Pairs:
    """Leading eigenpairs: values, vectors as columns, their residuals, and the passes they took."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def _orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``vectors`` add to the space of ``against``."""
    for _ in range(3):
        vectors = vectors - against @ (against.T @ vectors)
        norms = np.linalg.norm(vectors, axis=0)
        vectors = vectors[:, norms > 0] / norms[norms > 0]
        if not vectors.shape[1]:
            return vectors
        left, sizes, _ = np.linalg.svd(vectors, full_matrices=False)
        vectors = left[:, sizes > 1e-8]
    return vectors


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Approximate solutions of ``product(x) = right`` for all columns at once, by MINRES from zero.

    ``product`` maps each column by a symmetric operator of its own. Ends after ``steps`` products, or when every residual
    is ``gain`` of what it was.
    """
    columns = right.shape[1]
    beta = np.linalg.norm(right, axis=0)
    start, live = beta.copy(), beta > 0
    x = np.zeros_like(right)
    before, now = np.zeros_like(right), np.divide(right, beta, where=live, out=np.zeros_like(right))
    w_before, w_now = np.zeros_like(right), np.zeros_like(right)
    cos_before, sin_before, cos, sin = np.ones(columns), np.zeros(columns), np.ones(columns), np.zeros(columns)
    rest, beta = beta.copy(), np.zeros(columns)
    for _ in range(steps):
        if not live.any():
            break
        after = product(now) - before * beta
        alpha = (now * after).sum(axis=0)
        after -= now * alpha
        beta_after = np.linalg.norm(after, axis=0)
        # The column of the tridiagonal matrix, turned by the two rotations before and then by a new one.
        epsilon, middle = sin_before * beta, cos_before * beta
        delta, gamma = cos * middle + sin * alpha, cos * alpha - sin * middle
        size = np.hypot(gamma, beta_after)
        live &= size > 1e-14 * np.maximum(np.abs(alpha), beta_after).clip(1e-300)
        safe = np.where(live, size, 1.0)
        cos_new, sin_new = gamma / safe, beta_after / safe
        w = np.where(live, (now - epsilon * w_before - delta * w_now) / safe, 0.0)
        x += np.where(live, cos_new * rest, 0.0) * w
        rest = np.where(live, -sin_new * rest, rest)
        live &= (np.abs(rest) > gain * start) & (beta_after > 1e-14 * start.clip(1e-300))
        before, now = now, after / np.where(beta_after > 0, beta_after, 1.0)
        w_before, w_now = w_now, w
        cos_before, sin_before, cos, sin, beta = cos, sin, cos_new, sin_new, beta_after
    return x


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray],
    dimensions: int,
    wanted: int,
    guard: int = GUARD,
    tolerance: float = TOLERANCE,
    inner_steps: int = INNER_STEPS,
    largest_space: int | None = None,
    seed: int = 1,
) -> Pairs:
    """The ``wanted`` largest eigenpairs of the symmetric ``product`` (a d x m matrix to a d x m matrix)."""
    wanted = min(wanted, dimensions)
    width = min(wanted + guard, dimensions)
    largest_space = min(largest_space or 4 * width, dimensions)
    done, done_values = np.zeros((dimensions, 0)), np.zeros(0)
    count = 0

    def mapped(vectors: np.ndarray) -> np.ndarray:
        nonlocal count
        count += 1
        return product(vectors)

    space = _orthonormal(np.random.default_rng(seed).standard_normal((dimensions, width)), done)
    image = mapped(space)
    for _ in range(OUTER_STEPS):
        inner = space.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, ritz_image = space @ turns, image @ turns
        residual = ritz_image - ritz * values
        residual -= done @ (done.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        top = max(abs(values[0]) if len(values) else 0.0, np.abs(done_values).max(initial=0.0))
        # Only leading pairs are locked, in order, so that none of a larger value is passed over.
        missing = wanted - len(done_values)
        locked = 0
        while locked < min(missing, len(values)) and sizes[locked] <= tolerance * top:
            locked += 1
        done, done_values = np.hstack([done, ritz[:, :locked]]), np.concatenate([done_values, values[:locked]])
        space, image, values, residual = ritz[:, locked:], ritz_image[:, locked:], values[locked:], residual[:, locked:]
        if len(done_values) == wanted:
            break
        if space.shape[1] + done.shape[1] >= dimensions:
            # Nothing is left to add: what residuals still show are rounding errors of the images.
            image = mapped(space)
            inner = space.T @ image
            values, turns = np.linalg.eigh((inner + inner.T) / 2)
            rest = wanted - len(done_values)
            done = np.hstack([done, (space @ turns[:, ::-1])[:, :rest]])
            break
        active = min(width, space.shape[1])
        theta, against = values[:active], np.hstack([done, space[:, :active]])

        def shifted(vectors: np.ndarray, theta=theta, against=against) -> np.ndarray:
            out = mapped(vectors) - vectors * theta
            return out - against @ (against.T @ out)

        right = -residual[:, :active]
        right = right - against @ (against.T @ right)
        step = minres(shifted, right, inner_steps, INNER_GAIN)
        if space.shape[1] + active > largest_space:
            keep = max(active, min(2 * width, largest_space - active))
            space, image = space[:, :keep], image[:, :keep]
        added = _orthonormal(np.where(np.linalg.norm(step, axis=0) > 0, step, right), np.hstack([done, space]))
        if not added.shape[1]:
            added = _orthonormal(np.random.default_rng(seed + count).standard_normal((dimensions, active)), np.hstack([done, space]))
        added = added[:, : max(dimensions - done.shape[1] - space.shape[1], 0)]
        space, image = np.hstack([space, added]), np.hstack([image, mapped(added)])
    # A last turn among the locked vectors, with fresh images.
    done, _ = np.linalg.qr(done)
    image = mapped(done)
    inner = done.T @ image
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    values, turns = values[::-1], turns[:, ::-1]
    vectors = done @ turns
    return Pairs(values, vectors, np.linalg.norm(image @ turns - vectors * values, axis=0), count)


def _fixed_point(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``x`` of the rows that remain."""
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    whole = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return rows.select("id", F.lit(None).cast("array<long>").alias("x")).limit(0)
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    return rows.filter(F.size("v") == sizes["d"]).select("id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


class Fit:
    """The distinct vectors, in blocks, with what one pass over them gives."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        path = scratch_path(self.spark, "vectors")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(0))
                for at in range(0, len(x), BLOCK_ROWS):
                    part = x[at : at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.tobytes()])], ["rows", "x"])

        rows.select("x").distinct().mapInArrow(packed, "rows long, x binary").write.parquet(path)
        self.blocks = self.spark.read.parquet(path)
        self.tasks = self.blocks.rdd.getNumPartitions()
        self.n = self.blocks.agg(F.sum("rows")).first()[0] or 0
        self.sums = self._added(lambda x: x.sum(axis=0), np.int64, 1 << 13) if self.n else np.zeros(0, dtype=np.int64)
        self.d = len(self.sums)

    def _added(self, fn: Callable[[np.ndarray], np.ndarray], dtype, size: int) -> np.ndarray:
        """The sum over all blocks of ``fn`` of a block, which is flat and has about ``size`` entries."""
        groups = max(DIRECT_BYTES // (8 * max(size, 1)), 1)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                for rows, raw in zip(batch["rows"], batch["x"]):
                    one = fn(np.frombuffer(raw, dtype=np.int64).reshape(rows, -1)).astype(dtype)
                    total = one if total is None else total + one
            if total is not None:
                yield pd.DataFrame({"part": [total.tobytes()]})

        def merged(group: pd.DataFrame) -> pd.DataFrame:
            parts = sorted(group["part"])
            return pd.DataFrame({"part": [sum(np.frombuffer(p, dtype=dtype) for p in parts).tobytes()]})

        parts = self.blocks.mapInPandas(partial, "part binary")
        if self.tasks > groups:
            parts = parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups))).applyInPandas(merged, "part binary")
        return sum(np.frombuffer(p, dtype=dtype) for p in sorted(r.part for r in parts.collect()))

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Whole vectors minus the mean: the whole part of the mean goes first, so no digit is lost."""
        whole, rest = self.sums // self.n, (self.sums % self.n) / self.n
        return lambda x: (x - whole).astype(np.float64) - rest

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times ``vectors``."""
        centred = self.centre()

        def partial(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return (c.T @ (c @ vectors)).ravel()

        return self._added(partial, np.float64, vectors.size).reshape(vectors.shape) / self.n

    def trace(self) -> float:
        centred = self.centre()
        return float(self._added(lambda x: np.array([np.square(centred(x)).sum()]), np.float64, 1)[0] / self.n)

    def identity_error(self, turn: np.ndarray) -> float:
        """How far the covariance of the whitened fit list is from the identity."""
        centred, k = self.centre(), turn.shape[1]

        def partial(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ turn
            return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

        total = self._added(partial, np.float64, k * (k + 1)) / self.n
        mean = total[k * k :]
        return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of squares of n x - S; null beyond 64 bits."""
    far = np.abs(x - sums // n).max(initial=0) + 1
    if float(far) ** 2 * float(n) ** 2 * x.shape[1] < 2.0**62:
        apart = (x - sums // n) * n - sums % n
        return np.square(apart).sum(axis=1).tolist()
    own = [int(s) for s in sums]
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, own)) for row in x]
    return [e if e <= _MAX_LONG else None for e in exact]


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error: one row per remaining row and component."""
    rows = _fixed_point(table, key, vector)
    fit = Fit(rows)
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not fit.n:
        return fit.spark.createDataFrame([], schema)
    pairs = jacobi_davidson(fit.product, fit.d, components)
    trace = fit.trace()
    varied = pairs.values > fit.d * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    turn = pairs.vectors / np.sqrt(np.where(varied, pairs.values, 1.0))
    error = fit.identity_error(turn[:, varied]) if varied.any() else None
    explained = [float(v) / trace if trace > 0 else None for v in pairs.values]
    n, sums, centred, k = int(fit.n), fit.sums, fit.centre(), len(pairs.values)
    names = [f.name for f in fit.spark.createDataFrame([], schema).schema]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            x = _matrix(batch.column(1))
            whitened = centred(x) @ turn
            flat = pa.array(whitened.ravel(), mask=~np.tile(varied, size))
            each = np.repeat(np.arange(size), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                flat,
                pa.array(explained * size, pa.float64()),
                pa.array([error] * (size * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(project, schema)
