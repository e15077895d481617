"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integer lattice points; statistics are fitted on each distinct point once.  The
covariance is never formed: one distributed pass gives (centred X)' (centred X) Q for a narrow
block Q.  A Chebyshev recurrence over such passes damps the unwanted part of the spectrum, whose
ends come from Lanczos steps and from the block's own smallest Ritz value; QR and Rayleigh-Ritz
follow, and cycles repeat until the residuals certify every wanted pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ship import ship
from tidemark.llm.text import slices
from tidemark.session import materialized

#: The lattice: x = floor(SCALE * c) + SHIFT, with SCALE * c held within +-LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 52
COMPONENTS = 16
#: Columns of the block beyond the wanted ones, and Lanczos steps for the spectrum's lower end.
GUARD, LANCZOS = 16, 8
#: A pair is certified when its residual is below this share of the largest eigenvalue; where
#: rounding keeps it from falling further, COARSE is the least that counts.
TOLERANCE, COARSE = 2e-14, 1e-11
#: Highest degree of a filter, and by how much it may lift the first pair over the last wanted one.
DEGREE, LIFT = 12, 1e11
MAX_PASSES = 5000
#: Bytes of a block of points in the fit list, and partial results that the driver adds up itself.
BLOCK_BYTES, PARTS = 1 << 21, 64
#: An eigenvalue below this share of the largest one is no variance but rounding.
RANK = 1e-12


def lattice(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: rows whose vector is there and has finite entries only, as lattice points."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), entries.alias("v")).where("v is not null")
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))

    def point(c):
        held = F.greatest(F.least(F.lit(float(SCALE)) * c, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
        return F.floor(held) + F.lit(SHIFT)

    return rows.where(finite).select("vec_id", F.transform("v", point).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _pack_blocks(width: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, max(1, BLOCK_BYTES // (8 * width))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block"])

        for batch in batches:
            held.append(_matrix(batch.column("x"), width).copy())
            rows += batch.num_rows
            if rows >= most:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return blocks


class FitList:
    """The distinct points, as written blocks, and one-pass sums over them."""

    def __init__(self, points: DataFrame, width: int):
        self.spark, self.width = points.sparkSession, width
        self.blocks = materialized(points.select("x").distinct().mapInArrow(_pack_blocks(width), "block binary"), "fit-list")
        self.parts = self.blocks.rdd.getNumPartitions()
        total = self._sum(lambda x, _: [np.r_[len(x), (x - SHIFT).sum(axis=0)]], [np.zeros(width + 1, np.int64)], None, exact=True)
        self.n = int(total[0][0])
        #: Sums of the points, whole numbers of any size.
        self.sums = [int(s) + SHIFT * self.n for s in total[0][1:]]
        self.base = np.array([s // self.n if self.n else 0 for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n if self.n else 0.0 for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.base, self.rest)

    def _sum(self, share: Callable, zeros: list[np.ndarray], given, exact: bool = False) -> list[np.ndarray]:
        """Adds up `share(points, given)` over all blocks; tasks add first, then groups of tasks."""
        width, kinds = self.width, [(z.dtype.str, z.shape) for z in zeros]
        shared = self.spark.sparkContext.broadcast(given)  # some columns of `width` numbers

        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())], ["part"])

        def unpacked(blob: bytes) -> list[np.ndarray]:
            out, at = [], 0
            for kind, shape in kinds:
                size = np.dtype(kind).itemsize * math.prod(shape)
                out.append(np.frombuffer(blob[at : at + size], kind).reshape(shape))
                at += size
            return out

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(shape, kind) for kind, shape in kinds]
            for batch in batches:
                for blob in batch.column("block"):
                    x = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, width)
                    total = [t + s for t, s in zip(total, share(x, shared.value), strict=True)]
            yield packed(total)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(shape, kind) for kind, shape in kinds]
            for batch in batches:
                for blob in batch.column("part").to_pylist():
                    total = [t + s for t, s in zip(total, unpacked(blob), strict=True)]
            yield packed(total)

        parts = self.blocks.mapInArrow(task, "part binary")
        if self.parts > PARTS:  # the driver gets a bounded number of partial sums
            parts = parts.repartition(PARTS).mapInArrow(merge, "part binary")
        total = [z.astype(object) if exact else z.copy() for z in zeros]
        for row in parts.collect():
            total = [t + s for t, s in zip(total, unpacked(bytes(row["part"])), strict=True)]
        shared.unpersist()
        return total

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times `q`, centred before multiplying."""
        base, rest = self.base, self.rest

        def share(x, q):
            c = centred(x, base, rest)
            return [c.T @ (c @ q)]

        return self._sum(share, [np.zeros(q.shape)], q)[0] / self.n

    def trace(self) -> float:
        base, rest = self.base, self.rest
        return float(self._sum(lambda x, _: [np.array([(centred(x, base, rest) ** 2).sum()])], [np.zeros(1)], None)[0][0]) / self.n

    def identity_error(self, axes: np.ndarray) -> float:
        """The largest entry of the whitened fit list's covariance minus the identity."""
        base, rest = self.base, self.rest

        def share(x, axes):
            w = centred(x, base, rest) @ axes
            return [w.sum(axis=0), w.T @ w]

        k = axes.shape[1]
        sums, squares = self._sum(share, [np.zeros(k), np.zeros((k, k))], axes)
        mean = sums / self.n
        return float(np.abs(squares / self.n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean, whose whole part is taken off as integers."""
    return (x - base).astype(np.float64) - rest


def _lower_end(product: Callable, q: np.ndarray, rng) -> tuple[float, np.ndarray]:
    """A lower bound of the spectrum by Lanczos steps; `q` takes a power step in each pass."""
    d = len(q)
    v = rng.standard_normal(d)
    basis, alphas, betas = [v / np.linalg.norm(v)], [], []
    for _ in range(min(LANCZOS, d)):
        both = product(np.column_stack([q, basis[-1]]))
        q, w = np.linalg.qr(both[:, :-1])[0], both[:, -1]
        alphas.append(float(basis[-1] @ w))
        for b in basis + basis:  # orthogonal to all before, twice
            w = w - b * (b @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            betas[-1] = 0.0
            break
        basis.append(w / betas[-1])
    t = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, float(values[0]) - betas[-1] * abs(float(vectors[-1, 0]))), q


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit vectors (columns), certified.

    `product` multiplies a symmetric, nowhere negative d x d matrix with a block.
    """
    wanted = min(wanted, d)
    k = min(d, wanted + GUARD)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    low, q = _lower_end(product, q, rng) if k < d else (0.0, q)
    best, stuck, passes = math.inf, 0, 0
    while passes < MAX_PASSES:
        aq = product(q)
        passes += 1
        h = q.T @ aq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        top = float(values[0])
        if top <= 0:
            return np.zeros(wanted), q[:, :wanted]
        residuals = np.linalg.norm(aq - q * values, axis=0)[:wanted] / top
        residual = float(residuals.max())
        stuck = 0 if residual < best / 2 else stuck + 1
        best = min(best, residual)
        if residual <= TOLERANCE or k == d or (stuck >= 4 and residual <= COARSE):
            return values[:wanted], q[:, :wanted]
        # Leading pairs that are certified stay as they are; the filter works beside them.
        locked = int(np.argmax(residuals > TOLERANCE))
        fixed, cut = q[:, :locked], float(values[-1])
        half = max((cut - low) / 2, 1e-13 * top)
        middle = low + half
        first, last = (math.acosh(max(1.0, (float(values[i]) - middle) / half)) for i in (locked, wanted - 1))
        needed = math.log(residual / TOLERANCE) / max(last, 1e-3) + 1
        degree = int(max(2, min(DEGREE, needed, math.log(LIFT) / max(first - last, 1e-3))))
        # Chebyshev polynomials of the covariance on [low, cut], scaled so that the first pair keeps its length.
        sigma = scale = half / max(float(values[locked]) - middle, half)
        before, now = q[:, locked:], (aq[:, locked:] - middle * q[:, locked:]) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / scale - sigma)
            step = product(now)
            passes += 1
            before, now = now, (step - middle * now) * (2 * after / half) - before * (sigma * after)
            now -= fixed @ (fixed.T @ now)
            sigma = after
        q = np.linalg.qr(np.column_stack([fixed, now]))[0]
    raise ArithmeticError(f"no certified eigenpairs after {MAX_PASSES} passes")


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: what `whiten` applies to rows."""

    n: int
    sums: list[int]
    base: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def axes(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(points: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Fits on the distinct points `x`, all of `width` entries."""
    listed = FitList(points, width)
    if not listed.n or not width:
        none = np.zeros((width, 0))
        return Whitening(listed.n, listed.sums, listed.base, listed.rest, none, np.zeros(0), 0.0, 0.0)
    values, vectors = leading_pairs(listed.product, width, components)
    some = values > RANK * max(float(values[0]), 0.0)
    values, vectors = values[some], vectors[:, some]
    return Whitening(
        listed.n, listed.sums, listed.base, listed.rest, vectors, values, listed.trace(),
        listed.identity_error(vectors / np.sqrt(values)),
    )


def deviations(x: np.ndarray, n: int, sums: list[int], base: np.ndarray) -> list[int | None]:
    """Per row the sum of (n * x - S)^2 over its entries, exact; null where a long cannot hold it."""
    offset = [s - n * int(b) for s, b in zip(sums, base, strict=True)]
    apart = x - base
    most = float(n) * (float(np.abs(apart).max(initial=0)) + 1)
    if most * most * max(1, x.shape[1]) < 2.0**62:
        return ((n * apart - np.array(offset, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - o) ** 2 for a, o in zip(row, offset, strict=True)) for row in apart]
    return [e if e < 1 << 63 else None for e in exact]


def _project(shared):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Whitening = shared.value
        axes, k = own.axes, len(own.values)
        shares = own.values / own.trace
        for batch in slices(batches):
            x = _matrix(batch.column("x"), len(own.base))
            rows = np.repeat(np.arange(len(x)), k)
            exact = pa.array(deviations(x, own.n, own.sums, own.base), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), own.n, np.int64)),
                    exact.take(pa.array(rows)),
                    pa.array((centred(x, own.base, own.rest) @ axes).ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(rows), own.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return project


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    One row per component (at most `components`, numbered from 1 by falling variance) and row of
    `vectors`, but for rows without a vector or with null or non-finite entries.  Where vectors
    differ in length, the most frequent length counts (of ties the smaller) and the others are
    left out.  Entries beyond +-2^52 / 64 are held there.  Directions without variance are no
    components, so a single distinct vector, empty vectors or an empty table give no rows.
    `deviation` is null where a long cannot hold it.  Null and repeated ids are carried along,
    repeated rows are fitted once; other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    points = lattice(vectors, id_col, vector_col)
    kind = points.schema["vec_id"].dataType.simpleString()
    sizes = points.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", (-F.col("d")).alias("minus"))).alias("most")).first()["most"]
    width = -most["minus"] if most else 0
    points = points.where(F.size("x") == width)
    fitted = fit(points, width, components) if width else Whitening(0, [], *[np.zeros(0)] * 2, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(fitted.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fitted)  # `components` columns of `width` numbers
    return points.mapInArrow(_project(shared), schema)
