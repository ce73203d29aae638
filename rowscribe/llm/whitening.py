"""Whitening of embeddings; components from a FEAST contour integration.

Counts, sums and covariances are gathered by Spark: every task adds up its rows,
the parts of each matrix row meet in one small group, and only matrices of the
vectors' dimension reach the driver. The covariance's eigenpairs come from slices
of its spectrum. Sylvester's law gives the number of eigenvalues above any point
from the signs of the pivots of a symmetric factorisation (the inertia), which
places the slices in gaps and says how many components each must hold. A slice is
a circle around its eigenvalues: a Gauss-Legendre quadrature of complex shifted
solves over it filters a random block onto the wanted eigenspace, a Rayleigh-Ritz
step extracts the components, and both repeat until residuals are at rounding
level. A slice whose pairs do not number its inertia count is solved again with
a larger block, so none is missed. Slices are independent and run as Spark rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.session import cut

COMPONENTS = 32
#: An entry becomes the whole number floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this size count as not finite, since their whole numbers would not fit.
LARGEST = float(1 << 50)
#: Eigenvalues in a slice, and quadrature nodes on its upper half circle.
SLICE, NODES = 8, 8
#: An eigenvalue counts as zero below this part of the largest one.
ZERO = 1e-13

WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and component.

    A vector takes no part if it is null, empty, holds null or non-finite entries
    or is of another length than most are (of equally many, the longest). Entries
    are taken as whole numbers x = floor(64 * c) + 1000000. deviation is the exact
    sum over the dimensions of (n * x - sum of x) ** 2, null if it does not fit a
    long. Components of zero variance have no whitened value and are left out, so a
    table of equal vectors, or an empty one, gives no rows. Repeated rows are kept
    and count as often as they occur, rows without vec_id too. Other columns are not
    read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    rows = rows.filter(usable & (F.size("embedding") > 0))
    most = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    out = rows.limit(0).select("vec_id", *[F.lit(None).cast(k).alias(c) for c, k in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    if most is None:
        return out
    rows, d, n = rows.filter(F.size("embedding") == most["size"]), most["size"], most["count"]
    sums = [int(x) for x in whole_sums(rows, d)]
    mean = np.array([s / n for s in sums])
    covariance = moments(rows, d, lambda x: x - mean) / n
    values, axes = leading(rows.sparkSession, covariance, min(components, d))
    if not len(values):
        return out
    scaled = axes / np.sqrt(values)
    identity = moments(rows, len(values), lambda x: (x - mean) @ scaled) / n - np.eye(len(values))
    error = float(np.abs(identity).max())
    explained = values / np.trace(covariance)
    white = rows.mapInArrow(lambda batches: _white(batches, d, n, sums, mean, scaled, explained), WHITE)
    return white.withColumn("identity_error", F.lit(error))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _whole(column: pa.Array, d: int) -> np.ndarray:
    return np.floor(SCALE * _matrix(column, d)).astype(np.int64) + SHIFT


def whole_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums of the whole numbers of each dimension."""

    def add(batches):
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _whole(batch.column("embedding"), d)
            high += (x >> 31).sum(axis=0)
            low += (x & 0x7FFFFFFF).sum(axis=0)
        yield pa.record_batch({"dimension": np.arange(d, dtype=np.int32), "high": high, "low": low})

    parts = rows.select("embedding").mapInArrow(add, "dimension int, high long, low long")
    exact = F.sum(F.col("high").cast("decimal(38,0)")) * 2147483648 + F.sum(F.col("low").cast("decimal(38,0)"))
    return [r.total for r in parts.groupBy("dimension").agg(exact.alias("total")).orderBy("dimension").collect()]


def moments(rows: DataFrame, d: int, centred) -> np.ndarray:
    """Sum over the rows of the outer product of their (centred) vectors, in double precision."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = centred(_whole(batch.column("embedding"), len(batch.column("embedding")[0])).astype(np.float64))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.record_batch({"part": pa.array([_part()] * d, pa.int32()), "dimension": np.arange(d, dtype=np.int32), "products": [r.tobytes() for r in total]})

    def gather(table: pa.Table) -> pa.Table:
        # Parts are added in their order, so a rerun gives the same sums.
        table = table.combine_chunks().sort_by("part")
        total = np.sum([np.frombuffer(x.as_buffer()) for x in table["products"]], axis=0)
        return pa.table({"dimension": table["dimension"][:1].combine_chunks(), "products": [total.tobytes()]})

    parts = rows.select("embedding").mapInArrow(add, "part int, dimension int, products binary")
    found = parts.groupBy("dimension").applyInArrow(gather, "dimension int, products binary").collect()
    total = np.zeros((d, d))
    for r in found:
        total[r.dimension] = np.frombuffer(bytes(r.products))
    return (total + total.T) / 2


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _white(batches, d: int, n: int, sums: list[int], mean: np.ndarray, scaled: np.ndarray, explained: np.ndarray):
    k = scaled.shape[1]
    for whole in batches:
        # A row becomes k rows.
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            x = _whole(batch.column("embedding"), d)
            white = (x.astype(np.float64) - mean) @ scaled
            m = batch.num_rows
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, n),
                    "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": white.ravel(),
                    "explained": np.tile(explained, m),
                }
            )


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum) ** 2, exact, or None beyond a long."""
    rough = np.abs(n * x.astype(np.float64) - np.array(sums, np.float64))
    if x.size and max(map(abs, sums)) < 1 << 62 and n * float(np.abs(x).max()) < 2.0**62 and rough.max() < 2.0**31 and x.shape[1] * float(rough.max()) ** 2 < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``.

    The signs of the pivots of a symmetric factorisation with diagonal pivots of one
    or two rows, the largest first (Bunch and Parlett).
    """
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = np.abs(a)
        diagonal = np.argmax(size.diagonal())
        i, j = np.unravel_index(np.argmax(np.where(np.eye(len(a), dtype=bool), -1, size)), a.shape) if len(a) > 1 else (0, 0)
        if len(a) == 1 or size[diagonal, diagonal] >= 0.64 * size[i, j]:
            pivot = a[diagonal, diagonal]
            above += pivot > 0
            rest = np.arange(len(a)) != diagonal
            step = np.outer(a[rest, diagonal], a[diagonal, rest]) / pivot if pivot else 0.0
        else:
            # A pivot of two rows has one eigenvalue of each sign.
            above += 1
            rest = (np.arange(len(a)) != i) & (np.arange(len(a)) != j)
            step = a[np.ix_(rest, [i, j])] @ np.linalg.solve(a[np.ix_([i, j], [i, j])], a[np.ix_([i, j], rest)])
        a = a[np.ix_(rest, rest)] - step
    return int(above)


def slices(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the top down until ``wanted`` are held, limits in gaps.

    Eigenvalues closer than rounding are not parted, so the last slice may hold more.
    """
    top = float(np.linalg.norm(matrix, np.inf))
    if not top:
        return []
    floor, resolution = top * ZERO, top * 1e-14
    found, held, high = [], 0, top * (1 + 1e-9)
    rank = inertia(matrix, floor)
    wanted = min(wanted, rank)
    while held < wanted:
        goal = min(held + SLICE, wanted)
        if goal >= rank:
            low = floor
        else:
            low = _gap(matrix, goal, floor, high, resolution)
        count = inertia(matrix, low) - held
        found.append((low, high, count))
        held, high = held + count, low
    return found


def _gap(matrix: np.ndarray, goal: int, low: float, high: float, resolution: float) -> float:
    """The middle of the gap below the ``goal``-th eigenvalue, or below the cluster that holds it."""
    # The goal-th eigenvalue lies between these two.
    above, below = high, low
    while above - below > resolution:
        middle = (above + below) / 2
        if inertia(matrix, middle) >= goal:
            below = middle
        else:
            above = middle
    edge = below
    held = inertia(matrix, edge - 4 * resolution)
    # The next eigenvalue below it.
    above, below = edge - 4 * resolution, low
    while above - below > resolution:
        middle = (above + below) / 2
        if inertia(matrix, middle) > held:
            below = middle
        else:
            above = middle
    return (edge + below) / 2


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, falling, and unit eigenvectors."""
    d = len(matrix)
    scale = np.linalg.norm(matrix, np.inf)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    shifts = centre + radius * np.exp(1j * angles)
    width = min(d, max(count + 2, int(1.5 * count) + 1))
    random = np.random.default_rng(seed)
    while True:
        block = random.standard_normal((d, width))
        last = np.inf
        for _ in range(40):
            filtered = np.zeros((d, width))
            for shift, weight, angle in zip(shifts, weights, angles, strict=True):
                solved = np.linalg.solve(shift * np.eye(d) - matrix, block.astype(complex))
                filtered += (weight / 2 * radius * np.exp(1j * angle) * solved).real
            basis, _ = np.linalg.qr(filtered)
            ritz, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turn
            inside = np.flatnonzero((ritz > low) & (ritz < high))
            pairs = block[:, inside]
            residual = np.linalg.norm(matrix @ pairs - pairs * ritz[inside], axis=0).max(initial=0.0) / scale
            # Down to rounding level: until it no longer shrinks.
            if len(inside) == count and residual <= 1e-12 and residual >= last / 2:
                break
            last = residual
        if len(inside) == count and residual <= 1e-10:
            order = inside[::-1]
            return ritz[order], block[:, order]
        if width == d:
            raise ArithmeticError(f"{len(inside)} eigenvalues found, {count} expected by inertia")
        width = min(d, 2 * width)


def leading(spark, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues that are not zero, falling, and their unit eigenvectors as columns."""
    tasks = slices(covariance, wanted)
    if not tasks:
        return np.zeros(0), np.zeros((len(covariance), 0))

    def solve(batches):
        for batch in batches:
            for low, high, count in zip(*[batch.column(c).to_pylist() for c in ("low", "high", "count")], strict=True):
                values, axes = feast(covariance, low, high, count)
                yield pa.record_batch({"value": values, "axis": [x.tobytes() for x in np.ascontiguousarray(axes.T)]})

    work = spark.createDataFrame(tasks, "low double, high double, count int").repartition(len(tasks), "low")
    found = sorted(work.mapInArrow(solve, "value double, axis binary").collect(), key=lambda r: -r.value)
    # One more Rayleigh-Ritz step over all slices makes their components orthogonal to rounding.
    basis, _ = np.linalg.qr(np.array([np.frombuffer(bytes(r.axis)) for r in found]).T)
    values, turn = np.linalg.eigh(basis.T @ covariance @ basis)
    return values[::-1][:wanted], (basis @ turn)[:, ::-1][:, :wanted]
