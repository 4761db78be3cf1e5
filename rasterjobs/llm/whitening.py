"""Embedding whitening: a covariance in exact integers, its leading eigenvectors by FEAST contour integration.

Sums and centred products of all vectors are integers, added per task and then in a fixed number of buckets, so they
don't depend on the order of tasks. The covariance has d x d entries whatever the number of rows; FEAST works on it:
inertia counts (signs of the pivots of L D L' of the shifted, tridiagonal covariance) cut the wanted part of the spectrum
into intervals at its gaps, quadrature of solves with complex shifts on a circle around each interval filters a block
of vectors, Rayleigh-Ritz extracts components from it, and an interval ends when as many converged components lie in it as its
inertia counts say.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterjobs.runtime import ship

#: x = floor(SCALE * c) + SHIFT; components returned at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Products are added in this many buckets before the driver adds those; rows of one product.
BUCKETS, ROWS = 16, 1024
#: |SCALE * c| must be less, or the vector takes no part.
WIDEST = 1 << 40
#: Quadrature points of half a circle, eigenvalues wanted per interval, rounds at most.
POINTS, PER_INTERVAL, ROUNDS = 8, 8, 60


# --- FEAST on a symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``v`` (Householder)."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        u = x.copy()
        u[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        size = float(np.linalg.norm(u))
        if size == 0:
            continue
        u /= size
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, at: float) -> int:
    """How many eigenvalues lie below ``at``: negative pivots of L D L' of the matrix less ``at``."""
    below, pivot = 0, 1.0
    tiny = np.finfo(float).tiny * 1e20
    squares = [0.0, *(off * off).tolist()]
    for d, s in zip(diagonal.tolist(), squares, strict=True):
        pivot = d - at - s / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        below += pivot < 0
    return below


def cuts(diagonal: np.ndarray, off: np.ndarray, wanted: int, scale: float) -> list[tuple[float, float, int]]:
    """Intervals (from, to, eigenvalues inside), cut in gaps, that together hold at least the ``wanted`` greatest eigenvalues."""
    n, edge = len(diagonal), 1.01 * scale + 1e-300
    places: list[float] = []  # eigenvalues from the greatest, to a thousandth of the gaps that matter

    def place(k: int) -> float:  # of the k-th greatest
        lo, hi = -edge, places[-1] + 2e-8 * scale if places else edge
        while hi - lo > 1e-8 * scale:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if n - inertia(diagonal, off, mid) >= k else (lo, mid)
        return (lo + hi) / 2

    while len(places) < min(n, wanted + PER_INTERVAL):
        places.append(place(len(places) + 1))
    below = places[1:] + ([-edge] if len(places) == n else [])
    gaps = [p - q for p, q in zip(places, below, strict=False)]  # gap k follows eigenvalue k
    out, first, top = [], 0, places[0] + max(places[0] - places[min(n, PER_INTERVAL) - 1], 1e-3 * scale)
    while first < wanted:
        options = [k for k in range(first, len(gaps)) if gaps[k] > 1e-6 * scale]
        near = [k for k in options if first + PER_INTERVAL // 2 <= k + 1 <= first + PER_INTERVAL + PER_INTERVAL // 2]
        if near:
            last = max(near, key=lambda k: gaps[k])
        elif options:
            last = options[0] if options[0] >= first + PER_INTERVAL else options[-1]
        else:  # no gap before the end: one interval down to below all eigenvalues
            last = None
        bottom = -edge if last is None else places[last] - gaps[last] / 2
        inside = inertia(diagonal, off, top) - inertia(diagonal, off, bottom)
        out.append((bottom, top, inside))
        if last is None:
            break
        first, top = last + 1, bottom
    return out


def interval(v: np.ndarray, low: float, high: float, inside: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of symmetric ``v`` between ``low`` and ``high``, which hold ``inside`` of them."""
    n, size = len(v), float(np.abs(v).sum(axis=1).max())
    block = min(n, inside + max(4, inside // 2))
    q = np.random.default_rng(seed).standard_normal((n, block))
    x, w = np.polynomial.legendre.leggauss(POINTS)
    angles, middle, radius = np.pi / 2 * (1 - x), (low + high) / 2, (high - low) / 2
    shifts = middle + radius * np.exp(1j * angles)
    for _ in range(ROUNDS):
        filtered = np.zeros((n, q.shape[1]))
        for z, angle, weight in zip(shifts, angles, w, strict=True):
            filtered += weight / 2 * radius * (np.exp(1j * angle) * np.linalg.solve(z * np.eye(n) - v, q)).real
        basis = np.linalg.qr(filtered)[0]
        values, small = np.linalg.eigh(basis.T @ v @ basis)
        q = basis @ small
        own = np.flatnonzero((values > low) & (values < high))[::-1]
        wrong = np.linalg.norm(v @ q[:, own] - q[:, own] * values[own], axis=0)
        if len(own) == inside and wrong.max(initial=0) <= 4 * n * np.finfo(float).eps * size:
            return values[own], q[:, own]
        if len(own) >= inside and block < n:  # strangers pretend to lie inside
            block = min(n, block + inside)
            q = np.concatenate([q, np.random.default_rng(seed + block).standard_normal((n, block - q.shape[1]))], axis=1)
    raise ArithmeticError(f"{inside} eigenvalues between {low} and {high}, but {len(own)} found")


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of a covariance, falling, and unit eigenvectors as columns; numerically zero ones are left out."""
    n = len(v)
    scale = float(np.abs(v).sum(axis=1).max(initial=0))
    if not n or scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    unit = v / scale
    values, vectors = [], []
    for k, (low, high, inside) in enumerate(cuts(*tridiagonal(unit), min(wanted, n), 1.0)):
        if inside:
            e, q = interval(unit, low, high, inside, k)
            values.append(e)
            vectors.append(q)
    e, q = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-e, kind="stable")[:wanted]
    order = order[e[order] > n * np.finfo(float).eps * 8]
    return e[order] * scale, q[:, order]


# --- sums over all rows


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors scaled and floored) of vectors with ``width`` finite entries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    if not len(rows) or not width:
        return rows[:0], np.zeros((0, width), np.int64)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * SCALE)
        good = (np.abs(x) < WIDEST).all(axis=1)
    return rows[good], x[good].astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, place, n, total) of a task's vectors, for every width that it meets."""
    found: dict[int, list] = {}
    for batch in batches:
        column = batch.column("x")
        for width in pc.unique(pc.list_value_length(column)).to_pylist():
            if width:
                y = _matrix(column, width)[1]
                n, total = found.get(width, (0, np.zeros(width, np.int64)))
                found[width] = (n + len(y), total + y.sum(axis=0))
    for width, (n, total) in found.items():
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(total)], ["width", "place", "n", "total"])


def _exact_products(y: np.ndarray) -> np.ndarray:
    """``y' y`` in integers; as doubles where those hold every sum."""
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2**53:
        x = y.astype(np.float64)
        return (x.T @ x).astype(np.int64)
    x = y.astype(object)
    return x.T @ x


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sum of products of centred vectors: two 64-bit integers an entry, high * 2^32 + low."""
    width = len(centre)
    high, low = np.zeros((width, width), np.int64), np.zeros((width, width), np.int64)
    for batch in batches:
        y = _matrix(batch.column("x"), width)[1] - centre
        for i in range(0, len(y), ROWS):
            p = _exact_products(y[i : i + ROWS])
            high += (p >> 32).astype(np.int64)
            low += (p & 0xFFFFFFFF).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([np.stack([high, low]).tobytes()], pa.binary())], ["blob"])


def _moments(batches: Iterator[pa.RecordBatch], whiten: Callable) -> Iterator[pa.RecordBatch]:
    """A task's (n, mean, centred products) of whitened vectors."""
    found = None
    for batch in batches:
        z = whiten(batch.column("x"))[2]
        for i in range(0, len(z), ROWS):
            part = z[i : i + ROWS]
            middle = part.mean(axis=0)
            part = part - middle
            found = _merge(found, (len(part), middle, part.T @ part))
    if found is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[found[0]], found[1], found[2].ravel()]).astype(np.float64).tobytes()], pa.binary())], ["blob"])


def _merge(a, b):
    """Moments of two sets of rows together."""
    if a is None:
        return b
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)


def _read_moments(blob: bytes):
    x = np.frombuffer(blob, np.float64)
    k = int((math.isqrt(1 + 4 * (len(x) - 1)) - 1) // 2)
    return x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k)


def _in_buckets(blobs: DataFrame, add: Callable[[list[bytes]], bytes]) -> list[bytes]:
    """The blobs of all tasks, added in BUCKETS groups by number of the task."""

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        return pa.table({"bucket": [table.column("bucket")[0].as_py()], "blob": [add(table.column("blob").to_pylist())]}, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    placed = blobs.withColumn("task", F.spark_partition_id()).withColumn("bucket", F.pmod("task", F.lit(BUCKETS)).cast("int"))
    return [r.blob for r in placed.groupBy("bucket").applyInArrow(together, "bucket int, blob binary").orderBy("bucket").collect()]


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component, most variance first.

    ``deviation`` is a decimal, exact at any size. Vectors that are null, or hold a null or non-finite entry, or one of 2^40 or more
    when scaled, take no part; nor do vectors of any other length than the most frequent one (the greater in
    ties). Rows with a null id stay, as do all rows that repeat an id. Components without variance (fewer rows
    than components, constant or dependent dimensions) have no rows, so a single row or equal rows give an empty table,
    as does an empty one. Where eigenvalues are equal, any orthonormal vectors of their space are components. Other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    by_place = rows.select("x").mapInArrow(_sums, "width int, place int, n long, total long").groupBy("width", "place")
    sums = by_place.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    most = sums.where("place = 0").orderBy(F.desc("n"), F.desc("width")).select("width").first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], kinds)
    found = sums.where(F.col("width") == most.width).orderBy("place").collect()
    n, totals = int(found[0].n), [int(r.total) for r in found]
    centre = np.array([(2 * t + n) // (2 * n) for t in totals], np.int64)  # the integer next to the mean
    left = [t - n * int(c) for t, c in zip(totals, centre, strict=True)]

    def add_products(blobs: list[bytes]) -> bytes:
        return reduce(np.add, (np.frombuffer(b, np.int64) for b in blobs)).tobytes()

    high, low = np.frombuffer(add_products(_in_buckets(rows.select("x").mapInArrow(lambda it: _products(it, centre), "blob binary"), add_products)), np.int64).reshape(2, len(centre), -1)
    exact = (high.astype(object) << 32) + low.astype(object)
    rest = np.array(left, dtype=object)
    covariance = ((n * exact - np.outer(rest, rest)) / (n * n)).astype(np.float64)  # the products' centre is off by rest / n
    e, q = leading(covariance, components)
    if not len(e):
        return vectors.sparkSession.createDataFrame([], kinds)
    trace = float(np.trace(covariance))
    project, base = q / np.sqrt(e), np.array(totals, np.int64)

    def whiten(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, y = _matrix(column, len(centre))
        away = n * y - base  # n * x - S, as SHIFT cancels
        return at, away, (away / n) @ project

    def add_moments(blobs: list[bytes]) -> bytes:
        m = reduce(_merge, map(_read_moments, blobs))
        return np.concatenate([[m[0]], m[1], m[2].ravel()]).tobytes()

    moments = _read_moments(add_moments(_in_buckets(rows.select("x").mapInArrow(lambda it: _moments(it, whiten), "blob binary"), add_moments)))
    error = float(np.abs(moments[2] / moments[0] - np.eye(len(e))).max())

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                at, away, z = whiten(part.column("x"))
                if float(np.abs(away).max(initial=0)) ** 2 * len(centre) < 2**62:
                    square = (away * away).sum(axis=1).tolist()
                else:
                    wide = away.astype(object)
                    square = (wide * wide).sum(axis=1).tolist()
                lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, len(e), dtype=np.int32), z.ravel())
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(at)), pa.array([Decimal(s) for s in square], pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "z"])

    made = rows.mapInArrow(give, "vec_id long, deviation decimal(38,0), z array<double>").select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    explained = F.element_at(F.lit([float(v / trace) for v in e]), F.col("component"))
    out = made.withColumn("component", F.col("k") + 1).select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
    return out


def whitening(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """:func:`whitened` with ``deviation`` as a long, null beyond its range."""
    return whitened(vectors, components).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
