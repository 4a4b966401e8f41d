"""Whitening of vectors by their leading principal components.

Every entry c becomes the whole number floor(256 * c). The fit list holds each distinct vector of such numbers once; its
sums give the mean, and a second pass adds up products of centred vectors, one matrix a task, met in a tree. The
covariance is made tridiagonal by Householder reflections; bisection on Sturm counts finds its leading eigenvalues, and
inverse iteration their vectors, each made orthogonal to the earlier ones of its cluster. The projection, dimensions by
components, is sent to all tasks; its size depends on the dimension of the vectors alone.

Rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors whose length is not the
commonest one (of equally common ones the longest), among them empty ones. Null and repeated vec_ids keep their rows.
Components without variance (below the rounding of the trace) are left out, so a table with one distinct vector gives
no rows, as does an empty table. A deviation that no long can hold is null; whitened values need none. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import count_all, cut
from netloom.llm.common import map_arrow

SCALE, COMPONENTS, FAN = 256, 4, 16
LIMIT = float(1 << 52)  # larger entries are no exact whole numbers of doubles


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (bytes of int64) of the vectors that are kept."""
    c = F.col("embedding").cast("array<double>")
    good = F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), c.alias("c")).where(good)
    lengths = rows.groupBy(F.size("c").alias("n")).agg(count_all().alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    rows = rows.where(F.size("c") == (lengths[0].n if lengths else -1))

    def run(batches):
        for b in batches:
            lists = b.column("c")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.floor(SCALE * flat)
            if len(x) and np.abs(x).max() > LIMIT:
                raise ValueError("an entry is too large for whole numbers")
            x = x.astype(np.int64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "x"])

    return map_arrow(rows, run, "vec_id bigint, x binary")


def matrix_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def summed(rows: DataFrame, work, shape: tuple[int, ...], kind=np.float64) -> np.ndarray:
    """Sum of the arrays work(matrix) over all batches of x: one a task, then in a tree of FAN, so that the driver gets
    FAN arrays at most."""
    def first(batches):
        total = np.zeros(shape, kind)
        for b in batches:
            if b.num_rows:
                total += work(matrix_of(b.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def again(batches):
        total = np.zeros(shape, kind)
        for b in batches:
            for p in b.column("part"):
                total += np.frombuffer(p.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = map_arrow(rows.select("x"), first, "part binary")
    n = rows.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(again, "part binary")
    return sum((np.frombuffer(r.part, kind).reshape(shape) for r in parts.collect()), np.zeros(shape, kind))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections v (x - 2 v v.x) that take symmetric `a` there."""
    a, d = a.copy(), len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        size = np.copysign(np.linalg.norm(x), x[0])
        v = x.copy()
        v[0] += size
        length = np.linalg.norm(v)
        v = v / length if length else v
        reflections.append(v)
        s = a[k + 1:, k + 1:]
        p = s @ v
        w = p - (v @ p) * v
        s -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -size
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each x: the negative pivots of T - x."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    q, count = diagonal[0] - x, np.zeros(len(x), np.int64)
    count += q < 0
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - x - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    d = len(diagonal)
    radius = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    edge = np.abs(diagonal).max() + radius.max()
    low, high = np.full(k, -edge - 1e-300), np.full(k, edge + 1e-300)
    rank = d - 1 - np.arange(k)  # eigenvalues below the wanted one, at most
    for _ in range(200):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        over = below(diagonal, off, mid) > rank
        high, low = np.where(over, mid, high), np.where(over, low, mid)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges; pivots below `least` are raised to it."""
    d = len(diagonal)
    main, up, up2, y = diagonal - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    for i in range(d - 1):
        low = off[i]
        if abs(low) > abs(main[i]):
            row = low, main[i + 1], up[i + 1]
            ratio = main[i] / row[0]
            main[i + 1], up[i + 1] = up[i] - ratio * row[1], -ratio * row[2]
            main[i], up[i], up2[i] = row
            y[i], y[i + 1] = y[i + 1], y[i] - ratio * y[i + 1]
        else:
            pivot = main[i] if abs(main[i]) > least else least
            main[i] = pivot
            ratio = low / pivot
            main[i + 1] -= ratio * up[i]
            y[i + 1] -= ratio * y[i]
    for i in range(d - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > least else least
        y[i] = (y[i] - (up[i] * y[i + 1] if i + 1 < d else 0) - (up2[i] * y[i + 2] if i + 2 < d else 0)) / pivot
    return y


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of T as columns by inverse iteration; those of a cluster are kept orthogonal."""
    d, norm = len(diagonal), max(np.abs(diagonal).max() + 2 * np.abs(np.append(off, 0)).max(), 1e-100)
    out, cluster = np.zeros((d, len(values))), 0
    rng = np.random.default_rng(1)
    for j, e in enumerate(values):
        if j and values[j - 1] - e > 1e-3 * norm:
            cluster = j
        shift = e - (j - cluster) * 4 * np.finfo(float).eps * norm  # equal values get shifts of their own
        y = rng.standard_normal(d)
        for _ in range(6):
            y /= np.abs(y).max()
            y = solved(diagonal, off, shift, y, np.finfo(float).eps * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[:, cluster:j] @ (out[:, cluster:j].T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def principal(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    k = min(k, len(v))
    diagonal, off, reflections = tridiagonal(v)
    values = leading(diagonal, off, k)
    out = vectors_of(diagonal, off, values)
    for at in range(len(reflections) - 1, -1, -1):
        r = reflections[at]
        out[at + 1:] -= 2 * np.outer(r, r @ out[at + 1:])
    return values, out / np.linalg.norm(out, axis=0)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond a long."""
    d, most = x.shape[1], int(np.abs(x).max(initial=0))
    if (most * n + int(np.abs(sums).max(initial=0))) ** 2 * d < 1 << 63:
        y = n * x - sums
        return (y * y).sum(1).tolist()
    s = [int(v) for v in sums]
    found = (sum((n * int(v) - m) ** 2 for v, m in zip(row, s)) for row in x)
    return [v if v < 1 << 63 else None for v in found]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row and leading component."""
    rows = cut(whole_numbers(vectors), "whole")
    fit = cut(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    one = fit.limit(1).collect()
    n = fit.count()
    if not one:
        return vectors.sparkSession.createDataFrame([], schema)
    d = len(one[0].x) // 8
    sums = summed(fit, lambda x: x.sum(0), (d,), np.int64)
    mean = sums / n

    def products(x):
        y = x - mean
        return y.T @ y

    v = summed(fit, products, (d, d)) / n
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    values, parts = principal(v, components)
    real = values > d * np.finfo(float).eps * trace
    values, parts = values[real], parts[:, real]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    projection, explained, k = parts / np.sqrt(values), values / trace, len(values)

    def moments(x):
        w = (x - mean) @ projection
        return np.vstack([w.sum(0), w.T @ w])

    seen = summed(fit, moments, (k + 1, k)) / n
    error = float(np.abs(seen[1:] - np.outer(seen[0], seen[0]) - np.eye(k)).max())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column("x"))
            w = (x - mean) @ projection
            rows_, many = np.repeat(np.arange(len(x)), k), len(x) * k
            dev = deviations(x, n, sums)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(rows_)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, n)),
                 pa.array([v for v in dev for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, schema)
