"""Whitening of embeddings by a bidiagonal qd solver.

Components become integers, x = floor(scale * c) + shift; n vectors and their sums S make the
fit list. Each task reduces its centred rows x - S/n, a block at a time, to one triangle by
QR, and the triangles are merged in a tree, ``FAN`` at a time; the covariance itself is never formed,
which would square the condition number. The last triangle R, as wide as a vector, goes to the driver:

- Householder reflections from both sides make it bidiagonal;
- the differential qd algorithm with shifts (dqds) finds the singular values to high relative accuracy;
- a twisted factorisation of B'B less a squared singular value gives its direction: a top-down and
  a bottom-up factorisation meet at the place where the remaining pivot is smallest. Directions of
  values that lie close are made orthogonal to each other;
- the right reflections bring directions back. Squared singular values / n are the covariance's eigenvalues.

The driver sees sums, one triangle and moments, all of the size of a vector or its square.

Null vectors and those with null or non-finite entries take no part. Vectors of another length than the
commonest (ties: the longer) have no common covariance and take no part either. An x beyond +-2^52 is held there.
Components of no variance cannot be scaled to 1 and are left out, so fewer than ``components`` may come back
(none for a single vector or equal vectors). Repeated rows and null ids are rows like any other; other columns
take no part. ``deviation`` is exact; beyond 64 bits it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.session import materialize

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
BLOCK = 4096  # rows of a block, about
FAN = 16  # triangles merged at once
NO_VARIANCE = 1e-12  # a deviation below this share of the largest one is rounding
_MOST = float(1 << 52)
_EPS = np.finfo(float).eps
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- singular values and directions of one triangle


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B = U'RV, and V, by Householder reflections."""
    a = np.array(r, dtype=float)
    d = a.shape[0]
    right = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        v = x / size
        v[0] += 1.0 if v[0] >= 0 else -1.0
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One differential qd step; the least pivot is negative if the shift was above the least value."""
    qs, es = np.empty_like(q), np.empty_like(e)
    d = least = q[0] - shift
    for i in range(len(e)):
        qs[i] = d + e[i]
        t = q[i + 1] / qs[i] if qs[i] else 0.0
        es[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
        if not least >= 0 and shift > 0:
            return qs, es, -1.0
    qs[-1] = d
    return qs, es, least


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal matrix's singular values, falling, by dqds."""
    out: list[float] = []
    stack = [(diagonal.astype(float) ** 2, upper.astype(float) ** 2, 0.0)]
    while stack:
        q, e, total = stack.pop()
        steps = 0
        while len(q):
            if len(q) == 1:
                out.append(max(q[0], 0.0) + total)
                break
            if len(q) == 2:  # in closed form, the smaller one from the product
                mean = (q[0] + q[1] + e[0]) / 2
                large = mean + np.sqrt(max(mean * mean - q[0] * q[1], 0.0))
                out += [large + total, (q[0] * q[1] / large if large else 0.0) + total]
                break
            tiny = _EPS * _EPS * (q[:-1] + total)
            if e[-1] <= tiny[-1] or e[-1] <= _EPS * _EPS * (q[-1] + total):
                out.append(max(q[-1], 0.0) + total)
                q, e, steps = q[:-1], e[:-1], 0
                continue
            cut = np.flatnonzero(e <= tiny)
            if len(cut):
                k = int(cut[0]) + 1
                stack.append((q[k:].copy(), e[k:].copy(), total))
                q, e, steps = q[:k], e[: k - 1], 0
                continue
            if q[0] < q[-1] and steps == 0:  # work from the large end down to the small one
                q, e = _flipped(q, e)
            # the last pivots bound the least value from above; a part of that is a shift, taken back if it was too much
            shift = _shift(q, e) if steps else 0.0
            while True:
                qs, es, least = _dqds_step(q, e, shift)
                if least >= 0 or shift == 0:
                    break
                shift = shift / 4 if shift > 1e-3 * _EPS * q.max() else 0.0
            q, e, total, steps = qs, es, total + shift, steps + 1
            if steps > 200 * len(q):
                raise ArithmeticError("the qd iteration does not come to an end")
    return np.sort(np.array(out))[::-1]


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values from the other end: B transposed with its order turned around is upper bidiagonal again."""
    return q[::-1].copy(), e[::-1].copy()


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the least value by Gershgorin's circles on the last three rows, or a part of an upper one."""
    b = np.sqrt(np.maximum(q[-3:-1] * e[-2:], 0.0)) if len(q) >= 3 else np.sqrt(np.maximum(q[-2:-1] * e[-1:], 0.0))
    low = q[-1] - b[-1]
    if low > 0:
        return float(low * (1 - 4 * _EPS))
    return float(0.25 * min(q[-1], q[-2]))


def direction(diagonal: np.ndarray, upper: np.ndarray, value: float, among: int = 0) -> np.ndarray:
    """A unit vector z with B'Bz = value z, from the twisted factorisation at the place of the ``among``-th smallest pivot."""
    n = len(diagonal)
    tiny = np.finfo(float).tiny / _EPS
    a = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    d, off = a * a, a[:-1] * upper  # off: of B'B beside the diagonal, equal to d * l
    ratio = upper / a[:-1]
    s, low = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        low[i] = off[i] / pivot
        s[i + 1] = low[i] * ratio[i] * s[i] - value
    p, up = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = off[i] * ratio[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        up[i] = off[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    left = np.abs(s + p + value)
    k = int(np.argsort(left, kind="stable")[min(among, n - 1)])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _orthogonal(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray, norm: float) -> np.ndarray:
    """Directions of one unreduced block's falling values, in columns; those of close values orthogonal to each other."""
    n = len(diagonal)
    out = np.empty((n, len(values)))
    first = 0  # of the values that lie close to the present one
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * values[j - 1] + _EPS * norm:
            first = j
        for among in range(n):
            z = direction(diagonal, upper, value, among)
            before = out[:, first:j]
            for _ in range(2):
                z = z - before @ (before.T @ z)
            size = np.linalg.norm(z)
            if size > 0.1 or among == n - 1:
                break
        out[:, j] = z / size
    if n > 1 and len(values) > 1:  # values that agree to the last digits: diagonalise inside their span
        groups = np.split(np.arange(len(values)), np.flatnonzero(values[:-1] - values[1:] > 1e-8 * values[:-1]) + 1)
        b = np.diag(diagonal) + np.diag(upper, 1)
        for g in groups:
            if len(g) > 1:
                basis, _ = np.linalg.qr(out[:, g])
                image = b @ basis
                inner, turn = np.linalg.eigh(image.T @ image)
                out[:, g] = basis @ turn[:, np.argsort(-inner, kind="stable")]
    return out


def right_directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, falling, and the right directions of the first ``wanted``, in columns."""
    d = r.shape[0]
    size = float(np.abs(r).max(initial=0.0))
    if size == 0:
        return np.zeros(d), np.eye(d)[:, :wanted]
    diagonal, upper, right = bidiagonal(r / size)
    norm = float(np.abs(diagonal).max() + np.abs(upper).max(initial=0.0))
    upper[np.abs(upper) <= _EPS * norm * 1e-2] = 0.0
    limits = [0, *(np.flatnonzero(upper == 0) + 1).tolist(), d]
    parts = []  # (value, block, place in the block)
    blocks = []
    for k, (i, j) in enumerate(zip(limits[:-1], limits[1:])):
        blocks.append((i, j, squared_singular_values(diagonal[i:j], upper[i : j - 1])))
        parts += [(v, k, at) for at, v in enumerate(blocks[-1][2])]
    parts.sort(key=lambda x: (-x[0], x[1], x[2]))
    used: dict[int, int] = {}
    for _, k, at in parts[:wanted]:
        used[k] = max(used.get(k, 0), at + 1)
    own = {k: _orthogonal(diagonal[i:j], upper[i : j - 1], v[: used[k]], norm**2) for k, (i, j, v) in enumerate(blocks) if k in used}
    out = np.zeros((d, min(wanted, d)))
    for column, (_, k, at) in enumerate(parts[:wanted]):
        i, j, _ = blocks[k]
        out[i:j, column] = own[k][:, at]
    out = right @ out
    out, _ = np.linalg.qr(out) if np.abs(out.T @ out - np.eye(out.shape[1])).max() > 1e-13 else (out, None)
    return np.array([v for v, _, _ in parts]) * size**2, out


# --- passes over the vectors


def _whole(batch: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    """x of a batch's vectors, one row each, as 64-bit integers."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return (np.clip(np.floor(scale * flat), -_MOST, _MOST).astype(np.int64) + shift).reshape(batch.num_rows, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            yield batch.slice(low, BLOCK)


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low 26 bits, whose sums over any task stay exact in 64 bits."""
    return x >> 26, x & ((1 << 26) - 1)


def _totals(rows: DataFrame, dims: int, scale: int, shift: int) -> list[int]:
    """Exact sums of x by dimension."""

    def run(batches):
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in _blocks(batches):
            h, lo = _parts(_whole(batch, scale, shift))
            high, low = high + h.sum(axis=0), low + lo.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low)], ["k", "high", "low"])

    parts = rows.select("v").mapInArrow(run, "k int, high long, low long")
    out = [0] * dims
    for r in parts.groupBy("k").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect():
        out[r["k"]] = (int(r["high"]) << 26) + int(r["low"])
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: integers less the whole part of the mean, exactly, and then less its fraction."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def _triangle(stacked: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, square."""
    d = stacked.shape[1]
    r = np.linalg.qr(stacked, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _reduced(rows: DataFrame, n: int, sums: list[int], scale: int, shift: int) -> np.ndarray:
    """One triangle whose cross product is that of all centred rows."""
    dims = len(sums)

    def own(batches):
        r = None
        for batch in _blocks(batches):
            y = _centred(_whole(batch, scale, shift), n, sums)
            r = _triangle(y if r is None else np.vstack([r, y]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merged(key, table):
        table = table.sort_by("part")
        r = _triangle(np.vstack([np.frombuffer(x).reshape(dims, dims) for x in table.column("r").to_pylist()]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    triangles = materialize(rows.select("v").mapInArrow(own, "part long, r binary"))  # one per task
    parts = triangles.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        triangles = triangles.groupBy(F.floor(F.col("part") / FAN).alias("up")).applyInArrow(merged, "part long, r binary")
        parts = -(-parts // FAN)
    return np.frombuffer(triangles.first()["r"]).reshape(dims, dims)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~bad)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None or sizes["size"] == 0:
        return spark.createDataFrame([], _OUT)
    dims, n = sizes["size"], sizes["count"]
    rows = rows.where(F.size("v") == dims)
    sums = _totals(rows, dims, scale, shift)
    squares, directions = right_directions(_reduced(rows, n, sums, scale, shift), components)
    total = float(squares.sum())
    count = int((squares[: directions.shape[1]] > (NO_VARIANCE**2) * squares[0]).sum())  # squares fall
    if not count:
        return spark.createDataFrame([], _OUT)
    matrix = spark.sparkContext.broadcast(directions[:, :count] * np.sqrt(n / squares[:count]))  # dimensions x components

    def moments(batches):
        first, second = np.zeros(count), np.zeros((count, count))
        for batch in _blocks(batches):
            w = _centred(_whole(batch, scale, shift), n, sums) @ matrix.value
            first, second = first + w.sum(axis=0), second + w.T @ w
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["k", "value"])

    found = rows.select("v").mapInArrow(moments, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(count + count * count)
    for r in found:
        values[r["k"]] = r["value"] / n
    mean, second = values[:count], values[count:].reshape(count, count)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max())
    explained = (squares[:count] / total).tolist()

    def project(batches):
        for batch in _blocks(batches):
            x = _whole(batch, scale, shift)
            w = _centred(x, n, sums) @ matrix.value
            m = len(x)
            columns = [
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count), pa.int64(), from_pandas=True)
                if batch.column(0).null_count == 0
                else pa.array([i for i in batch.column(0).to_pylist() for _ in range(count)], pa.int64()),
                pa.array(np.tile(np.arange(1, count + 1), m), pa.int32()),
                pa.array(np.full(m * count, n), pa.int64()),
                pa.array([d for d in deviations(x, n, sums) for _ in range(count)], pa.int64()),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(project, _OUT)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exactly; None beyond 64 bits."""
    if not len(x):
        return []
    most = max(abs(n * int(v) - s) for column, s in zip((x.min(axis=0), x.max(axis=0)), (sums, sums)) for v, s in zip(column, s))
    if most * most * len(sums) < 1 << 63 and max(map(abs, sums)) < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        difference = n * x - np.array(sums, dtype=np.int64)
        return (difference * difference).sum(axis=1).tolist()
    about = (((x - np.array([s / n for s in sums])) * float(n)) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    for i in np.flatnonzero(about < 1.01 * 2.0**63).tolist():
        exact = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums))
        out[i] = exact if exact < 1 << 63 else None
    return out
