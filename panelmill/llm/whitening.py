"""Whitening of embeddings with eigenvectors refined from float32 to double precision.

Entries become whole numbers floor(64 * c), so the fit does not depend on row order: the distinct
vectors are counted and summed exactly, and the covariance is taken around the whole number next to
each mean. All passes over vectors are Spark jobs; each task sends one partial sum for each
dimension, and partial sums are added in two levels. Only sums of the size of the covariance
(``MAX_DIM`` squared at most) reach the driver.

The eigenvectors start as those of the float32 covariance. Each step of Ogita and Aishima's
refinement corrects them by matrix products alone, X + X E, where E follows from I - X'X and X'VX.
These two are taken in higher precision: factors are split into slices so short that products of
slices are exact in doubles, and slices are summed with their rounding errors. Eigenvalues
nearer to each other than the step can tell are a cluster; its vectors are turned by the
eigenvectors of the cluster's own small matrix, shifted by its mean eigenvalue.

Edge cases: rows whose vector is null, empty or holds null, NaN or infinite entries are dropped; rows without a
vec_id stay; repeated rows each return their components, and count once in the fit. Vectors of
each length are a fit of their own. A component without variance (fewer distinct vectors than dimensions, or
constant dimensions) has a null ``whitened`` and takes no part in ``identity_error``, which is null if no
component has variance; ``explained`` is null if there is no variance at all. Equal eigenvalues leave the choice of
their vectors open; the one made depends on the fit list only. Entries beyond 2^40 / 64 and deviations
beyond 64 bits stop the job, since whole numbers could not hold the result. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship, stored

COMPONENTS, SCALE = 16, 64
#: Longest vector; the driver holds a few matrices of this size squared.
MAX_DIM = 4096
LARGEST = 1 << 40
#: Partial sums of tasks are added in this many groups first, then the groups' sums.
WAYS = 64
STEPS, SUB_SOLVES = 16, 3
ROWS = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)
PARTIAL = "dim int, i int, part int, sums binary"


class Fit(NamedTuple):
    """What whitening one vector length needs."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # one column a component
    values: np.ndarray
    explained: np.ndarray
    sound: np.ndarray  # components with variance


def packed(matrix: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, each with the smallest width that holds it (first byte)."""
    width = np.full(len(matrix), 8)
    low, high = matrix.min(axis=1), matrix.max(axis=1)
    for w in (4, 2, 1):
        half = 1 << (8 * w - 1)
        width[(low >= -half) & (high < half)] = w
    out: list[bytes] = [b""] * len(matrix)
    for w in set(width.tolist()):
        for at, row in zip(np.flatnonzero(width == w).tolist(), matrix[width == w].astype(f"<i{w}"), strict=True):
            out[at] = bytes([w]) + row.tobytes()
    return out


def unpacked(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length: the length, the places of its rows, and the rows as int64."""
    kinds: dict[tuple[int, int], list[int]] = {}
    for at, row in enumerate(rows):
        kinds.setdefault((len(row), row[0]), []).append(at)
    by_dim: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for (size, w), at in kinds.items():
        data = np.frombuffer(b"".join([rows[i][1:] for i in at]), f"<i{w}").astype(np.int64)
        by_dim.setdefault((size - 1) // w, []).append((np.array(at), data.reshape(len(at), -1)))
    for dim, found in by_dim.items():
        yield dim, np.concatenate([a for a, _ in found]), np.concatenate([m for _, m in found])


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain; ``x`` is the packed vector of floor(64 * c)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lists = batch.column(1)
        there = np.flatnonzero(np.asarray(lists.is_valid()))
        flat = lists.flatten()
        flat = np.where(np.asarray(flat.is_valid()), flat.to_numpy(zero_copy_only=False), np.nan)
        sizes = np.asarray(lists.value_lengths().drop_null()).astype(np.int64)
        ends = np.cumsum(sizes)
        wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
        rows, places = [], []
        for dim in np.unique(sizes[good]).tolist():
            if dim > MAX_DIM:
                raise ValueError(f"vectors of {dim} entries; {MAX_DIM} are supported")
            chosen = np.flatnonzero(good & (sizes == dim))
            x = np.floor(SCALE * flat[(ends[chosen] - dim)[:, None] + np.arange(dim)])
            if np.abs(x).max() > LARGEST:
                raise ValueError("a vector entry is too large for whole-number sums")
            rows += packed(x.astype(np.int64))
            places.append(there[chosen])
        if not rows:
            return None
        return pa.record_batch([batch.column(0).take(pa.array(np.concatenate(places))), pa.array(rows, pa.binary())], ["vec_id", "x"])

    source = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return map_batches(source, run, "vec_id bigint, x binary")


def _counts(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each vector length: how many distinct vectors, and their sum by dimension, exact."""

    def run(batches):
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for dim, _, m in unpacked(batch.column(0).to_pylist()):
                n[dim] = n.get(dim, 0) + len(m)
                sums[dim] = [a + b for a, b in zip(sums.get(dim, [0] * dim), m.sum(axis=0).tolist(), strict=True)]
        for dim in n:
            cells = (pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n[dim]] * dim, pa.int64()))
            yield pa.record_batch([*cells, pa.array([str(s) for s in sums[dim]])], ["dim", "i", "n", "s"])

    ship(fit_list.sparkSession)
    parts = fit_list.mapInArrow(run, "dim int, i int, n bigint, s string")
    both = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    dims = [r[0] for r in parts.select("dim").distinct().limit(MAX_DIM + 1).collect()]
    if sum(d * d for d in dims) > MAX_DIM * MAX_DIM:
        raise ValueError("vectors of too many lengths for one fit")
    found: dict[int, tuple[int, list[int]]] = {d: (0, [0] * d) for d in dims}
    for r in both.collect():
        found[r["dim"]][1][r["i"]] = int(r["s"])
        found[r["dim"]] = (r["n"], found[r["dim"]][1])
    return found


def _added(fit_list: DataFrame, matrix: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """For each vector length the sum of ``matrix(dim, rows)`` over all vectors.

    A task adds up its batches and sends its sum by rows; sums meet in ``WAYS`` groups, then once more.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, m in unpacked(batch.column(0).to_pylist()):
                part = matrix(dim, m)
                if part is not None:
                    sums[dim] = sums[dim] + part if dim in sums else part
        part = TaskContext.get().partitionId() % WAYS
        for dim, total in sums.items():
            yield pa.record_batch(
                [pa.array([dim] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array([part] * len(total), pa.int32()),
                 pa.array([row.astype("<f8").tobytes() for row in total], pa.binary())], ["dim", "i", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<f8") for b in table.column("sums").to_pylist())
        first = table.slice(0, 1)
        return first.set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    parts = fit_list.mapInArrow(run, PARTIAL)
    parts = parts.groupBy("dim", "i", "part").applyInArrow(add, PARTIAL).groupBy("dim", "i").applyInArrow(add, PARTIAL)
    rows: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.select("dim", "i", "sums").collect():
        rows.setdefault(r["dim"], {})[r["i"]] = np.frombuffer(r["sums"], "<f8")
    return {dim: np.stack([m[i] for i in sorted(m)]) for dim, m in rows.items()}


def _slices(a: np.ndarray, axis: int, count: int = 3) -> list[np.ndarray]:
    """``a`` as a sum of matrices with so few bits that products of two are exact; ``axis`` is summed over."""
    bits = int(np.ceil((53 + np.log2(a.shape[axis])) / 2))
    out, rest = [], a
    for _ in range(count - 1):
        top = np.abs(rest).max(axis=axis, keepdims=True)
        sigma = np.where(top > 0, np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + bits), 0.0)
        out.append((rest + sigma) - sigma)
        rest = rest - out[-1]
    return [*out, rest]


def product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a @ b`` as an unevaluated sum of two doubles."""
    left, right = _slices(a, 1), _slices(b, 0)
    terms = [p @ q for p in left for q in right]
    high, low = np.zeros_like(terms[0]), np.zeros_like(terms[0])
    for t in terms:
        total = high + t
        back = total - high
        low += (high - (total - back)) + (t - back)
        high = total
    return high, low


def refined(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the symmetric ``v`` in double precision."""
    size = float(np.abs(v).max())
    if size == 0:
        return np.zeros(len(v)), np.eye(len(v))
    a = v / 2.0 ** np.ceil(np.log2(size))
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start[:, ::-1].astype(np.float64)
    eye = np.eye(len(v))
    norm = float(np.linalg.norm(a))
    for step in range(STEPS):
        high, low = product(x.T, x)
        r = (eye - high) - low
        ax, ax_low = product(a, x)
        s, s_low = product(x.T, ax)
        s_low = s_low + x.T @ ax_low
        values = (s + s_low).diagonal() / (1 - r.diagonal())
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        r, s, s_low = (m[np.ix_(order, order)] for m in (r, s, s_low))
        away = float(np.linalg.norm((s + s_low) - np.diag((s + s_low).diagonal()))) + norm * float(np.linalg.norm(r))
        delta = 2 * max(away, 4 * np.finfo(float).eps * norm)  # nearer than doubles can tell: orthogonal is all they can be
        near = values[:-1] - values[1:] <= delta
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + values[None, :] * r + s_low) / np.where(apart, gap, 1.0), r / 2)
        np.fill_diagonal(e, r.diagonal() / 2)
        if step < SUB_SOLVES and near.any():
            x = x + x @ np.where(apart, e, r / 2)
            first = 0
            for last in [*np.flatnonzero(~near).tolist(), len(values) - 1]:
                if last > first:  # a cluster: turn its vectors by those of its own shifted matrix
                    j = slice(first, last + 1)
                    mean = float(values[j].mean())
                    own = (s[j, j] - mean * eye[j, j]) + (s_low[j, j] + mean * r[j, j])
                    _, turn = np.linalg.eigh((own + own.T) / 2)
                    x[:, j] = x[:, j] @ turn[:, ::-1]
                first = last + 1
            continue
        x = x + x @ e
        if np.abs(e).max() < 1e-15:
            break
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1.0, 1.0)
    return values * 2.0 ** np.ceil(np.log2(size)), x


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The components of each vector length; ``fit_list`` has each packed vector once, in ``x``."""
    counts = _counts(fit_list)
    near = {dim: [(2 * s + n) // (2 * n) for s in sums] for dim, (n, sums) in counts.items()}

    def gram(dim: int, m: np.ndarray) -> np.ndarray:
        y = (m - np.array(near[dim], dtype=np.int64)).astype(np.float64)
        return y.T @ y

    out = {}
    for dim, total in _added(fit_list, gram).items():
        n, sums = counts[dim]
        rest = np.array([(s - n * c) / n for s, c in zip(sums, near[dim], strict=True)])
        v = total / n - np.outer(rest, rest)
        values, vectors = refined((v + v.T) / 2)
        trace, k = float(np.trace(v)), min(components, dim)
        sound = values[:k] > max(values[0], 0.0) * dim * np.finfo(float).eps
        explained = np.maximum(values[:k], 0.0) / trace if trace > 0 else np.full(k, np.nan)
        out[dim] = Fit(n, sums, vectors[:, :k], values[:k], explained, sound)
    return out


def _centred(m: np.ndarray, model: Fit) -> tuple[np.ndarray, list[int]]:
    """(x - S/n as doubles, sum of (n * x - S)^2 as whole numbers) of each row."""
    sums = model.sums
    largest = max(int(np.abs(m).max()), 1) * model.n + max(abs(s) for s in sums)
    if largest < 1 << 62:
        away = m * model.n - np.array(sums, dtype=np.int64)
        if (int(np.abs(away).max()) ** 2) * m.shape[1] < 1 << 63:
            return away / model.n, (away * away).sum(axis=1).tolist()
    away = m.astype(object) * model.n - np.array(sums, dtype=object)
    return (away / model.n).astype(np.float64), (away * away).sum(axis=1).tolist()


def _projected(centred: np.ndarray, model: Fit) -> np.ndarray:
    return centred @ model.vectors / np.sqrt(np.where(model.sound, model.values, np.nan))


def identity_errors(fit_list: DataFrame, models: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened fit list - identity), by vector length."""

    def products(dim: int, m: np.ndarray) -> np.ndarray | None:
        model = models[dim]
        if not model.sound.any():
            return None
        z = _projected(_centred(m, model)[0], model)[:, model.sound]
        return np.vstack([z.T @ z, z.sum(axis=0)])

    out = {}
    for dim, total in _added(fit_list, products).items():
        mean = total[-1] / models[dim].n
        out[dim] = float(np.abs(total[:-1] / models[dim].n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row of ``vectors`` and component."""
    rows = quantised(vectors)
    fit_list = stored(rows.select("x").distinct(), "whitening")
    models = fit(fit_list, components)
    errors = identity_errors(fit_list, models)

    def run(batches):
        for batch in batches:
            for dim, at, m in unpacked(batch.column(1).to_pylist()):
                model, k = models[dim], len(models[dim].values)
                centred, deviation = _centred(m, model)
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation is beyond 64 bits")
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                z = _projected(centred, model).ravel()
                count = len(at) * k
                yield pa.record_batch(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array([model.n] * count, pa.int64()),
                     pa.array(np.repeat(np.array(deviation, dtype=np.int64), k)), pa.array(z, mask=np.isnan(z)),
                     pa.array(np.tile(model.explained, len(at)), from_pandas=True), pa.array([errors.get(dim)] * count, pa.float64())], names)

    names = [c.split()[0] for c in ROWS.split(", ")]
    return rows.mapInArrow(run, ROWS)
