"""Embedding whitening from exact integer scatter.

Vectors become whole numbers x = floor(scale * c) + offset. Over the list of distinct x, each once, tasks subtract a
shift (any vector of whole numbers: it cancels) and add up sums and cross-products in limbs that doubles hold exactly; Spark adds up the limbs of
all tasks by slot, and the driver puts dim * (dim + 3) / 2 + 1 integers of any size together, whatever the number of vectors.
n * sum(y y') - sum(y) sum(y)' is then exact, and only its quotient by n^2, the covariance, becomes doubles and is decomposed by eigh.
Nothing depends on partitions, order or the size of what all vectors have in common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import integers, kernel
from threadlake.session import ship, stored

#: Bits of a limb inside tasks, and rows whose products doubles add up exactly: 2 * 20 + 12 < 53.
LIMB, TOGETHER = 20, 1 << 12
#: Bits of the limbs that Spark adds up as longs.
SENT = 32
#: eigh alone serves down to this share of the largest eigenvalue; shares under LEAST are zero.
CLEAR, LEAST = 1e-6, 1e-25
#: Bits after the point of refined vectors, and rounds of refinement at most.
POINT, ROUNDS = 200, 12
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


@dataclass
class Whitener:
    """n distinct vectors x with sums; covariance and its largest eigenvalues with their unit vectors as columns, by falling eigenvalue."""

    scale: int
    offset: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        total = float(np.trace(self.covariance))
        return [float(e) / total for e in self.values]


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it, after a byte for their size: equal rows, equal bytes."""
    out = [b""] * len(x)
    kind = np.zeros(len(x), np.int64)
    low, high = (x.min(axis=1), x.max(axis=1)) if x.shape[1] else (kind, kind)
    for k, t in enumerate(WIDTHS[:-1]):
        kind[(low < np.iinfo(t).min) | (high > np.iinfo(t).max)] = k + 1
    for k, t in enumerate(WIDTHS):
        rows = np.flatnonzero(kind == k)
        for i, row in zip(rows.tolist(), x[rows].astype(t), strict=True):
            out[i] = bytes([k]) + row.tobytes()
    return out


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    x = np.zeros((len(column), dim), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        x[i] = np.frombuffer(raw, WIDTHS[raw[0]], offset=1)
    return x


def less(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x minus the shift; in Python's integers where int64 might not hold it."""
    if integers.fits(2 * max(int(np.abs(x).max(initial=0)), *map(abs, shift), 0)):
        return x - np.array(shift, np.int64)
    return x.astype(object) - np.array(shift, object)


def products(y: np.ndarray) -> np.ndarray:
    """y'y exactly, as Python's integers."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    for lo in range(0, len(y), TOGETHER):
        rest, limbs = y[lo : lo + TOGETHER], []
        while len(limbs) == 0 or (rest != 0).any():
            # the last limb carries the sign
            last = bool((np.abs(rest) < 1 << LIMB).all())
            limbs.append((rest if last else rest & (1 << LIMB) - 1).astype(np.float64))
            rest = rest * 0 if last else rest >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs[: i + 1]):
                both = (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
                out += both if i == j else both + both.T
    return out


def _added(rows: DataFrame, totals, slots: int) -> list[int]:
    """Exact sums over all tasks: totals maps batches to slots Python integers, which travel as limbs and are added up by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, limb, part = [], [], []
        for k, value in enumerate(totals(batches)):
            size, sign = abs(value), -1 if value < 0 else 1
            for at in range(-(-size.bit_length() // SENT)):
                slot.append(k)
                limb.append(at)
                part.append(sign * (size >> SENT * at & (1 << SENT) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(limb, pa.int32()), pa.array(part, pa.int64())], ["slot", "limb", "part"])

    out = [0] * slots
    for r in rows.mapInArrow(kernel.lean(run), "slot int, limb int, part long").groupBy("slot", "limb").agg(F.sum("part").alias("part")).collect():
        out[r["slot"]] += r["part"] << SENT * r["limb"]
    return out


def scatter(distinct: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S of x, and n * X'X - SS', all exact, of a table of packed vectors."""
    first = distinct.head()
    if first is None:
        return 0, [0] * dim, [[0] * dim for _ in range(dim)]
    shift = unpack(pa.array([bytes(first[0])]), dim)[0].tolist()
    upper = np.triu_indices(dim)

    def totals(batches: Iterator[pa.RecordBatch]) -> list[int]:
        n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            y = less(unpack(batch.column(0), dim), shift)
            n += len(y)
            sums += y.astype(object).sum(axis=0) if len(y) else 0
            cross += products(y)
        return [n, *sums.tolist(), *cross[upper].tolist()]

    n, *rest = _added(distinct, totals, 1 + dim + len(upper[0]))
    s, cross = rest[:dim], rest[dim:]
    out = [[0] * dim for _ in range(dim)]
    for i, j, c in zip(*(x.tolist() for x in upper), cross, strict=True):
        out[i][j] = out[j][i] = n * c - s[i] * s[j]
    return n, [a + n * b for a, b in zip(s, shift, strict=True)], out


def _fixed(x: np.ndarray) -> np.ndarray:
    """Doubles as whole multiples of 2^-POINT."""
    return np.array([int(math.ldexp(a, POINT)) for a in x.ravel().tolist()], object).reshape(x.shape)


def _over(x: np.ndarray, by: int) -> np.ndarray:
    return np.array([a / by for a in x.ravel()], float).reshape(x.shape)


def eigen(exact: list[list[int]], n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of exact / n^2, falling, and their unit vectors as columns: at most so many, none that is zero.

    eigh errs by rounding of the largest eigenvalue. Where wanted ones are far smaller, as with a few very long vectors, its vectors are
    refined on the integers: in their basis the matrix is nearly diagonal, vectors that are told apart get a first-order correction and others are decomposed among
    themselves, until nothing changes in doubles.
    """
    d = len(exact)
    if not d or not n or not any(map(any, exact)):
        return np.zeros(0), np.zeros((d, 0))
    values, x = np.linalg.eigh(np.array([[a / (n * n) for a in row] for row in exact]))
    k = min(most, d)
    if values[-k] < CLEAR * values[-1]:
        whole, m, unit = _fixed(x), np.array(exact, object).reshape(d, d), 1 << 2 * POINT
        for _ in range(ROUNDS):
            s = _over(whole.T.dot(m).dot(whole), n * n * unit)
            r = _over(np.diag([unit] * d).astype(object) - whole.T.dot(whole), unit)
            values = np.diag(s) / (1 - np.diag(r))
            gap = values[None, :] - values[:, None]
            off = s + values[None, :] * r
            np.fill_diagonal(off, 0)
            near = np.abs(off) > np.abs(gap) / 16
            near |= near.T
            apart = ~near & (gap != 0)
            change = np.where(apart, off / np.where(apart, gap, 1), r / 2)
            whole = whole + (whole.dot(_fixed(change)) >> POINT)
            if near.any():
                groups, left = [], set(range(d))
                while left:
                    group, new = set(), {min(left)}
                    while new:
                        group |= new
                        new = {int(j) for i in new for j in np.flatnonzero(near[i])} - group
                    left -= group
                    groups.append(sorted(group))
                for g in groups:
                    if len(g) > 1:
                        whole[:, g] = whole[:, g].dot(_fixed(np.linalg.eigh(s[np.ix_(g, g)])[1])) >> POINT
            elif np.abs(change).max() < np.finfo(float).eps / 16:
                break
        x = _over(whole, 1 << POINT)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > LEAST * values.max()]
    return values[order], np.ascontiguousarray(x[:, order])


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    if integers.fits(2 * n * max(int(np.abs(x).max(initial=0)), -(-max(map(abs, sums), default=0) // max(n, 1)) + 1)):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _white(apart: np.ndarray, model: Whitener) -> np.ndarray:
    return (apart / model.n).astype(np.float64) @ model.components / np.sqrt(model.values)


def _mean_products(distinct: DataFrame, model: Whitener) -> np.ndarray:
    """Covariance of the whitened fit list, divisor n, centred before multiplying: sums over tasks of doubles."""
    dim, k = len(model.sums), len(model.values)

    def added(centre: np.ndarray | None, slots: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(slots)
            for batch in batches:
                z = _white(_apart(unpack(batch.column(0), dim), model.n, model.sums), model)
                total += z.sum(axis=0) if centre is None else ((z - centre).T @ (z - centre)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array(total)], ["slot", "part"])

        out = np.zeros(slots)
        for r in distinct.mapInArrow(kernel.lean(run), "slot int, part double").groupBy("slot").agg(F.sum("part").alias("part")).collect():
            out[r["slot"]] = r["part"] / model.n
        return out

    return added(added(None, k), k * k).reshape(k, k)


def _whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return integers.whole(integers.matrix(column, dim), scale)


def _rounded(vectors: DataFrame, dim: int, v: str) -> DataFrame:
    return integers.usable(vectors, v).where(F.size(v) == dim)


def fit(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, v: str = "embedding") -> Whitener:
    """The transform of vectors(v, ...), from each distinct rounded vector once.

    Null vectors and those with nulls or values that are not finite are left out, so are those of another length than the
    commonest. There are at most as many components as asked and as the covariance has eigenvalues that are not zero
    (LEAST of the largest): equal or single vectors, or none, give no component.
    """
    ship(vectors.sparkSession)
    dim = integers.commonest_length(integers.usable(vectors, v), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(_whole(batch.column(0), dim, scale)), pa.binary())], ["x"])

    # copies meet in the tasks first, so a vector that a third of all rows have is sent once a task
    distinct = stored(_rounded(vectors, dim, v).select(F.col(v).cast("array<double>").alias("x")).mapInArrow(kernel.lean(run), "x binary").distinct(), "distinct")
    n, sums, exact = scatter(distinct, dim)
    covariance = np.array([[a / (n * n) for a in row] for row in exact]).reshape(dim, dim) if n else np.zeros((dim, dim))
    values, vectors_ = eigen(exact, n, components)
    k = len(values)
    # the offset is the same for all: it is in the sums, not in the differences
    model = Whitener(scale, offset, n, [s + n * offset for s in sums], covariance, values, vectors_)
    if k:
        plain = Whitener(scale, 0, n, sums, covariance, model.values, model.components)
        model.identity_error = float(np.abs(_mean_products(distinct, plain) - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, model: Whitener, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """key, deviation (sum over dimensions of (n * x - S)^2, exact), whitened (array of as many doubles as components).

    One row for each vector that fit would take, other rows are left out, other columns ignored; repeated and null keys stay as they are.
    deviation is a decimal of 38 digits, null beyond. A model without components gives empty arrays.
    """
    ship(vectors.sparkSession)
    dim, k, n = len(model.sums), len(model.values), model.n
    sums = [s - n * model.offset for s in model.sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(_whole(batch.column(1), dim, model.scale), n, sums)
            if apart.dtype != object and not integers.fits(dim * int(np.abs(apart).max(initial=0)) ** 2):
                exact = apart.astype(object)
            else:
                exact = apart
            far = [int(x) if x < 10**38 else None for x in (exact * exact).sum(axis=1)]
            z = _white(apart, model) if n else np.zeros((len(apart), k))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(apart) + 1, dtype=np.int32) * k), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), lists], [key, "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    return _rounded(vectors, dim, v).select(key, F.col(v).cast("array<double>").alias("x")).mapInArrow(kernel.lean(run), f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")
