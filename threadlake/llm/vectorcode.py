"""Product quantisation: vectors as short codes, codebooks trained by exact integer k-means.

Vectors become whole numbers and are cut into equal consecutive parts; each part position has a codebook. In every round a
kd-tree for each codebook goes to all tasks (entries x width numbers, whatever the number of vectors), each part finds its
nearest entry by branch and bound, and sums by entry are added up by Spark as decimals, so that results depend neither on
partitions nor on order. A node is left only if its box is farther than the best so far: nodes at an equal
bound are visited, so of entries at equal distance the lowest index is always found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import integers, kernel
from threadlake.session import ship

#: Entries in a leaf of a kd-tree, and vectors that are searched together.
LEAF, TOGETHER = 64, 8192


@dataclass
class Codebooks:
    """Entries as int64 (k x width) for each part; scale and dim of the vectors that they stand for. width * parts >= dim."""

    scale: int
    dim: int
    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    members: np.ndarray
    axis: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """Halves along the axis of the widest spread, down to LEAF entries; members are indices, ascending in leaves."""
    members = np.arange(len(entries)) if members is None else members
    own = entries[members]
    node = Node(own.min(axis=0), own.max(axis=0), members)
    if len(members) <= LEAF or (node.high == node.low).all():
        return node
    node.axis = int((node.high - node.low).argmax())
    values = own[:, node.axis]
    order = np.argsort(values, kind="stable")
    node.cut = int(values[order[(len(order) - 1) // 2]])
    node.cut -= node.cut == node.high[node.axis]  # neither side is empty
    node.left, node.right = (kd_tree(entries, members[side]) for side in (values <= node.cut, values > node.cut))
    return node


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all entries, in the integers that x has."""
    if x.dtype != object:
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
        if 4 * most * most * max(x.shape[1], 1) < 1 << 53:  # doubles hold every sum on the way
            a, b = x.astype(np.float64), entries.astype(np.float64)
            return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), x.dtype)
    for k in range(x.shape[1]):
        apart = x[:, k, None] - entries[None, :, k]
        out = out + apart * apart
    return out


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equals, and its squared distance."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if not integers.fits(4 * most * most * max(x.shape[1], 1)):
        x, entries = x.astype(object), entries.astype(object)
    who = np.full(len(x), len(entries))
    best = np.full(len(x), np.iinfo(np.int64).max if x.dtype != object else 1 << 140, x.dtype)

    def visit(node: Node, rows: np.ndarray) -> None:
        own = x[rows]
        gap = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        near = (gap * gap).sum(axis=1) <= best[rows]
        rows = rows[near.astype(bool)]
        if not len(rows):
            return
        if node.left is None:
            d = distances(x[rows], entries[node.members])
            at = d.argmin(axis=1)
            d, index = d[np.arange(len(rows)), at], node.members[at]
            better = ((d < best[rows]) | ((d == best[rows]) & (index < who[rows]))).astype(bool)
            best[rows[better]], who[rows[better]] = d[better], index[better]
            return
        first = (x[rows, node.axis] <= node.cut).astype(bool)
        for side, of in ((node.left, first), (node.right, ~first), (node.right, first), (node.left, ~first)):
            if of.any():
                visit(side, rows[of])

    for lo in range(0, len(x), TOGETHER):
        visit(tree, np.arange(lo, min(lo + TOGETHER, len(x))))
    return who, best


def _parts(column: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """Rows x parts x width whole numbers; a length that parts do not divide is filled up with zeros."""
    x = integers.whole(integers.matrix(column, dim), scale)
    width = -(-dim // parts)
    wide = np.zeros((len(x), parts * width), np.int64)
    wide[:, :dim] = x
    return wide.reshape(len(x), parts, width)


def _rounded(vectors: DataFrame, dim: int, v: str) -> DataFrame:
    return integers.usable(vectors, v).where(F.size(v) == dim)


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", v: str = "embedding") -> Codebooks:
    """Codebooks of vectors(key, v, ...), trained on all of them.

    Each starts as that part of the vectors with the smallest keys, ascending (nulls last, equal keys by the vector). A round
    assigns every part to its nearest entry and replaces each entry by the floored mean of its parts; unused entries stay. Null
    vectors and those with nulls or values that are not finite are left out, so are those of another length than the
    commonest. With fewer vectors than entries, codebooks are as small; without vectors they are empty.
    """
    spark = vectors.sparkSession
    ship(spark)
    dim = integers.commonest_length(integers.usable(vectors, v), v)
    rows = _rounded(vectors, dim, v)
    first = rows.select(F.col(key).alias("k"), F.col(v).cast("array<double>").alias("x")).orderBy(F.col("k").asc_nulls_last(), "x").limit(entries).collect()
    start = _parts(pa.array([r["x"] for r in first], pa.list_(pa.float64())), dim, parts, scale)
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    if not len(first):
        return Codebooks(scale, dim, books)
    width = books[0].shape[1]
    names = [f"c{j}" for j in range(width)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast([(kd_tree(b), b) for b in books])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Python's integers hold any sum; a batch fits in int64, or has them itself
            sums = np.zeros((parts, entries, width), object)
            counts = np.zeros((parts, entries), np.int64)
            for batch in batches:
                x = _parts(batch.column(0), dim, parts, scale)
                exact = x if integers.fits(len(x) * int(np.abs(x).max(initial=0))) else x.astype(object)
                for p, (tree, book) in enumerate(sent.value):
                    who, _ = nearest(tree, book, x[:, p])
                    order = np.argsort(who, kind="stable")
                    used, at = np.unique(who[order], return_index=True)
                    if len(used) and width:
                        sums[p, used] += np.add.reduceat(exact[order, p], at, axis=0).astype(object)
                    counts[p] += np.bincount(who, minlength=entries)
            p, e = np.nonzero(counts)
            big = [pa.array(sums[p, e, j].tolist(), pa.decimal128(38, 0)) for j in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), *big], ["part", "entry", "n", *names])

        made = rows.select(F.col(v).cast("array<double>")).mapInArrow(kernel.lean(run), ", ".join(["part int, entry int, n long", *(f"{c} decimal(38,0)" for c in names)]))
        # parts x entries rows, whatever the number of vectors
        for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect():
            books[r["part"]][r["entry"]] = [int(r[c]) // r["n"] for c in names]
        sent.destroy()
    return Codebooks(scale, dim, books)


def encode(vectors: DataFrame, model: Codebooks, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """key, codes (array of entry indices by part), error (squared distance from the entries that stand for the vector).

    One row for each vector that fit would take; other rows are left out, other columns ignored. Repeated and null keys stay as they are.
    An error beyond a long counts as the largest long. Empty codebooks give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    parts, dim, scale = len(model.books), model.dim, model.scale
    sent = spark.sparkContext.broadcast([(kd_tree(b), b) for b in model.books] if len(model.books[0]) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _parts(batch.column(1), dim, parts, scale)
            found = [nearest(tree, book, x[:, p]) for p, (tree, book) in enumerate(sent.value)]
            codes = np.stack([who for who, _ in found], axis=1).astype(np.int32)
            error = sum(d.astype(object) for _, d in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([min(e, (1 << 63) - 1) for e in error], pa.int64())], [key, "codes", "error"])

    rows = _rounded(vectors, dim, v) if len(model.books[0]) else vectors.where("false")
    kind = vectors.schema[key].dataType.simpleString()
    return rows.select(key, F.col(v).cast("array<double>").alias("x")).mapInArrow(kernel.lean(run), f"`{key}` {kind}, codes array<int>, error long")


def decode(coded: DataFrame, model: Codebooks, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """key and the vector (array<double>) that codes stand for: entries over the scale. Rows without codes have a null vector."""
    spark = coded.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model.books)
    parts, dim, scale = len(model.books), model.dim, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            codes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            x = np.concatenate([book[codes[:, p]] for p, book in enumerate(sent.value)], axis=1)[:, :dim] / scale
            ends = np.concatenate([[0], np.cumsum(there * dim)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, v])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, "codes").mapInArrow(kernel.lean(run), f"`{key}` {kind}, `{v}` array<double>")
