"""Density clusters of vectors: exact neighbour searches by pivots, DBSCAN, and HDBSCAN's spanning tree.

Vectors live in the cell of their nearest pivot, of a bounded number of pivots that every task gets. A vector that looks for neighbours within a distance
visits each other cell that can hold one: by the triangle inequality a cell is passed over when its border or its ball is farther than that.
Cells of any size are cut into blocks, and blocks meet in tasks of their own, so no task holds more than two blocks. Tasks send back what
a vector needs (its nearest, a count, a local spanning forest), never all pairs. Equal vectors are one vector that
counts as often as it occurs. Within a task matrix products tell, with a bound on their rounding, which pairs can be near enough to matter;
of these alone the distances are worked out. Distances are Euclidean, added up in one order, so that they do not depend on blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators.graph import connected
from threadlake.session import ship, small, stored

#: Vectors of a block, components of a block (longer vectors have smaller blocks), pivots at most, and rows whose distances are added up together (they stay in a core's cache).
BLOCK, VALUES, PIVOTS, TILE = 32768, 1 << 21, 32, 128
#: Rows and columns of a matrix product, pairs whose distances are added up at once, and candidates of a forest that are held before it is cut to its edges.
ROWS, COLUMNS, PAIRS, HELD = 1024, 4096, 1 << 16, 1 << 20
#: Heights at which a first spanning tree is cut: over half of its edges, three quarters, and so on; the last one is its heaviest edge.
LEVELS = 8
POINT = "grp string, key long, n long, x array<double>"


def unit(v: str | Column) -> Column:
    """The vector at length 1, as doubles; zero vectors stay zero."""
    x = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    # as the one entry of an array the length is worked out once, not for each component
    return F.get(F.transform(F.array(size), lambda n: F.transform(x, lambda c: F.when(n > 0, c / n).otherwise(c))), F.lit(0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a from all rows of b, added up dimension by dimension."""
    out, across = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for lo in range(0, len(a), TILE):
        part, x = out[lo : lo + TILE], a[lo : lo + TILE]
        apart = np.empty(part.shape)
        for k in range(a.shape[1]):
            np.subtract(x[:, k, None], across[k][None, :], out=apart)
            np.multiply(apart, apart, out=apart)
            np.add(part, apart, out=part)
    return np.sqrt(out)


def apart(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a from rows j of b, the same numbers as those of distances."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), PAIRS):
        with np.errstate(over="ignore"):
            d = a[i[lo : lo + PAIRS]] - b[j[lo : lo + PAIRS]]
            np.multiply(d, d, out=d)
            for k in range(d.shape[1]):
                out[lo : lo + PAIRS] += d[:, k]
    return np.sqrt(out)


class Products:
    """Squared distances of rows of a from rows of b by matrix products of short floats, and what their rounding can hide.

    Both sides are centred and scaled first. Where that is not possible (the numbers are too large), every pair counts as near.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            middle = b.mean(axis=0)
            x, y = a - middle, b - middle
            self.scale = float(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
        known = bool(np.isfinite(self.scale))
        if not known or self.scale == 0:
            self.scale, x, y = 1.0, np.zeros(a.shape), np.zeros(b.shape)
        x, y = ((z / self.scale).astype(np.float32) for z in (x, y))
        nx, ny = ((z.astype(float) ** 2).sum(axis=1) for z in (x, y))
        one = lambda n: np.ones((n, 1), np.float32)
        self.x = np.hstack([-2 * x, nx[:, None].astype(np.float32), one(len(x))])
        self.y = np.ascontiguousarray(np.hstack([y, one(len(y)), ny[:, None].astype(np.float32)]).T)
        self.slack = float(16 * (a.shape[1] + 4) * 2.0**-24 * (nx.max(initial=0) + ny.max(initial=0)) + 1e-30) if known else np.inf
        self.slack += a.shape[1] * 1e-307 / self.scale / self.scale  # squares of differences that are too small for a double

    def squares(self, rows: slice, columns: slice) -> np.ndarray:
        return self.x[rows] @ self.y[:, columns]

    def limit(self, reach: np.ndarray | float) -> np.ndarray:
        """What squares of pairs within reach do not exceed."""
        with np.errstate(over="ignore"):
            return ((np.asarray(reach) / self.scale) ** 2 * (1 + 1e-6) + self.slack).astype(np.float32)

    def within(self, reach: float) -> np.float32:
        """Pairs whose squares do not exceed this are within reach for certain."""
        with np.errstate(over="ignore"):
            return np.float32((reach / self.scale) ** 2 * (1 - 1e-6) - self.slack)

    def reach(self, squares: np.ndarray) -> np.ndarray:
        """The largest distance that such squares can stand for."""
        with np.errstate(over="ignore"):
            return np.sqrt(np.maximum(squares.astype(float), 0) + self.slack) * self.scale * (1 + 1e-6)


def _parts(n: int, size: int) -> list[slice]:
    return [slice(lo, min(lo + size, n)) for lo in range(0, n, size)]


def points(vectors: DataFrame, key: str, v: str | Column, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (grp, key, n, x) named by their smallest key, and members (grp, key, rep): the name of each row's vector.

    Null vectors and those with nulls or values that are not finite are in neither; keys are whole numbers, each once in its group.
    """
    x = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    rows = vectors.select((F.col(by).cast("string") if by else F.lit("")).alias("grp"), F.col(key).cast("long").alias("key"), x.alias("x"))
    rows = stored(rows.where(F.col("x").isNotNull() & F.col("key").isNotNull()).where(F.forall("x", lambda c: F.abs(c) < F.lit(float("inf")))), "vectors")
    # -0.0 is 0.0 to a grouping; null groups are a group
    own = F.struct(F.xxhash64("x").alias("h"), F.transform("x", lambda c: c + F.lit(0.0)).alias("x")).alias("v")
    reps = stored(rows.groupBy("grp", own).agg(F.min("key").alias("key"), F.count("*").alias("n")).select("grp", "key", "n", "v.x"), "points")
    named = rows.select("grp", "key", own).alias("r").join(reps.select("grp", F.col("key").alias("rep"), F.struct(F.xxhash64("x").alias("h"), "x").alias("v")).alias("p"), F.col("r.grp").eqNullSafe(F.col("p.grp")) & (F.col("r.v") == F.col("p.v")))
    return reps, named.select("r.grp", "r.key", "rep")


class Cells:
    """points with their cell and their distances from pivots; pivots and radii are small and go to every task."""

    def __init__(self, own: DataFrame) -> None:
        ship(own.sparkSession)
        count = own.count()
        chosen = own.orderBy(F.xxhash64("key", "grp"), "key").limit(max(1, min(PIVOTS, count // (BLOCK // 2)))).select("x").collect()
        self.pivots = np.array([r["x"] for r in chosen])
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(_matrix(batch.column(3)), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))], [*batch.schema.names, "cell", "home"])

        self.rows = stored(own.select("grp", "key", "n", "x").mapInArrow(run, f"{POINT}, cell int, home double"), "cells") if count else own.sparkSession.createDataFrame([], f"{POINT}, cell int, home double")
        self.radii = np.zeros(len(chosen))
        for r in self.rows.groupBy("cell").agg(F.max("home").alias("r")).collect():
            self.radii[r["cell"]] = r["r"]

    @property
    def block(self) -> int:
        """Vectors of a block."""
        return max(1, min(BLOCK, VALUES // max(1, self.pivots.shape[1]))) if len(self.pivots) else BLOCK

    def visitors(self, rows: DataFrame, upward: bool = False) -> DataFrame:
        """rows (with reach) once for each other cell that can hold a vector within their reach; upward: of two cells rows of the first visit the second."""
        pivots, radii = self.pivots, self.radii
        names = rows.columns
        at = [names.index(c) for c in ("x", "cell", "home", "reach")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, cell, home, reach = _matrix(batch.column(at[0])), *(batch.column(k).to_numpy(zero_copy_only=False) for k in at[1:])
                far = distances(x, pivots)
                # rounding of either bound must not hide a neighbour
                near = np.maximum(far - radii, (far - home[:, None]) / 2) <= reach[:, None] + 1e-9 * (1 + far)
                near[np.arange(len(x)), cell] = False
                if upward:
                    near &= np.arange(len(pivots))[None, :] > cell[:, None]
                i, c = np.nonzero(near)
                out = batch.take(pa.array(i))
                yield out.set_column(at[1], "cell", pa.array(c.astype(np.int32)))

        return rows.mapInArrow(run, rows.schema)


def meet(home: DataFrame, asking: DataFrame, kernel: Callable[[pa.Table, pa.Table], dict], schema: str, block: int) -> DataFrame:
    """kernel(home rows, asking rows) for all blocks of the same group and cell; both tables have the same columns, with grp, key and cell."""
    names = home.columns
    size = lambda rows, c: rows.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias(c))
    grid = small(stored(size(home, "hs").join(size(asking, "asks"), ["grp", "cell"]), "grid"))
    part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    h = home.join(grid, ["grp", "cell"]).withColumn("i", part("hs")).withColumn("j", all_of("asks")).withColumn("asks_", F.lit(False))
    a = asking.join(grid, ["grp", "cell"]).withColumn("j", part("asks")).withColumn("i", all_of("hs")).withColumn("asks_", F.lit(True))
    kinds = [f.split()[0] for f in schema.split(",")]

    def run(block: pa.Table) -> pa.Table:
        asks = block.column("asks_").to_numpy()
        at = [pa.array(np.flatnonzero(side)) for side in (~asks, asks)]
        out = kernel(*(block.take(k) for k in at)) if len(at[0]) and len(at[1]) else {}
        first = block.column("grp")[0]
        n = len(next(iter(out.values()), []))
        return pa.table({"grp": pa.array([first.as_py()] * n, pa.string())} | {c: pa.array(out.get(c, []), types[c]) for c in kinds[1:]})

    types = {c: {"long": pa.int64(), "double": pa.float64()}[t] for c, t in (f.split() for f in schema.split(",")[1:])}
    both = h.select(*names, "i", "j", "asks_").unionByName(a.select(*names, "i", "j", "asks_"))
    return both.groupBy("grp", "cell", "i", "j").applyInArrow(run, schema)


def nearest_neighbours(cells: Cells, k: int) -> DataFrame:
    """grp, key, other, apart, n: of each point its k nearest others (ties by key), exact. First in its own cell, then in the cells that can hold nearer ones."""

    def kernel(home: pa.Table, asking: pa.Table) -> dict:
        hk, ak, n, reach = (t.column(c).to_numpy() for t, c in ((home, "key"), (asking, "key"), (home, "n"), (asking, "reach")))
        order = np.argsort(hk)  # columns stand in the order of keys
        hk, n, a, b = hk[order], n[order], _matrix(asking.column("x")), _matrix(home.column("x"))[order]
        products, out = Products(a, b), []
        for rows in _parts(len(ak), ROWS):
            most, keys, own = reach[rows].copy(), ak[rows], a[rows]
            r, c, far = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for columns in _parts(len(hk), COLUMNS):
                squares = products.squares(rows, columns)
                if squares.shape[1] > k and np.isinf(most).any():
                    # one more than k, as a point may be its own neighbour here
                    most = np.minimum(most, products.reach(np.partition(squares, k, axis=1)[:, k]))
                i, j = np.nonzero(squares <= products.limit(most)[:, None])
                j += columns.start
                other = keys[i] != hk[j]
                i, j = i[other], j[other]
                d = apart(own, i, b, j)
                near = d <= most[i]
                r, c, far = np.concatenate([r, i[near]]), np.concatenate([c, j[near]]), np.concatenate([far, d[near]])
                first = np.lexsort((c, far, r))
                r, c, far = r[first], c[first], far[first]
                at = np.arange(len(r)) - np.searchsorted(r, r)
                r, c, far, at = r[at < k], c[at < k], far[at < k], at[at < k]
                last = at == k - 1
                most[r[last]] = np.minimum(most[r[last]], far[last])
            out.append((keys[r], hk[c], far, n[c]))
        return dict(zip(("key", "other", "apart", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    schema = "grp string,key long,other long,apart double,n long"
    best = Window.partitionBy("grp", "key").orderBy("apart", "other")
    top = lambda df: df.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    base = cells.rows.select("grp", "key", "n", "x", "cell", "home")
    own = base.withColumn("reach", F.lit(float("inf")))
    first = stored(top(meet(own, own, kernel, schema, cells.block)), "near")
    if len(cells.pivots) < 2:
        return first
    reach = first.groupBy("grp", "key").agg(F.when(F.count("*") >= k, F.max("apart")).otherwise(F.lit(float("inf"))).alias("reach"))
    asking = stored(cells.visitors(base.join(reach, ["grp", "key"], "left").fillna(float("inf"), "reach").select(own.columns)), "asking")
    return top(first.unionByName(meet(own, asking, kernel, schema, cells.block)))


def core_distances(cells: Cells, near: DataFrame, least: int) -> DataFrame:
    """grp, key, core: the distance to the least-th row, the point's own row and its copies included; null where there are fewer."""
    so_far = F.sum("n").over(Window.partitionBy("grp", "key").orderBy("apart", "other"))
    own = cells.rows.select("grp", "key", F.col("n").alias("copies"))
    reached = near.withColumn("so_far", so_far).join(own, ["grp", "key"]).where(F.col("copies") + F.col("so_far") >= least).groupBy("grp", "key").agg(F.min("apart").alias("far"))
    return own.join(reached, ["grp", "key"], "left").select("grp", "key", F.when(F.col("copies") >= least, 0.0).otherwise(F.col("far")).alias("core"))


def edge_forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Places, ascending, of the edges (x, y) between nodes 0 to n - 1 that make the minimum spanning forest in the order in which they stand; Borůvka's rounds on arrays."""
    comp, e, kept = np.arange(n), np.arange(len(x)), [np.zeros(0, int)]
    while True:
        open_ = comp[x[e]] != comp[y[e]]
        e = e[open_]
        if not len(e):
            return np.sort(np.concatenate(kept))
        first = np.full(n, len(x))
        np.minimum.at(first, comp[x[e]], e)
        np.minimum.at(first, comp[y[e]], e)
        c = np.flatnonzero(first < len(x))
        pick = first[c]
        kept.append(np.unique(pick))
        up = np.arange(n)
        up[c] = np.where(comp[x[pick]] == c, comp[y[pick]], comp[x[pick]])
        both = c[(up[up[c]] == c) & (c < up[c])]  # two that choose each other: the smaller is the root
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        comp = up[comp]


def spanning_forest(edges: DataFrame) -> DataFrame:
    """grp, a, b, w, d: the minimum spanning forest of edges (grp, a, b, w, d; a < b) in the order of (w, d, a, b), by Borůvka's rounds.

    In each round every component takes its first edge; components that edges join become one, and of parallel edges the first
    stays. The tables of a round are written to the shared folder.
    """
    e = stored(edges.groupBy("grp", "a", "b").agg(F.min(F.struct("w", "d")).alias("m")).select("grp", F.col("a").alias("x"), F.col("b").alias("y"), F.struct("m.w", "m.d", "a", "b").alias("e")), "edges")
    forest = None
    while not e.isEmpty():
        ends = e.select("grp", F.col("x").alias("c"), F.col("y").alias("to"), "e").union(e.select("grp", F.col("y").alias("c"), F.col("x").alias("to"), "e"))
        first = stored(ends.groupBy("grp", "c").agg(F.min(F.struct("e", "to")).alias("m")).select("grp", "c", "m.to", "m.e"), "first")
        picked = first.select("grp", "e.a", "e.b", "e.w", "e.d").distinct()
        forest = picked if forest is None else forest.union(picked)
        # two that choose each other: the smaller is the root; the others point on to it
        back = first.select("grp", F.col("c").alias("to"), F.col("to").alias("then"))
        up = first.join(back, ["grp", "to"]).select("grp", "c", F.when((F.col("then") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root"))
        up = stored(up, "up")
        while True:
            on = up.select("grp", F.col("c").alias("root"), F.col("root").alias("higher"))
            two = up.join(on, ["grp", "root"]).select("grp", "c", F.col("root").alias("before"), F.col("higher").alias("root"))
            nxt = stored(two.join(on, ["grp", "root"]).select("grp", "c", "before", "higher"), "up")
            up = nxt.select("grp", "c", F.col("higher").alias("root"))
            if nxt.where("higher <> before").isEmpty():
                break
        m = e.join(up.withColumnsRenamed({"c": "x", "root": "rx"}), ["grp", "x"]).join(up.withColumnsRenamed({"c": "y", "root": "ry"}), ["grp", "y"]).where("rx <> ry")
        e = stored(m.groupBy("grp", F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min("e").alias("e")), "edges")
    return stored(forest, "forest") if forest is not None else edges.select("grp", "a", "b", "w", "d").where("false")


def _levels(tree: DataFrame) -> DataFrame:
    """grp, key, heights, comps of spanning trees (grp, a, b, w, d): LEVELS heights, ascending to that of the heaviest edge, and what edges up to each of them connect the point with.

    A tree, three numbers a vector, is cut by one task, as for the labels.
    """

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        w = edges["w"].to_numpy()
        order = np.argsort(w, kind="stable")
        keys, ends = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
        w, x, y = w[order], ends[: len(w)][order], ends[len(w) :][order]
        heights = [float(w[int(len(w) * (1 - 0.5**t))]) for t in range(1, LEVELS)] + [float(w[-1])]
        up, done, comps = list(range(len(keys))), 0, []

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for h in heights:
            while done < len(w) and w[done] <= h:
                up[top(int(x[done]))] = top(int(y[done]))
                done += 1
            comps.append([top(i) for i in range(len(keys))])
        return pd.DataFrame({"grp": edges["grp"].iloc[0], "key": keys, "heights": [heights] * len(keys), "comps": np.array(comps, np.int32).T.tolist()})

    return tree.groupBy("grp").applyInPandas(run, "grp string, key long, heights array<double>, comps array<int>")


def _lighter(home: pa.Table, asking: pa.Table) -> dict:
    """Edges a, b, w, d between two blocks of points that can be in the minimum spanning tree of mutual reachability, given a tree cut at heights.

    A pair that the tree connects at a height is in it only if it is not heavier. Of pairs heavier than the last height but one between the same two
    parts below that height only the lightest can be.
    """
    sides = []
    for t in (home, asking):
        comps = t.column("comps").combine_chunks().flatten().to_numpy().reshape(-1, LEVELS)
        key = t.column("key").to_numpy()
        o = np.lexsort((key, *comps.T))  # parts lie side by side, those of the greatest height first of all
        sides.append((key[o], t.column("core").to_numpy()[o], _matrix(t.column("x"))[o], comps[o]))
    (hk, hc, hx, hp), (ak, ac, ax, ap) = sides
    heights = home.column("heights")[0].as_py()
    products = Products(hx, ax)
    keys, at = np.unique(np.concatenate([hk, ak]), return_inverse=True)
    at_h, at_a = at[: len(hk)], at[len(hk) :]
    limits = [products.limit(h) for h in heights]
    with np.errstate(over="ignore"):
        h2, a2 = (((c / products.scale) ** 2).astype(np.float32) for c in (hc, ac))
    none = np.zeros(0, int)
    kept = (none, none, np.zeros(0), np.zeros(0))  # places of both keys, weight, distance
    held: list[tuple] = [kept]

    def cut() -> tuple:
        i, j, w, d = (np.concatenate(z) for z in zip(*held, strict=True))
        order = np.lexsort((j, i, d, w))
        i, j, w, d = i[order], j[order], w[order], d[order]
        f = edge_forest(i, j, len(keys))
        return i[f], j[f], w[f], d[f]

    for rows in _parts(len(hk), ROWS):
        p = hp[rows]
        for columns in _parts(len(ak), COLUMNS):
            q = ap[columns]
            squares = products.squares(rows, columns)
            found = np.zeros(squares.shape, bool)
            for t, limit in enumerate(limits):
                x, y = p[:, t], q[:, t]
                if t == LEVELS - 1:
                    found |= _lightest(np.maximum(np.maximum(squares, h2[rows][:, None]), a2[columns][None, :]), p[:, t - 1], q[:, t - 1], limits[t - 1], limit, products.slack)
                    break
                alike = bool((x == x[0]).all() and (y == x[0]).all())
                if not alike and not np.isin(x, y).any():
                    continue
                near = squares <= limit
                if not alike:
                    near &= x[:, None] == y[None, :]
                near &= (hc[rows] <= heights[t])[:, None]
                near &= (ac[columns] <= heights[t])[None, :]
                found |= near
                if alike:
                    break
            i, j = np.nonzero(found)
            i, j = i + rows.start, j + columns.start
            other = hk[i] != ak[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            d = apart(hx, i, ax, j)
            u, v = at_h[i], at_a[j]
            held.append((np.minimum(u, v), np.maximum(u, v), np.maximum(np.maximum(hc[i], ac[j]), d), d))
            if sum(len(z[0]) for z in held) > HELD:
                held[:] = [cut()]
    i, j, w, d = cut()
    return {"a": keys[i], "b": keys[j], "w": w, "d": d}


def _lightest(squares: np.ndarray, p: np.ndarray, q: np.ndarray, low: np.float32, high: np.float32, slack: float) -> np.ndarray:
    """Which pairs of different parts (p of the rows, q of the columns, each part in one run) are under low, or under high and perhaps the lightest of their two parts."""
    starts = [np.flatnonzero(np.r_[True, z[1:] != z[:-1]]) for z in (p, q)]
    runs = [np.diff(np.r_[s, len(z)]) for s, z in zip(starts, (p, q), strict=True)]
    least = np.minimum.reduceat(np.minimum.reduceat(squares, starts[0], axis=0), starts[1], axis=1)
    most = np.minimum(np.maximum(least * np.float32(1 + 1e-6) + np.float32(2 * slack), low), high)
    most[p[starts[0]][:, None] == q[starts[1]][None, :]] = -np.inf
    return squares <= np.repeat(np.repeat(most, runs[0], axis=0), runs[1], axis=1)


def reachability_tree(cells: Cells, near: DataFrame, core: DataFrame) -> DataFrame:
    """grp, a, b, w, d: the minimum spanning tree of mutual reachability, max(core, core, distance), of each group's points.

    The edges to near neighbours, and edges to one point from components that they leave apart, span each group. Their tree, cut at some heights,
    tells which other pairs can be lighter than the way between them: first those within cells, then, by the better tree, those between cells.
    """
    rows = stored(cells.rows.join(core, ["grp", "key"]), "cored")
    low = core.select("grp", F.col("key").alias("other"), F.col("core").alias("core2"))
    weight = F.greatest("core", "core2", "apart")
    short = stored(near.join(core, ["grp", "key"]).join(low, ["grp", "other"]).select("grp", F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), weight.alias("w"), F.col("apart").alias("d")), "short")
    comp = connected(short.select(F.xxhash64("grp", "a").alias("a"), F.xxhash64("grp", "b").alias("b")))
    named = rows.withColumn("node", F.xxhash64("grp", "key")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    reps = named.groupBy("grp", "comp").agg(F.min_by(F.struct("key", "x", "core"), "key").alias("p"))
    hub = reps.groupBy("grp").agg(F.min_by("p", "p.key").alias("hub"))
    far = F.sqrt(F.aggregate(F.zip_with("p.x", "hub.x", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    spokes = reps.join(hub, "grp").where("p.key <> hub.key").withColumn("d", far)
    spokes = spokes.select("grp", F.least("p.key", "hub.key").alias("a"), F.greatest("p.key", "hub.key").alias("b"), F.greatest("p.core", "hub.core", "d").alias("w"), "d")
    tree = spanning_forest(short.unionByName(spokes).where(F.col("w") < float("inf")))
    schema = "grp string,a long,b long,w double,d double"
    for between in (False, True) if len(cells.pivots) > 1 else (False,):
        base = stored(rows.join(_levels(tree), ["grp", "key"]).select("grp", "key", "n", "x", "cell", "home", "core", "heights", "comps", (F.element_at("heights", -1) * (1 + 1e-9)).alias("reach")), "levels")
        asking = stored(cells.visitors(base, upward=True), "asking") if between else base
        tree = spanning_forest(tree.unionByName(meet(base, asking, _lighter, schema, cells.block)))
    return tree


def condensed_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, d: np.ndarray, least: int) -> dict[int, int]:
    """Key to cluster (numbers from 0, -1 for none) of a spanning tree: splits into parts of at least least members, chosen by excess of mass; never all as one."""
    keys, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(keys)
    up, size = list(range(n)), [1] * n
    kids: list[tuple[int, int]] = []
    order = np.lexsort((b, a, d, w)).tolist()

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e in order:
        x, y = top(int(ends[e])), top(int(ends[n - 1 + e]))
        up[x] = up[y] = len(up)
        up.append(len(up))
        size.append(size[x] + size[y])
        kids.append((x, y))
    rate = [1 / w[e] if w[e] > 0 else np.inf for e in order]
    birth, mass, over = [0.0], [0.0], [-1]
    cluster_of = [0] * n

    def fall(node: int, cluster: int) -> None:
        todo = [node]
        while todo:
            x = todo.pop()
            if x < n:
                cluster_of[x] = cluster
            else:
                todo += kids[x - n]

    todo = [(len(up) - 1, 0)] if n > 1 else []
    while todo:
        node, cluster = todo.pop()
        at = rate[node - n]
        gained = at - birth[cluster] if at > birth[cluster] else 0.0
        big = [x for x in kids[node - n] if size[x] >= least]
        for x in kids[node - n]:
            if len(big) == 2:
                mass[cluster] += gained * size[x]
                birth.append(at)
                mass.append(0.0)
                over.append(cluster)
                todo.append((x, len(birth) - 1))
            elif x in big:
                todo.append((x, cluster))
            else:
                mass[cluster] += gained * size[x]
                fall(x, cluster)
    below = [0.0] * len(mass)
    chosen = [False] * len(mass)
    for c in range(len(mass) - 1, 0, -1):
        chosen[c] = not below[c] > mass[c]
        below[over[c]] += max(below[c], mass[c])
    name, number = [-1] * len(mass), 0
    for c in range(1, len(mass)):  # parents first: the highest chosen counts
        if name[over[c]] >= 0:
            name[c] = name[over[c]]
        elif chosen[c]:
            name[c], number = number, number + 1
    return {int(k): name[c] for k, c in zip(keys, cluster_of, strict=True)}


def hdbscan(vectors: DataFrame, key: str = "vec_id", v: str | Column = "embedding", by: str | None = None, least_size: int = 10, least_rows: int = 5) -> DataFrame:
    """grp, key, cluster: hierarchical density clusters within each group of by; cluster is null for noise, else numbered from 1 by falling size, then smallest key.

    Clusters have least_size rows or more, core distances reach the least_rows-th row (itself included). Groups with fewer than least_size rows are noise. Ties of
    reachability go by distance, then by key. The tree of a group, three numbers a vector, is cut by one task; vectors never meet there. Rows
    without a usable vector or key are left out.
    """
    ship(vectors.sparkSession)
    own, members = points(vectors, key, v, by)
    members = stored(members, "members")
    large = members.groupBy("grp").count().where(F.col("count") >= least_size).select("grp")
    own = stored(own.fillna("\0null", "grp").join(small(large.fillna("\0null", "grp")), "grp", "left_semi"), "points")
    cells = Cells(own)
    near = stored(nearest_neighbours(cells, max(1, least_rows - 1)), "near")
    core = stored(core_distances(cells, near, least_rows).fillna(float("inf"), "core"), "core")
    tree = reachability_tree(cells, near, core).select("grp", "a", "b", "w", "d")
    copies = members.fillna("\0null", "grp").where("key <> rep").join(core.withColumnRenamed("key", "rep"), ["grp", "rep"]).select("grp", F.col("rep").alias("a"), F.col("key").alias("b"), F.col("core").alias("w"), F.lit(0.0).alias("d"))

    def cut(edges: pd.DataFrame) -> pd.DataFrame:
        found = condensed_labels(*(edges[c].to_numpy() for c in ("a", "b", "w", "d")), least_size)
        return pd.DataFrame({"grp": edges["grp"].iloc[0], "key": list(found), "found": list(found.values())})

    labels = stored(tree.unionByName(copies).groupBy("grp").applyInPandas(cut, "grp string, key long, found long"), "labels")
    sizes = labels.where("found >= 0").groupBy("grp", "found").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    # a row a cluster
    number = sizes.withColumn("cluster", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "first"))).select("grp", "found", "cluster")
    named = labels.join(small(number), ["grp", "found"]).select("grp", "key", "cluster")
    out = members.select("grp", "key").fillna("\0null", "grp").join(named, ["grp", "key"], "left")
    return out.select(F.when(F.col("grp") != "\0null", F.col("grp")).alias("grp"), "key", "cluster")


def dbscan(vectors: DataFrame, eps: float, least_rows: int, key: str = "vec_id", v: str | Column = "embedding", by: str | None = None) -> DataFrame:
    """grp, key, core, cluster: density clusters by Euclidean distance, named by the smallest key of a core row; cluster is null for noise.

    A row with least_rows rows within eps, itself included, is a core row; core rows within eps share a cluster; another row within eps of core rows joins the
    cluster with the smallest name among theirs. Exact. For cosine distance c give unit vectors and eps = sqrt(2 * c). Rows without
    a usable vector or key are left out.
    """
    ship(vectors.sparkSession)
    own, members = points(vectors, key, v, by)
    own = own.fillna("\0null", "grp")
    cells = Cells(own)
    base = cells.rows.withColumn("reach", F.lit(float(eps)))

    def counts(home: pa.Table, asking: pa.Table) -> dict:
        """Of each asking row the rows within eps, or so many that it is a core row."""
        a, b = _matrix(asking.column("x")), _matrix(home.column("x"))
        n = np.minimum(home.column("n").to_numpy(), least_rows).astype(float)
        products, rows, single = Products(a, b), np.zeros(len(a), np.int64), bool((n == 1).all())
        sure, maybe = products.within(eps), products.limit(eps)
        for part in _parts(len(a), ROWS):
            for columns in _parts(len(b), COLUMNS):
                few = np.flatnonzero(rows[part] < least_rows) + part.start
                if not len(few):
                    break
                squares = products.squares(few, columns)
                near = squares <= sure
                i, j = np.nonzero((squares <= maybe) & ~near)
                near[i, j] = apart(a, few[i], b, j + columns.start) <= eps
                rows[few] += np.count_nonzero(near, axis=1) if single else (near @ n[columns]).astype(np.int64)
        return {"key": asking.column("key").to_numpy(), "rows": rows}

    schema = "grp string,key long,rows long"
    own = stored(meet(base, base, counts, schema, cells.block).groupBy("grp", "key").agg(F.sum("rows").alias("rows")), "counts")
    if len(cells.pivots) > 1:
        few = base.join(own.where(F.col("rows") < least_rows).select("grp", "key"), ["grp", "key"]).select(base.columns)
        own = own.unionByName(meet(base, stored(cells.visitors(few), "asking"), counts, schema, cells.block)).groupBy("grp", "key").agg(F.sum("rows").alias("rows"))
    core = stored(own.select("grp", "key", (F.col("rows") >= least_rows).alias("core")), "core")

    def links(home: pa.Table, asking: pa.Table) -> dict:
        """A forest of links between core rows of different components."""
        sides = []
        for t in (home, asking):
            key, comp = t.column("key").to_numpy(), t.column("comp").to_numpy()
            o = np.lexsort((key, comp))
            sides.append((key[o], comp[o], _matrix(t.column("x"))[o]))
        (hk, hp, hx), (ak, ap, ax) = sides
        products = Products(hx, ax)
        sure, maybe = products.within(eps), products.limit(eps)
        parts, at = np.unique(np.concatenate([hp, ap]), return_inverse=True)
        h, a = at[: len(hk)], at[len(hk) :]
        up, found = np.arange(len(parts)), []

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = int(up[i])
            return i

        def tops(i: np.ndarray) -> np.ndarray:
            z = up[i]
            while (up[z] != z).any():
                z = up[z]
            return z

        for rows in _parts(len(hk), ROWS):
            for columns in _parts(len(ak), COLUMNS):
                x, y = tops(h[rows]), tops(a[columns])
                if (x == x[0]).all() and (y == x[0]).all():
                    continue
                squares = products.squares(rows, columns)
                near = (squares <= maybe) & (x[:, None] != y[None, :])
                # each column takes a row that is near, until no two components are
                while len(j := np.flatnonzero(near.any(axis=0))):
                    i = near[:, j].argmax(axis=0)
                    good = squares[i, j] <= sure
                    good[~good] = apart(hx, i[~good] + rows.start, ax, j[~good] + columns.start) <= eps
                    near[i[~good], j[~good]] = False
                    for r, c in zip((i[good] + rows.start).tolist(), (j[good] + columns.start).tolist(), strict=True):
                        u, v = top(int(h[r])), top(int(a[c]))
                        if u != v:
                            up[max(u, v)] = min(u, v)
                            found.append((hk[r], ak[c]))
                    near &= tops(h[rows])[:, None] != tops(a[columns])[None, :]
        one, two = np.array(found, np.int64).reshape(-1, 2).T
        return {"a": one, "b": two}

    def borders(home: pa.Table, asking: pa.Table) -> dict:
        """The core rows within eps of the asking rows, which are no core rows and so have few."""
        a, b = _matrix(asking.column("x")), _matrix(home.column("x"))
        ak, hk, products, out = asking.column("key").to_numpy(), home.column("key").to_numpy(), Products(a, b), []
        for rows in _parts(len(a), ROWS):
            for columns in _parts(len(b), COLUMNS):
                i, j = np.nonzero(products.squares(rows, columns) <= products.limit(eps))
                i, j = i + rows.start, j + columns.start
                near = apart(a, i, b, j) <= eps
                out.append((ak[i[near]], hk[j[near]]))
        return dict(zip("ab", map(np.concatenate, zip(*out, strict=True)), strict=True))

    schema = "grp string,a long,b long"
    node = lambda c: F.xxhash64("grp", c)
    cored = stored(base.join(core, ["grp", "key"]).select(*base.columns, "core", node("key").alias("comp")), "cored")
    dense, sparse = cored.where("core").drop("core"), cored.where("NOT core").drop("core")
    edges = stored(meet(dense, dense, links, schema, cells.block), "links")
    comp = connected(edges.select(node("a").alias("a"), node("b").alias("b")))
    if len(cells.pivots) > 1:
        named = dense.withColumnRenamed("comp", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select(dense.columns)
        dense = stored(named, "dense")
        across = meet(dense, stored(cells.visitors(dense, upward=True), "asking"), links, schema, cells.block)
        comp = connected(edges.unionByName(across).select(node("a").alias("a"), node("b").alias("b")))
    beside = meet(dense, stored(sparse.unionByName(cells.visitors(sparse)), "asking"), borders, schema, cells.block)
    cores = core.where("core").select("grp", "key", node("key").alias("node")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = cores.groupBy("comp").agg(F.min("key").alias("cluster"))
    cores = stored(cores.join(names, "comp").select("grp", "key", "cluster"), "cores")
    border = beside.join(cores.withColumnRenamed("key", "b"), ["grp", "b"]).groupBy("grp", F.col("a").alias("key")).agg(F.min("cluster").alias("cluster"))
    labels = cores.unionByName(border).withColumnRenamed("key", "rep")
    rows = members.fillna("\0null", "grp").join(core.withColumnRenamed("key", "rep"), ["grp", "rep"]).join(labels, ["grp", "rep"], "left")
    return rows.select(F.when(F.col("grp") != "\0null", F.col("grp")).alias("grp"), "key", "core", "cluster")


def summaries(labels: DataFrame, vectors: DataFrame, samples: int, key: str = "vec_id", v: str | Column = "embedding") -> DataFrame:
    """grp, cluster, n, centroid, nearest (keys of the samples rows nearest to the centroid, ties by key), for labels (grp, key, cluster)."""
    x = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    own = labels.where("cluster IS NOT NULL").join(vectors.select(F.col(key).cast("long").alias("key"), x.alias("x")), "key")
    by = ["grp", "cluster"]
    means = own.select(*by, F.posexplode("x").alias("pos", "c")).groupBy(*by, "pos").agg(F.avg("c").alias("c"), F.count("*").alias("n"))
    centre = stored(means.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("centroid")), "centroids")
    apart = F.aggregate(F.zip_with("x", "centroid", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t)
    same = F.col("o.grp").eqNullSafe(F.col("c.grp")) & (F.col("o.cluster") == F.col("c.cluster"))
    near = own.alias("o").join(small(centre).alias("c"), same).select("c.grp", "c.cluster", "c.n", "c.centroid", "o.key", F.round(apart, 12).alias("apart"))
    top = near.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("apart", "key"))).where(F.col("r") <= samples)
    return top.groupBy(*by).agg(F.first("n").alias("n"), F.first("centroid").alias("centroid"), F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda s: s["key"]).alias("nearest"))


def examples(labels: DataFrame, most: int) -> DataFrame:
    """grp, cluster, examples: most keys of each cluster of labels (grp, key, cluster), in the order of a hash."""
    order = Window.partitionBy("grp", "cluster").orderBy(F.md5(F.col("key").cast("string")), "key")
    top = labels.where("cluster IS NOT NULL").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return top.groupBy("grp", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda s: s["key"]).alias("examples"))
