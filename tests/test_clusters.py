"""Density clusters against plain versions over all pairs, on fixtures with ties, copies, outliers, groups and odd rows."""

import numpy as np
import pytest

from threadlake.operators import clusters, graph

NAN, INF = float("nan"), float("inf")


def blobs(seed=0, dim=4, sizes=(40, 25, 30), spread=0.15, noise=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dim)) * 3
    x = [c + rng.normal(size=dim) * spread for c, n in zip(centres, sizes, strict=True) for _ in range(n)]
    x += [rng.normal(size=dim) * 4 for _ in range(noise)]
    return [[round(float(c), 2) for c in row] for row in x]  # rounded, so that distances tie


def plain_hdbscan(rows, least_size, least_rows):
    """Key to cluster over all pairs: Kruskal in the order of (reachability, distance, keys), then the condensed tree, recursively."""
    rows = sorted(rows)
    n = len(rows)
    if n < least_size:
        return {k: None for k, _ in rows}
    x = np.array([v for _, v in rows], float).reshape(n, -1)
    d = clusters.distances(x, x)
    core = np.sort(d, axis=1)[:, least_rows - 1]
    edges = sorted((max(core[i], core[j], d[i, j]), d[i, j], rows[i][0], rows[j][0]) for i in range(n) for j in range(i + 1, n))
    part = {k: frozenset([k]) for k, _ in rows}
    split = {}  # a set to (weight, left, right)
    for w, _, a, b in edges:
        if part[a] is not part[b]:
            both = part[a] | part[b]
            split[both] = (w, part[a], part[b])
            for k in both:
                part[k] = both
    found = []

    def walk(node, birth):
        """(mass, chosen sets of members) of a cluster that begins as node; members are all that ever fall out below it."""
        mass, members, at = 0.0, node, node
        while True:
            if at not in split:
                return mass, [members]
            w, left, right = split[at]
            rate = 1 / w if w else INF
            gained = rate - birth if rate > birth else 0.0
            big = [s for s in (left, right) if len(s) >= least_size]
            if len(big) == 2:
                mass += gained * len(at)
                below = [walk(s, rate) for s in big]
                if sum(m for m, _ in below) > mass:
                    return sum(m for m, _ in below), [s for _, c in below for s in c]
                return mass, [members]
            if not big:
                return mass + gained * len(at), [members]
            mass += gained * (len(at) - len(big[0]))
            at = big[0]

    at = part[rows[0][0]]
    while at in split:  # the root is never one cluster
        _, left, right = split[at]
        big = [s for s in (left, right) if len(s) >= least_size]
        if len(big) == 2:
            rate = 1 / split[at][0] if split[at][0] else INF
            found = [c for s in big for c in walk(s, rate)[1]]
            break
        if not big:
            break
        at = big[0]
    found.sort(key=lambda s: (-len(s), min(s)))
    out = {k: None for k, _ in rows}
    for i, s in enumerate(found):
        out |= {k: i + 1 for k in s}
    return out


def plain_dbscan(rows, eps, least):
    rows = sorted(rows)
    x = np.array([v for _, v in rows], float)
    near = clusters.distances(x, x) <= eps
    core = near.sum(axis=1) >= least
    keys, name = [k for k, _ in rows], {}
    for i in range(len(rows)):
        if core[i] and keys[i] not in name:
            todo = [i]
            while todo:
                j = todo.pop()
                if keys[j] not in name:
                    name[keys[j]] = keys[i]
                    todo += [k for k in np.flatnonzero(near[j]).tolist() if core[k]]
    return {keys[i]: (bool(core[i]), name.get(keys[i], min((name[keys[j]] for j in np.flatnonzero(near[i]).tolist() if core[j]), default=None))) for i in range(len(rows))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, who string, n int, cluster string")


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks and pivots so small that cells are cut and visited, as with many vectors."""
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(clusters, "PIVOTS", 5)


@pytest.mark.parametrize("seed,least_size,least_rows", [(0, 10, 5), (1, 5, 1)])
def test_hdbscan(spark, small_blocks, seed, least_size, least_rows):
    a, b = blobs(seed), blobs(seed + 50, sizes=(15, 9), noise=6)
    b += [b[0]] * 12 + [b[3]] * 4  # copies
    rows = [(i, x, "a", 1, "z") for i, x in enumerate(a)] + [(1000 + i, x, "b", 1, "z") for i, x in enumerate(b)] + [(5000 + i, a[i], None, 1, "z") for i in range(4)]
    odd = [(2000, None, "a", 1, "z"), (2001, [NAN] * 4, "a", 1, "z"), (2002, [1.0, None, 0.0, 0.0], "b", 1, "z"), (2003, [INF] * 4, "b", 1, "z")]
    got = {(r["grp"], r["key"]): r["cluster"] for r in clusters.hdbscan(frame(spark, rows + odd), by="who", least_size=least_size, least_rows=least_rows).collect()}
    want = {(g, k): c for g in ("a", "b", None) for k, c in plain_hdbscan([(r[0], r[1]) for r in rows if r[2] == g], least_size, least_rows).items()}
    assert got == want
    assert len({c for (g, _), c in want.items() if g == "a" and c}) >= 2


def test_hdbscan_of_few_or_no_rows(spark):
    rows = [(i, [float(i)], "a", 1, "z") for i in range(9)]
    assert {r["cluster"] for r in clusters.hdbscan(frame(spark, rows)).collect()} == {None}
    assert clusters.hdbscan(frame(spark, rows).where("false")).count() == 0
    assert {r["cluster"] for r in clusters.hdbscan(frame(spark, [(i, [1.0, 2.0], "a", 1, "z") for i in range(30)])).collect()} == {None}


@pytest.mark.parametrize("eps,least", [(0.3, 4), (6.0, 4), (0.0, 2)])
def test_dbscan(spark, small_blocks, eps, least):
    x = blobs(3)
    rows = [(i, v, "a", 1, "z") for i, v in enumerate([*x, x[1], x[1], x[50]])]
    got = {r["key"]: (r["core"], r["cluster"]) for r in clusters.dbscan(frame(spark, [*rows, (900, None, "a", 1, "z")]), eps, least).collect()}
    assert got == plain_dbscan([(r[0], r[1]) for r in rows], eps, least)


def test_dbscan_by_group(spark, small_blocks):
    x = blobs(4)
    rows = [(i, v, "ab"[i % 2] if i % 7 else None, 1, "z") for i, v in enumerate(x)]
    got = {(r["grp"], r["key"]): (r["core"], r["cluster"]) for r in clusters.dbscan(frame(spark, rows), 0.4, 4, by="who").collect()}
    want = {(g, k): c for g in ("a", "b", None) for k, c in plain_dbscan([(r[0], r[1]) for r in rows if r[2] == g], 0.4, 4).items()}
    assert got == want
    assert clusters.dbscan(frame(spark, rows).where("false"), 0.4, 4).count() == 0


def test_connected(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(200, 300)] + [(400, 399), (399, 401), (7, 7)]
    edges = chain + [(int(a), int(b)) for a, b in rng.integers(0, 150, size=(90, 2))]
    up = {n: n for e in edges for n in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["comp"] for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == up


def test_spanning_forest_of_ties(spark):
    rng = np.random.default_rng(9)
    e = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, size=(300, 2)).tolist() if a != b})
    rows = [("g", a, b, float(rng.integers(0, 4)), 0.0) for a, b in e]
    up, want = {n: n for x in e for n in x}, set()

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for _, a, b, w, _ in sorted(rows, key=lambda r: (r[3], r[4], r[1], r[2])):
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            want.add((a, b, w))
    got = clusters.spanning_forest(spark.createDataFrame(rows, "grp string, a long, b long, w double, d double")).collect()
    assert {(r["a"], r["b"], r["w"]) for r in got} == want and len(got) == len(want)


def test_summaries(spark):
    rows = [(1, [0.0, 0.0], "a", 1, ""), (2, [2.0, 0.0], "a", 1, ""), (3, [1.0, 0.5], "a", 1, ""), (4, [1.0, -0.5], "a", 1, ""), (9, [5.0, 5.0], "a", 1, "")]
    labels = spark.createDataFrame([(None, 1, 1), (None, 2, 1), (None, 3, 1), (None, 4, 1), (None, 9, None)], "grp string, key long, cluster long")
    (r,) = clusters.summaries(labels, frame(spark, rows), 3).collect()
    assert (r["n"], r["centroid"], r["nearest"]) == (4, [1.0, 0.0], [3, 4, 1])
