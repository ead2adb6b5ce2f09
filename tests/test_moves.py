"""Local moves against a plain scan: the modularity never falls, and nothing is left to gain."""

import numpy as np
import pytest

from threadlake.operators import graph


def modularity(edges, comm, resolution=1.0):
    total = 2 * sum(w for _, _, w in edges)
    inside, degree = 0.0, {}
    for a, b, w in edges:
        inside += 2 * w * (comm[a] == comm[b])
        for n in (a, b):
            degree[comm[n]] = degree.get(comm[n], 0) + w
    return inside / total - resolution * sum((d / total) ** 2 for d in degree.values())


def best_gain(edges, comm, resolution=1.0):
    """The most that one move of a node to a neighbour's community gains, by trying all."""
    now, best = modularity(edges, comm, resolution), 0.0
    for a, b, _ in edges:
        for x, y in ((a, b), (b, a)):
            if comm[x] != comm[y]:
                best = max(best, modularity(edges, comm | {x: comm[y]}, resolution) - now)
    return best


def plain_scan(edges, resolution=1.0):
    """Nodes one after another in their order, each to the community of most gain, until none moves."""
    near, degree = {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = near.setdefault(x, {}).get(y, 0) + w
            degree[x] = degree.get(x, 0) + w
    total, comm, moved = sum(degree.values()), {n: n for n in degree}, True
    while moved:
        moved = False
        for n in sorted(near):
            sums = {}
            for x, w in near[n].items():
                sums[comm[x]] = sums.get(comm[x], 0) + w
            worth = lambda c: sums.get(c, 0) / total - resolution * degree[n] * sum(degree[x] for x in degree if comm[x] == c and x != n) / total**2  # noqa: B023, E731
            c = max(sums, key=lambda c: (worth(c), -c))
            if c != comm[n] and worth(c) > 0 and worth(c) - worth(comm[n]) > 1e-12:
                comm[n], moved = c, True
    return comm


def planted(seed, groups=4, size=8):
    rng = np.random.default_rng(seed)
    n = groups * size
    return [(i, j, float(rng.integers(1, 5))) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.7 if i // size == j // size else 0.06)]


@pytest.mark.parametrize("seed,resolution,steps", [(0, 1.0, (1, 3, 100)), (1, 1.6, (100,))])
def test_modularity_never_falls(spark, seed, resolution, steps):
    edges = planted(seed)
    df = spark.createDataFrame(edges, "a long, b long, w double")
    before = modularity(edges, {n: n for e in edges for n in e[:2]}, resolution)
    for rounds in steps:
        comm = {r["node"]: r["comm"] for r in graph.local_moves(df, resolution, rounds).collect()}
        now = modularity(edges, comm, resolution)
        assert now >= before - 1e-12
        before = now
    assert best_gain(edges, comm, resolution) <= 1e-9
    assert now >= 0.9 * modularity(edges, plain_scan(edges, resolution), resolution)


def test_clear_communities(spark):
    """Two triangles with a weak link, parallel and doubled edges, a loop, a star with a hub: as a plain scan finds them."""
    edges = [(1, 2, 0.9), (1, 3, 0.9), (2, 3, 0.9), (4, 5, 0.9), (4, 6, 0.9), (5, 6, 0.9), (3, 4, 0.1)] + [(100, 100 + i, 1.0) for i in range(1, 12)]
    rows = edges + [(7, 7, 5.0)]
    comm = {r["node"]: r["comm"] for r in graph.local_moves(spark.createDataFrame([*rows, (2, 1, 0.05), (1, 2, -0.0)], "a long, b long, w double")).collect()}
    assert comm == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4} | {100 + i: 100 for i in range(12)}
    assert comm == {n: min(x for x, c in plain_scan(edges).items() if c == own) for n, own in plain_scan(edges).items()}


def test_no_edges(spark):
    assert graph.local_moves(spark.createDataFrame([], "a long, b long, w double")).count() == 0
    assert graph.local_moves(spark.createDataFrame([(1, 1, 1.0)], "a long, b long, w double")).count() == 0


def test_near_neighbours_make_communities(spark):
    """The registered query: nothing is left to gain, and sizes count members."""
    from threadlake.plans import graphs

    sf = "/root/testdata/sf0.001"
    got = graphs.local_moves(spark, sf).collect()
    edges = [(r["a"], r["b"], r["w"]) for r in graphs.neighbour_edges(spark, sf).collect()]
    comm = {r["node"]: r["comm"] for r in got}
    assert set(comm) == {n for e in edges for n in e[:2]}
    assert all(r["size"] == sum(c == r["comm"] for c in comm.values()) and comm[r["comm"]] == r["comm"] for r in got)
    assert modularity(edges, comm) >= 0.95 * modularity(edges, plain_scan(edges))
