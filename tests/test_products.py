"""Matrix products as a sieve of near pairs: nothing near is passed over, whatever the numbers; cells are few where vectors are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.operators import clusters


def odd_sides(kind):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 16)), rng.normal(size=(80, 16))
    b[:20] = a[:20]
    b[20:40] = a[20:40] + rng.normal(size=(20, 16)) * 1e-9
    if kind == "far":
        a, b = a + 1e8, b + 1e8
    elif kind == "outlier":
        b[7] = 1e300
    elif kind == "huge":
        a[0], b[0] = 1.7e308, -1.7e308
    elif kind == "tiny":
        a, b = a * 1e-200, b * 1e-200
    elif kind == "equal":
        a, b = np.ones(a.shape), np.ones(b.shape)
    return a, b


@pytest.mark.parametrize("kind", ["plain", "far", "outlier", "huge", "tiny", "equal"])
def test_nothing_near_is_passed_over(kind):
    a, b = odd_sides(kind)
    with np.errstate(over="ignore"):
        d = clusters.distances(a, b)
    i, j = np.indices(d.shape).reshape(2, -1)
    assert (clusters.apart(a, i, b, j).reshape(d.shape) == d).all()
    p = clusters.Products(a, b)
    squares = p.squares(slice(0, 60), slice(0, 80))
    for reach in [0.0, *np.quantile(d[np.isfinite(d)], [0.01, 0.1, 0.5, 1]).tolist()]:
        assert (squares <= p.limit(reach))[d <= reach].all()
        assert (d[squares <= p.within(reach)] <= reach).all()
    assert (p.reach(squares) >= d)[np.isfinite(d)].all()
    if kind == "plain":
        assert (squares <= p.limit(1.0)).sum() < 60


def test_edge_forest():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 70, size=(2, 400))
    up, want = list(range(90)), []
    for e, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        if up[u] != up[v]:
            want.append(e)
            up = [up[u] if z == up[v] else z for z in up]
    assert clusters.edge_forest(x, y, 90).tolist() == want
    assert clusters.edge_forest(x[:0], y[:0], 0).tolist() == []


def test_a_block_of_vectors_is_one_cell(spark):
    """Vectors that one block holds are not sent to several cells, as each was to five before."""
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([("", i, 1, x) for i, x in enumerate(rng.normal(size=(3000, 8)).tolist())], clusters.POINT)
    cells = clusters.Cells(v)
    assert cells.visitors(cells.rows.withColumn("reach", F.lit(1e9))).count() == 0
