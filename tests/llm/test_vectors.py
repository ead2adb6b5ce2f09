"""Vector operators against brute force in plain integers and fractions; odd rows."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from threadlake.llm import queries, vectorcode, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def odd_rows(dim=6, n=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [NAN] * dim), (103, [INF] + [0.0] * (dim - 1)), (104, [-INF] * dim), (105, []), (106, [1.0])]
    rows += [(5, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (107, [1e6] + [-1e6] * (dim - 1)), (108, [0.0] * dim), (109, [-0.0] * dim)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """Odd vectors, with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, x, 1, "s", None, 0.5) for i, x in odd_rows()], "vec_id long, embedding array<float>, n int, codes string, x int, error double")


def kept_rows(rows, dim):
    return [(i, x) for i, x in rows if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x)]


def brute_codes(rows, dim, parts=4, entries=256, rounds=4, scale=1024):
    wide = -(-dim // parts)
    whole = [(i, [math.floor(Fraction(float(np.float32(c))) * scale) for c in x] + [0] * (wide * parts - dim)) for i, x in rows]
    cut = lambda x, p: tuple(x[p * wide : (p + 1) * wide])
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x, p) for _, x in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, x in whole:
                groups.setdefault(best(cut(x, p), book)[1], []).append(cut(x, p))
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(book)]
    out = []
    for i, x in whole:
        found = [best(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, [k for _, k in found], sum(d for d, _ in found)))
    return books, out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("entries", [1, 16, 256])
def test_codes_of_odd_vectors(spark, odd, entries):
    model = vectorcode.fit(odd, entries=entries)
    books, want = brute_codes(kept_rows(odd_rows(), 6), 6, entries=entries)
    assert [[tuple(e) for e in b.tolist()] for b in model.books] == books
    assert model.sha256() == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    got = vectorcode.encode(odd, model)
    assert got.columns == ["vec_id", "codes", "error"]
    assert ordered((r["vec_id"], r["codes"], r["error"]) for r in got.collect()) == ordered(want)


def test_codes_do_not_depend_on_partitions(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = vectorcode.fit(v.repartition(7)), vectorcode.fit(v.coalesce(1))
    assert a.sha256() == b.sha256()
    coded = vectorcode.encode(v, a)
    back = {r["vec_id"]: r["embedding"] for r in vectorcode.decode(coded, a).collect()}
    for r, e in zip(v.orderBy("vec_id").collect(), coded.orderBy("vec_id").collect(), strict=True):
        assert len(back[r["vec_id"]]) == 64
        assert math.isclose(sum((math.floor(1024 * x) - 1024 * y) ** 2 for x, y in zip(r["embedding"], back[r["vec_id"]], strict=True)), e["error"], rel_tol=1e-9)


def test_no_vectors(spark, odd):
    for which in ("false", "embedding IS NULL", "vec_id IN (101, 102)"):
        assert vectorcode.encode(odd, vectorcode.fit(odd.where(which))).count() == 0
    empty = odd.where("vec_id = 105")
    assert [tuple(r) for r in vectorcode.encode(empty, vectorcode.fit(empty)).collect()] == [(105, [0, 0, 0, 0], 0)]


def test_equal_bounds_keep_the_lowest_index():
    """Points between two entries, boxes at equal distance, repeated entries, very large numbers."""
    rng = np.random.default_rng(1)
    for k in range(60):
        far = 1 if k % 3 else 1 << 40
        entries = rng.integers(-2, 3, size=(int(rng.integers(1, 90)), 3)) * far
        x = rng.integers(-3, 4, size=(50, 3)) * far
        who, d = vectorcode.nearest(vectorcode.kd_tree(entries), entries, x)
        for row, i, e in zip(x.tolist(), who.tolist(), d.tolist(), strict=True):
            want = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(entries.tolist()))
            assert (e, i) == want


def test_op13(spark):
    got = queries.QUERIES["op13_vector_codes"](spark, SF).toPandas().sort_values("vec_id").reset_index(drop=True)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = c.sql(queries.ORACLE["op13_vector_codes"]).df().sort_values("vec_id").reset_index(drop=True)
    assert got.equals(want[got.columns])
    books, rows = brute_codes([(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()], 64)
    assert [(r.vec_id, r.code, r.error) for r in got.itertuples()] == [(i, "".join(f"{k:02x}" for k in ks), e) for i, ks, e in sorted(rows)]


def exact_scatter(xs):
    """n, S and n X'X - SS' of whole-number vectors."""
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    return n, s, [[n * sum(x[i] * x[j] for x in xs) - s[i] * s[j] for j in range(d)] for i in range(d)]


def whole_rows(rows, dim, scale=64, offset=1_000_000):
    return [(i, tuple(math.floor(Fraction(float(np.float32(c))) * scale) + offset for c in x)) for i, x in kept_rows(rows, dim)]


def check_whitened(model, got, rows):
    """model and got (key, deviation, whitened) against plain integers; components by what they must fulfil."""
    n, s, m = exact_scatter(sorted({x for _, x in rows}))
    assert (model.n, model.sums) == (n, s)
    cov = np.array([[float(Fraction(a, n * n)) for a in r] for r in m])
    assert (model.covariance == cov).all()
    values = np.linalg.eigvalsh(cov)[::-1][: len(model.values)]
    assert np.allclose(model.values, values, rtol=1e-9, atol=1e-14 * values[0])
    values = model.values
    assert np.allclose(model.components.T @ model.components, np.eye(len(values)), atol=1e-12)
    assert np.allclose(cov @ model.components, model.components * model.values, atol=1e-9 * values[0])
    assert np.allclose(model.explained, values / np.trace(cov))
    want = []
    for i, x in rows:
        apart = [n * a - b for a, b in zip(x, s, strict=True)]
        want.append((i, sum(a * a for a in apart), np.array([float(Fraction(a, n)) for a in apart]) @ model.components / np.sqrt(model.values)))
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2]
        assert np.allclose(a[2], b[2], rtol=1e-9, atol=1e-9)
    once = {x: w for (_, x), (_, _, w) in zip(rows, want, strict=True)}
    z = np.array(list(once.values()))
    assert np.allclose(z.mean(axis=0), 0, atol=1e-6)
    assert abs(np.abs((z - z.mean(axis=0)).T @ (z - z.mean(axis=0)) / n - np.eye(z.shape[1])).max() - model.identity_error) < 1e-9
    assert model.identity_error < 1e-4


def test_whitening_of_odd_vectors(spark, odd):
    model = whitening.fit(odd.repartition(5))
    got = whitening.whiten(odd, model)
    assert got.columns == ["vec_id", "deviation", "whitened"]
    check_whitened(model, [(r[0], int(r[1]), r[2]) for r in got.collect()], whole_rows(odd_rows(), 6))


@pytest.mark.parametrize("far", [0, 1 << 17, 1 << 37, -(1 << 60)])
def test_scatter_of_any_size(spark, far):
    """Sums and products far beyond longs and doubles are exact: what all vectors share cancels."""
    rng = np.random.default_rng(5)
    xs = (rng.integers(-300, 300, size=(5000, 5)) + far).tolist() + [[far, -far, 0, 1, -1], [far, 5, far // 3, -far // 7, 2]]
    packed = spark.createDataFrame([(b,) for b in whitening.pack(np.array(xs, np.int64))], "x binary").repartition(6)
    n, s, m = whitening.scatter(packed, 5)
    assert (n, s, m) == exact_scatter(xs)


def test_eigen_of_graded_matrices():
    """Eigenvalues of very different size are right each by itself, also with ties and zeros."""
    rng = np.random.default_rng(2)
    for grades in ([1, 1, 1, 1], [1 << 40, 1, 1, 5, 0, 0], [1 << 60, 1 << 30, 1000, 7], [1 << 20, 3, 3, 3, 2, 1, 0]):
        d = len(grades)
        # a product of exact reflections by whole vectors: h'h * I - 2 h h' keeps angles
        q, size = np.eye(d, dtype=int).astype(object), 1
        for _ in range(2):
            h = rng.integers(-2, 3, size=d).astype(object)
            h[0] += 3
            q, size = q.dot(int(h.dot(h)) * np.eye(d, dtype=int).astype(object) - 2 * np.outer(h, h)), size * int(h.dot(h))
        exact = q.dot(np.diag(grades).astype(object)).dot(q.T).tolist()
        values, x = whitening.eigen(exact, size, d)
        assert np.allclose(values, sorted((g for g in grades if g), reverse=True), rtol=1e-12)
        for e, v in zip(values, x.T, strict=True):
            # the vector lies in the span of the columns of q that have this grade
            own = [i for i, g in enumerate(grades) if math.isclose(g, e, rel_tol=1e-9)]
            assert math.isclose(sum(float(q[:, i].astype(float).dot(v) / size) ** 2 for i in own), 1, rel_tol=1e-12)


def test_packed_rows():
    x = np.array([[0, 1], [-128, 127], [128, 0], [-129, 0], [1 << 15, 0], [1 << 31, -1], [-(1 << 62), 1 << 62]])
    import pyarrow as pa

    assert (whitening.unpack(pa.array(whitening.pack(x)), 2) == x).all()
    assert [len(b) for b in whitening.pack(x)] == [3, 3, 5, 5, 9, 17, 17]


def test_vectors_without_components(spark, odd):
    for which, n in (("false", 0), ("embedding IS NULL", 0), ("vec_id = 105", 1), ("vec_id IN (108, 109)", 1), ("vec_id = 3 OR vec_id IS NULL", 1)):
        model = whitening.fit(odd.where(which))
        assert (model.n, len(model.values), model.identity_error) == (n, 0, 0.0)
        assert all(r["whitened"] == [] and r["deviation"] == 0 for r in whitening.whiten(odd.where(which), model).collect())
    two = whitening.fit(odd.where("vec_id IN (1, 2, 108)"))
    assert two.n == 3 and len(two.values) == 2


def test_op11(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF).collect()
    rows = whole_rows([(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()], 64)
    model = whitening.fit(spark.read.parquet(f"{SF}/embeddings.parquet"))
    by = {}
    for r in sorted(got, key=lambda r: r["component"]):
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r["whitened"])
        assert (r["n"], r["explained"], r["identity_error"] < 1e-4) == (model.n, model.explained[r["component"] - 1], True)
    assert len(got) == 16 * len(rows)
    check_whitened(model, [(*k, w) for k, w in by.items()], rows)
