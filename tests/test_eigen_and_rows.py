"""Distributed eigenpairs and row-side steps against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import eigen, fit


def chains(lengths, seed=5):
    """Stiffness and mass of separate chains: (entries, component of each vertex, dense pair)."""
    rng = np.random.default_rng(seed)
    n = sum(lengths)
    a, m, comp, at = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n, int), 0
    for c, k in enumerate(lengths):
        comp[at : at + k] = c
        for i in range(at, at + k - 1):
            w, h = rng.uniform(0.5, 2), rng.uniform(0.5, 1.5)
            a[i : i + 2, i : i + 2] += w / h * np.array([[1, -1], [-1, 1]])
            m[i : i + 2, i : i + 2] += h / 6 * np.array([[2, 1], [1, 2]])
        at += k
    i, j = np.nonzero((a != 0) | (m != 0))
    return list(zip(i.tolist(), j.tolist(), a[i, j].tolist(), m[i, j].tolist(), strict=True)), comp, a, m


def dense(a, m):
    low = np.linalg.inv(np.linalg.cholesky(m))
    values, q = np.linalg.eigh(low @ a @ low.T)
    return values, low.T @ q


def test_lowest_pairs_match_dense(spark):
    rows, comp, a, m = chains([16, 10, 2])
    entries = spark.createDataFrame(rows, "row int, col int, a double, m double").repartition(3)
    vertices = spark.createDataFrame(list(enumerate(comp.tolist())), "vertex_id int, component int")
    values, vectors = eigen.lowest(entries, vertices, {0: 3, 1: 2, 2: 5}, tol=1e-9)
    table = vectors.collect()
    for c, n in ((0, 3), (1, 2), (2, 2)):
        own = np.flatnonzero(comp == c)
        ac, mc = a[np.ix_(own, own)], m[np.ix_(own, own)]
        want, _ = dense(ac, mc)
        assert values[c] == pytest.approx(want[:n], abs=1e-6)
        x = np.zeros((len(own), n))
        for r in table:
            if r["component"] == c:
                x[r["vertex_id"] - own[0], r["mode"]] = r["psi"]
        assert np.allclose(x.T @ mc @ x, np.eye(n), atol=1e-8) and np.allclose(ac @ x, mc @ x * values[c], atol=1e-3)
    assert len(table) == 16 * 3 + 10 * 2 + 2 * 2


def test_deflated_and_stratified(spark):
    rows, comp, a, m = chains([12, 8], seed=6)
    entries = spark.createDataFrame(rows, "row long, col long, a double, m double")
    whole = [dense(a[np.ix_(o, o)], m[np.ix_(o, o)]) for o in (np.arange(12), np.arange(12, 20))]
    # the constant and the first mode of each piece are known; what is found next is the third
    known = [[1.0, float(whole[c][1][v - (12 if c else 0), 1])] for v, c in enumerate(comp.tolist())]
    vertices = spark.createDataFrame([(v, c, known[v], 2.0 if c == 0 else 1.0) for v, c in enumerate(comp.tolist())], "vertex_id long, component long, known array<double>, weight double")
    values, _ = eigen.lowest(entries, vertices, 2, known="known", tol=1e-8)
    assert values[0] == pytest.approx(whole[0][0][2:4], abs=1e-6) and values[1] == pytest.approx(whole[1][0][2:4], abs=1e-6)
    values, vectors = eigen.stratified(entries, vertices, "weight", 5, tol=1e-7)
    assert {c: len(v) for c, v in values.items()} == {0: 4, 1: 1} and values[1] == pytest.approx([0.0], abs=1e-7)
    assert eigen.lowest(entries, vertices, {7: 2})[0] == {} and eigen.lowest(entries.limit(0), vertices.limit(0), 2)[1].count() == 0
    with pytest.raises(RuntimeError, match="2 rounds"):
        eigen.lowest(entries, vertices, 2, rounds=2, tol=0.0)


def test_ritz_survives_dependent_directions():
    rng = np.random.default_rng(1)
    s = rng.normal(size=(12, 4))
    s = np.concatenate([s, s[:, :2] @ rng.normal(size=(2, 3)), np.zeros((12, 1))], 1)
    a = np.diag(np.arange(12.0))
    values, q = eigen.ritz(s.T @ a @ s, s.T @ s, 0, 4)
    basis = np.linalg.qr(s[:, :4])[0]
    assert values == pytest.approx(np.linalg.eigvalsh(basis.T @ a @ basis)) and np.allclose((s @ q).T @ (s @ q), np.eye(4), atol=1e-6)
    _, q = eigen.ritz(s.T @ a @ s, s.T @ s, 2, 2)
    assert np.allclose((s @ q).T @ s[:, :2], 0, atol=1e-8)


def test_row_side_equals_parameter_side(spark, monkeypatch):
    monkeypatch.setattr(fit, "TILE_ROWS", 7)
    net = fit.Network(2, 2, 5, 1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(23, 2))
    df = spark.createDataFrame([(k, *map(float, v), float(np.sin(v[0])), float(v[1])) for k, v in enumerate(x)], "k long, a double, b double, s double, p double").repartition(4)
    flat, names = net.init(3), (["a", "b"], ["s", "p"])
    y, jac = net.jacobian(flat, x)
    jac = jac.reshape(-1, net.size)
    r = (y - np.c_[np.sin(x[:, 0]), x[:, 1]]).ravel()
    assert len(r) < net.size
    blocks, tiles = fit.row_tiles(df, net, flat, *names, "k")
    got = {(t["b"], t["c"]): np.frombuffer(t["tile"]) for t in tiles.collect()}
    assert set(got) == {(b, c) for b in range(4) for c in range(b + 1)} and blocks.count() == 4
    assert got[3, 1] == pytest.approx((jac[42:46] @ jac[14:28].T).ravel())
    want = fit.rowspace_direction(jac, r / 2, 1e-6)
    assert fit.direction(df, net, flat, *names, "k") == pytest.approx(want, abs=1e-6)
    g, v, total, n = fit.normal_equations(df, net, flat, *names)
    assert g == pytest.approx(jac.T @ jac) and v == pytest.approx(jac.T @ r) and total == pytest.approx(r @ r) and n == 23
    assert fit.step_by_rows(df.filter(F.lit(False)), net, flat, *names, "k", 1e-6) == pytest.approx(np.zeros(net.size))
    with pytest.raises(ValueError, match="46 residuals"):
        fit.step_by_rows(df, net, flat, *names, "k", 1e-6, most_rows=45)
    few = net.size * 3
    many = spark.range(few).select(F.col("id").alias("k"), F.sin("id").alias("a"), F.cos("id").alias("b"), F.sin(F.col("id") * 3).alias("s"), F.lit(0.5).alias("p"))
    g, v, _, _ = fit.normal_equations(many, net, flat, *names)
    assert fit.direction(many, net, flat, *names, "k") == pytest.approx(fit.damped_direction(g, v, 1e-6))
