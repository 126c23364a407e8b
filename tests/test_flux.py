"""Flux, storage and loads against figures by hand and plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import fluids
from terrane.operators import flux

T = fluids.Tables(
    swof={"sw": [0.2, 1.0], "krw": [0.0, 1.0], "krow": [1.0, 0.0], "pcow": [0.0, 0.0]}, sgof={"sg": [0.0, 0.8], "krg": [0.0, 1.0], "krog": [1.0, 0.0], "pcgo": [0.0, 0.0]},
    pvdg={"p": [100.0, 6000.0], "fvf": [1.0, 1.0], "visc": [1.0, 1.0]}, pvto={"rs": [0.0, 1.0], "p": [15.0, 4000.0], "fvf": [1.0, 1.0], "visc": [1.0, 1.0]}, pvtw={"p": 3000.0, "fvf": 1.0, "compr": 0.0, "visc": 1.0},
)
FIELDS = "t long, vertex_id long, " + ", ".join(f"{c} double" for c in (*flux.GATHERED[:6], "du_w", "du_o", "du_g", "f_x"))


def box(x, y, z, dx=1.0, dy=1.0, dz=1.0):
    return [v for s in range(8) for v in (x + dx * (s & 1), y + dy * (s >> 1 & 1), z + dz * (s >> 2))]


def two_cells(spark):
    v = lambda i: [i + (s & 1) + 3 * (s >> 1 & 1) + 6 * (s >> 2) for s in range(8)]
    return spark.createDataFrame([(0, box(0, 0, 0), v(0), 2.0, 1.0, 1.0), (1, box(1, 0, 0), v(1), 2.0, None, 1.0)], "cell_id long, corners array<double>, v array<long>, kx double, ky double, kz double")


def test_linear_potential_flows_from_end_to_end(spark):
    rows = [(0, v, *[100.0 * (v % 3)] * 3, 0.5, 0.25, 1.0, 0.0, 0.0, 3.0, 0.1) for v in range(12)]
    got = {r["vertex_id"]: (r["r_w"], r["r_o"], r["r_g"]) for r in flux.element_parts(two_cells(spark), spark.createDataFrame(rows, FIELDS), "t").collect()}
    for v in range(12):
        # a face of area 1 dealt to four vertices: -k f grad; what stands between two cells cancels
        sign = {0: -1, 1: 0, 2: 1}[v % 3] / 4
        stored = flux.BARREL * 3.0 * (1 if v % 3 != 1 else 2) / 8
        assert got[v] == pytest.approx((200 * 0.5 * sign, 200 * 0.25 * sign, 200 * (1.0 + 0.1) * sign + stored))


def test_lumped_storage_and_missing_states(spark):
    rows = [(t, v, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, float(v), 0.0, 0.0, 0.0) for t in (0, 1) for v in range(12) if not (t == 1 and v == 11)]
    rows[0] = (*rows[0][:8], None, 0.0, 0.0, 0.0)
    got = {(r["t"], r["vertex_id"]): r["r_w"] for r in flux.element_parts(two_cells(spark), spark.createDataFrame(rows, FIELDS), "t", consistent=False).collect()}
    assert set(got) == {(0, v) for v in (2, 5, 8, 11)} | {(1, v) for v in range(12) if v % 3 < 2}  # vertex 0 has no rate in slice 0; vertex 11 no state in slice 1
    assert got[1, 3] == pytest.approx(flux.BARREL * 3 / 8) and got[0, 2] == pytest.approx(flux.BARREL * 2 / 8)


def test_donors_are_upstream():
    phi, f = np.array([[0.0, 0, 0, 0, 50, 50, 50, 50], [3.0] * 8]), np.array([[1.0, 1, 1, 1, 3, 3, 3, 3], [0, 1, 2, 3, 4, 5, 6, 7.0]])
    assert flux.donor_mobility(phi, f) == pytest.approx([3.0, 3.5])
    assert flux.donor_mobility(phi, f, 0.0) == pytest.approx([2.0, 3.5])
    assert np.isfinite(flux.donor_mobility(np.array([[0.0] * 7 + [1e6]]), f[:1])).all()


def test_balance_and_projection(spark):
    states = [(t, v, 1000.0 + 10 * (v % 3) * t, 0.4, 0.1, 0.5, 0.0, 0.3) for t in (0, 1, 2) for v in range(12)]
    df = spark.createDataFrame(states, "t long, vertex_id long, pressure double, swat double, sgas double, rs double, z double, poro double")
    terms = flux.vertex_terms(df, T, {"w": 60.0, "o": 50.0, "g": 0.1}, 0.0, "z", "poro", 0.0, 1000.0)
    shares = spark.createDataFrame([(4, 1, 0.5), (7, 1, 0.5), (7, 2, None)], "vertex_id long, perf_no int, share double")
    rates = spark.createDataFrame([(1, 1, 8.0, 4.0, 2.0), (1, 2, 8.0, 4.0, 2.0)], "t long, perf_no int, q_w double, q_o double, q_g double")
    cells = two_cells(spark)
    rows = flux.nodal_balance(cells, terms, flux.loads(shares, rates, "t"), "t")
    got = {(r["t"], r["vertex_id"]): r for r in rows.collect()}
    assert {t for t, _ in got} == {1, 2} and len(got) == 24
    kw, kg = 0.25, 0.125
    ko = (0.75 + kw) * (0.875 + kg) - (kw + kg)
    for t in (1, 2):
        for v in range(12):
            flow = {0: -5.0, 1: 0.0, 2: 5.0}[v % 3] * t  # kx 2 x 10 t / 4
            q = 4.0 if t == 1 and v in (4, 7) else 0.0
            w, o, g = kw * flow - q, ko * flow - q / 2, (kg + 0.5 * ko) * flow - q / 4
            assert (got[t, v]["r_p"], got[t, v]["r_w"], got[t, v]["r_g"]) == pytest.approx((w + 0.5 * o + g, w, g - 0.5 * o))
    basis = spark.createDataFrame([(v, m, float((-1) ** v if m else v)) for v in range(12) for m in (0, 1)], "vertex_id long, mode int, psi double")
    mu = spark.createDataFrame([(0, 4.0), (1, 9.0)], "mode int, mu double")
    weights = flux.node_weights(spark.createDataFrame([(v, float(v % 2)) for v in range(12)], "vertex_id long, envelope double"), "wells", 3.0)
    galerkin = {(r["t"], r["mode"]): r["r_w"] for r in flux.project(rows, basis, mu, "t").collect()}
    norms = {(r["t"], r["mode"]): r["r_w"] for r in flux.project(rows, basis, mu, "t", "blocknorm", weights).collect()}
    for t, m, root in ((1, 0, 2.0), (2, 1, 3.0)):
        psi = lambda v: (-1) ** v if m else v  # noqa: B023, E731
        assert galerkin[t, m] == pytest.approx(root * sum(psi(v) * got[t, v]["r_w"] for v in range(12)))
        assert norms[t, m] == pytest.approx(root * sum(abs(psi(v)) * (1 + 3 * (v % 2)) * got[t, v]["r_w"] ** 2 for v in range(12)) ** 0.5)
    long = flux.term_rows(flux.project(rows, basis, mu, "t"), ["t", "mode"], (1.0, 2.0, 4.0))
    assert long.count() == 12 and long.filter("channel = 'r_w' AND t = 1 AND mode = 0").first()["residual"] == pytest.approx(galerkin[1, 0] / 2)
    assert rows.filter(F.lit(False)).count() == 0 and flux.nodal_balance(cells.limit(0), terms, flux.loads(shares, rates, "t"), "t").count() == 0
    for call in (lambda: flux.project(rows, basis, mu, "t", "other"), lambda: flux.node_weights(df, "other")):
        with pytest.raises(ValueError, match="other"):
            call()
    volumes = spark.createDataFrame([(0, 1.0), (1, 3.0)], "vertex_id long, volume double")
    assert [r["weight"] for r in flux.node_weights(volumes, "volume").orderBy("vertex_id").collect()] == [0.5, 1.5] and flux.node_weights(volumes).first()["weight"] == 1.0
