import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import aggregates, cells, fem, fit, layout, mesh, wells, windows
from terrane.sources import deck, ecl_source, text_sinks


def _grid_file(path, nx, ny, nz, act=None):
    """A box grid, cells 10 x 20 x 5, tops at 1000."""
    coord = np.array([[10 * i, 20 * j, 1000, 10 * i, 20 * j, 1000 + 5 * nz] for j in range(ny + 1) for i in range(nx + 1)], float).ravel()
    z = np.array([1000 + 5 * ((kk + 1) // 2) for kk in range(2 * nz) for _ in range(4 * nx * ny)], float)
    raw = ecl_source.encoded("GRIDHEAD", "INTE", [1, nx, ny, nz]) + ecl_source.encoded("COORD", "REAL", coord) + ecl_source.encoded("ZCORN", "REAL", z)
    path.write_bytes(raw + (ecl_source.encoded("ACTNUM", "INTE", act) if act is not None else b""))


def test_grid_and_initial_files(spark, tmp_path):
    nx, ny, nz = 3, 2, 2
    act = [1] * 12
    act[4] = 0
    grid, init = tmp_path / "G.EGRID", tmp_path / "G.INIT"
    _grid_file(grid, nx, ny, nz, act)
    init.write_bytes(ecl_source.encoded("PORV", "REAL", np.arange(12.0)) + ecl_source.encoded("PORO", "REAL", np.arange(11) / 10))
    assert ecl_source.dimensions(spark, str(grid)) == (3, 2, 2)
    corners = layout.pillar_corners(ecl_source.pillars(spark, str(grid)), ecl_source.corner_depths(spark, str(grid)))
    g = cells.grid(spark, nx, ny, nz).select("cell_id", (F.col("i") * 10.0).alias("x0"), (F.col("j") * 20.0).alias("y0"), (1000 + F.col("k") * 5.0).alias("z0"), F.lit(10.0).alias("dx"), F.lit(20.0).alias("dy"), F.lit(5.0).alias("dz"))
    assert sorted(map(tuple, corners.collect())) == sorted(map(tuple, cells.corner_points(g).collect()))
    got = {r["cell_id"]: (r["porv"], r["poro"]) for r in ecl_source.initial(spark, str(grid), str(init), ("PORV", "PORO")).collect()}
    assert len(got) == 11 and 4 not in got and got[3] == (3.0, pytest.approx(0.3)) and got[5] == (5.0, pytest.approx(0.4)) and got[11] == (11.0, pytest.approx(1.0))
    _grid_file(grid, nx, ny, nz)
    assert ecl_source.active_cells(spark, str(grid)).count() == 12


def test_dumps_are_read_back(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 30, 0.25).otherwise(F.col("id") / 8).alias("poro"), (F.col("id") % 2 == 0).alias("actnum"))
    text_sinks.dump_arrays(df.repartition(5), str(tmp_path / "inc"), ["poro", "actnum"], "id")
    parts = {a: [str(p) for p in (tmp_path / "inc" / f"attr={a}").glob("*.txt")] for a in ("PORO", "ACTNUM")}
    assert all(len(p) == 1 for p in parts.values())
    main = tmp_path / "M.DATA"
    main.write_text(text_sinks.main_deck("A MODEL", (10, 10, 1), "METRIC", "1 JAN 2020", {"GRID": [parts["PORO"][0], parts["ACTNUM"][0]]}))
    r = deck.read(spark, str(main)).cache()
    poro = [x["value"] for x in deck.array(r, "PORO").orderBy("pos").collect()]
    assert poro == [x["poro"] for x in df.orderBy("id").collect()]
    assert [x["value"] for x in deck.array(r, "ACTNUM").orderBy("pos").collect()] == [1.0, 0.0] * 50 and deck.unit_system(r).first()["unit_system"] == "METRIC"
    text_sinks.dump_tables({"rock": df}, str(tmp_path / "m"), only_active="actnum", single=True)
    back = text_sinks.load_tables(spark, str(tmp_path / "m"), ["rock"], ["id", "poro"])["rock"]
    assert back.count() == 50 and dict(back.dtypes) == {"id": "bigint", "poro": "float"}


def test_near_contacts_have_samples(spark):
    v = spark.createDataFrame([(n, 0, float(n), 0.0, 0.0) for n in range(8)] + [(100 + n, 1, n + 0.5, 0.0, 0.0) for n in range(7)] + [(200, 2, 50.0, 0.0, 0.0)], "vertex_id long, component int, x double, y double, z double")
    got = {(r["src"], r["dst"]): (r["n"], r["min_distance"], [tuple(s) for s in r["samples"]][:2], len(r["samples"])) for r in mesh.near_contacts(v, 0.6).collect()}
    assert got == {(0, 1): (8, 0.5, [(0, 100, 0.5), (1, 100, 0.5)], 5), (1, 0): (7, 0.5, [(100, 0, 0.5), (101, 1, 0.5)], 5)}


def test_sorted_ids_of_uneven_values(spark):
    df = spark.createDataFrame([(v,) for v in [*range(50), 1 << 50, (1 << 50) + 7, -5]], "v long")
    got = {r["v"]: r["n"] for r in windows.sorted_ids(df.unionByName(df), ["v"], "n").collect()}
    assert got == {v: n for n, v in enumerate(sorted(got))} and len(got) == 53


def test_exact_quantiles(spark):
    rows = [("a", 1.0)] * 7 + [("a", 2.0), ("a", 9.0), ("b", 5.0), ("c", None), ("d", 1.0), ("d", 2.0)]
    got = {r["k"]: (r["p"], r["q"], r["top"]) for r in aggregates.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p": 0.5, "q": 0.95}).collect()}
    a = [1.0] * 7 + [2.0, 9.0]
    assert got == {"a": (1.0, pytest.approx(np.quantile(a, 0.95)), 9.0), "b": (5.0, 5.0, 5.0), "d": (1.5, pytest.approx(1.95), 2.0)}


NET = fit.Network(2, 2, 4, 2)


def test_tangent_and_row_space():
    rng = np.random.default_rng(5)
    flat, x, dx = NET.init(1), rng.standard_normal((6, 2)), rng.standard_normal((6, 2))
    y, dy = NET.tangent(flat, x, dx)
    assert np.allclose(y, NET.forward(flat, x)[0])
    assert np.allclose(dy, (NET.forward(flat, x + 1e-6 * dx)[0] - NET.forward(flat, x - 1e-6 * dx)[0]) / 2e-6, atol=1e-7)
    j, r = rng.standard_normal((5, 9)), rng.standard_normal(5)
    d = fit.rowspace_direction(j, r, 0.0)
    assert np.allclose(j @ d, 2 * r) and np.allclose(d, np.linalg.pinv(j) @ (2 * r))
    assert np.allclose(j @ fit.rowspace_direction(j, r, 0.0, shift=r), r)


def test_adam_then_gauss_newton(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(np.sin(a) * b), float(a * b)) for a, b in rng.standard_normal((150, 2))]
    df = spark.createDataFrame(rows, "a double, b double, s double, p double").repartition(3).cache()
    grad, loss = fit.gradient(df, NET, NET.init(4), ["a", "b"], ["s", "p"])
    _, v, total, n = fit.normal_equations(df, NET, NET.init(4), ["a", "b"], ["s", "p"])
    assert np.allclose(grad, 2 * v / n) and loss == pytest.approx(total / n)
    seen = list(fit.scheduled(df, NET, ["a", "b"], ["s", "p"], [fit.Phase("adam", 6, 1e-2, 1e-3), fit.Phase("gauss_newton", 3)], seed=4))
    assert [m for _, m, _, _ in seen] == ["adam"] * 6 + ["gauss_newton"] * 3 and seen[5][2] < seen[0][2] and seen[-1][2] < seen[5][2]
    p = fit.Phase("adam", 3, 1e-2, 1e-4)
    assert [p.rate_at(k) for k in range(3)] == pytest.approx([1e-2, 1e-3, 1e-4])
    out = fit.predict_with_rate(df.withColumns({"u": F.lit(0.0), "w": F.lit(1.0)}), NET, seen[-1][3], ["a", "b"], ["u", "w"], ["a"])
    assert out.columns == ["a", "y", "dy"] and len(out.first()["dy"]) == 2
    with pytest.raises(ValueError):
        list(fit.scheduled(df, NET, ["a", "b"], ["s", "p"], [fit.Phase("other", 1)]))


def test_peaceman_in_the_wells_frame(spark):
    iso, tilted = [100.0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0, 10.0], [100.0, 20.0, 5.0, 20.0, 50.0, 3.0, 5.0, 3.0, 10.0]
    rows = [(0, iso, 0.0, 0.0, 1.0, 100.0, 100.0, 10.0, 0.25, 0.0), (1, tilted, 1.0, 2.0, 0.5, 80.0, 60.0, 10.0, 0.3, 1.5), (2, [-1.0 * v for v in iso], 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.1, 0.0), (3, iso, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, k array<double>, tx double, ty double, tz double, hx double, hy double, hz double, r_w double, skin double")
    got = {r["id"]: r for r in wells.peaceman(df, ["id"]).collect()}
    r_e = 0.28 * np.sqrt(2 * 100.0**2) / 2
    assert got[0]["r_e"] == pytest.approx(r_e) and got[0]["wi"] == pytest.approx(2 * np.pi * 10 * 100 / np.log(r_e / 0.25)) and got[0]["why"] is None
    assert got[2]["wi"] is None and got[2]["why"] == "not positive definite" and got[3]["why"] == "radius within the well"
    t = np.array([1.0, 2.0, 0.5]) / np.linalg.norm([1.0, 2.0, 0.5])
    basis = np.linalg.svd(np.eye(3) - np.outer(t, t))[0][:, :2]  # any frame across the well
    low, vec = np.linalg.eigh(basis.T @ np.array(tilted).reshape(3, 3) @ basis)
    h1, h2 = np.abs((basis @ vec).T) @ np.array([80.0, 60.0, 10.0])
    q = np.sqrt(low[1] / low[0])
    want = 0.28 * np.sqrt(q * h1**2 + h2**2 / q) / (np.sqrt(q) + 1 / np.sqrt(q))
    h = np.abs(t) @ np.array([80.0, 60.0, 10.0])
    assert got[1]["r_e"] == pytest.approx(want) and got[1]["wi"] == pytest.approx(2 * np.pi * h * np.sqrt(low.prod()) / (np.log(want / 0.3) + 1.5))


def test_operators_without_assembly(spark):
    g = cells.grid(spark, 2, 2, 2).select("cell_id", (F.col("i") * 1.0).alias("x0"), (F.col("j") * 2.0).alias("y0"), (F.col("k") * 3.0).alias("z0"), F.lit(1.0).alias("dx"), F.lit(2.0).alias("dy"), F.lit(3.0).alias("dz"))
    corners = cells.corner_points(g)
    vertices, incidence = mesh.vertices_of(corners)
    box = corners.groupBy("cell_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.array("x", "y", "z").alias("p")))), lambda c: c["p"])).alias("corners"))
    ids = incidence.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "vertex_id"))), lambda c: c["vertex_id"]).alias("v"))
    box = box.join(ids, "cell_id").withColumns({"kx": F.lit(2.0), "ky": F.lit(3.0), "kz": F.lit(0.5)}).cache()
    nodal = vertices.select("vertex_id", (F.col("x") * 2 - F.col("y") + F.col("z") * 0.5 + 1).alias("x")).cache()
    bent = nodal.withColumn("x", F.sin(F.col("x") + F.col("vertex_id"))).cache()
    for kind in ("mass", "stiffness", "x"):
        a = fem.operator(box, kind)
        y = {r["row"]: r["y"] for r in aggregates.matvec(a, bent.withColumnRenamed("vertex_id", "col")).collect()}
        got = {r["vertex_id"]: r["y"] for r in fem.action(box, bent, kind).collect()}
        assert got.keys() == y.keys() and all(got[v] == pytest.approx(y[v], abs=1e-9) for v in y)
    parts = [fem.dense(fem.operator(box, k), 27) for k in "xyz"]
    assert np.allclose(sum(parts), fem.dense(fem.operator(box, "stiffness"), 27))
    grads = fem.centroid_gradients(box, nodal).collect()
    assert len(grads) == 8 and all((r["gx"], r["gy"], r["gz"]) == pytest.approx((2.0, -1.0, 0.5)) for r in grads)


def test_table_defaults_and_history_rates(spark, tmp_path):
    f = tmp_path / "T.DATA"
    f.write_text("RUNSPEC\nMETRIC\nSTART\n1 JAN 2020 /\nPROPS\nSWOF\n0.2 0 0.9 1*\n1 1 0 2 /\nROCK\n1* 1* /\nPVTG\n50 0.1 0.02 0.01\n 0.05 0.021 0.011 /\n100 0.2 0.01 0.02 /\n/\nSCHEDULE\nWCONHIST\nA OPEN WRAT 1 2 3 /\nB OPEN RESV 1* 5 3 /\nC OPEN BHP 1* 1* 90 /\n/\n")
    r = deck.read(spark, str(f)).cache()
    assert [x["pcow"] for x in deck.function_table(r, "SWOF", units="METRIC").orderBy("sw").collect()] == [0.0, 2.0]
    assert [x["pcow"] for x in deck.function_table(r, "SWOF").orderBy("sw").collect()] == [None, 2.0]
    assert tuple(deck.function_table(r, "ROCK", units="METRIC").first())[1:] == (1.0132, 4.934e-5)
    assert deck.function_table(r, "ROCK", units="FIELD").first()["p"] == pytest.approx(1.0132 * 14.6959)
    assert sorted((x["p"], x["fvf"]) for x in deck.dry_gas(deck.live_oil(r, "PVTG")).collect()) == [(50.0, 0.02), (100.0, 0.01)]
    c = {x["well"]: (x["rate"], x["bhpt"]) for x in deck.controls(r).collect()}
    assert c == {"A": (-2.0, None), "B": (-5.0, None), "C": (None, 90.0)}
    dates = spark.sql("SELECT timestamp_ntz'2020-01-05' AS t UNION ALL SELECT timestamp_ntz'2019-07-01'")
    assert [x["text"] for x in text_sinks.array_date_text(dates, "t").orderBy("line").collect()] == ["ARRAY DATE", "01 JUL 2019", "05 JAN 2020", "/"]
