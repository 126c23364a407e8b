import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import cells, layout, spectral


def test_fault_faces_and_boxes(spark):
    f = spark.createDataFrame([("F1", 2, 1, 1, 1, 1, 2, "x-")], "name string, i1 int, i2 int, j1 int, j2 int, k1 int, k2 int, face string")
    got = layout.fault_faces(f).collect()
    assert sorted((r["i"], r["j"], r["k"]) for r in got) == [(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 1)] and got[0]["slots"] == [0, 2, 4, 6]
    box = f.select(F.lit(1).alias("aquifer"), F.lit(1).alias("i1"), F.lit(2).alias("i2"), F.lit(1).alias("j1"), F.lit(1).alias("j2"), F.lit(1).alias("k1"), F.lit(1).alias("k2"))
    assert sorted(r["cell_id"] for r in layout.in_boxes(cells.grid(spark, 3, 2, 2), box, "aquifer").collect()) == [0, 1]


def test_base_zero(spark):
    df = spark.createDataFrame([(1, 2), (3, 1)], "i int, j int")
    assert sorted((r["i"], r["j"]) for r in layout.base_zero(df, {"i": 3, "j": 2}).collect()) == [(0, 1), (2, 0)]
    with pytest.raises(ValueError):
        layout.base_zero(df, {"i": 2, "j": 2})


def test_frames_of_a_turned_cell(spark):
    a = 0.3
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    box = np.array([[i * 2.0, j * 3.0, k * 4.0] for k in (0, 1) for j in (0, 1) for i in (0, 1)]) @ turn.T
    r = layout.local_frames(spark.createDataFrame([(0, box.ravel().tolist())], "cell_id long, corners array<double>")).first()
    assert np.allclose([r["lx"], r["ly"], r["lz"]], [2, 3, 4]) and np.allclose(np.array(r["frame"]).reshape(3, 3), turn.T)


def test_greedy_track(spark):
    rows = [("W", 1, 0.0, 0.0, 5.0), ("W", 2, 0.0, 0.0, 1.0), ("W", 3, 0.0, 0.0, 3.0), ("V", 4, 0.0, 0.0, 0.0)]
    got = layout.greedy_track(spark.createDataFrame(rows, "well string, cell_id long, x double, y double, z double")).filter("well = 'W'").orderBy("place").collect()
    assert [r["cell_id"] for r in got] == [2, 3, 1]


def test_no_flow_faces_and_pillars(spark):
    g = cells.grid(spark, 2, 1, 1).select("cell_id", (F.col("i") * 10.0 + 5).alias("cx"), F.lit(5.0).alias("cy"), F.lit(5.0).alias("cz"), *[F.lit(10.0).alias(f"l{a}") for a in "xyz"])
    assert cells.no_flow_faces(g).count() == 10
    p = spark.createDataFrame([(i, j, 10.0 * i, 10.0 * j, 0.0, 10.0 * i + 10, 10.0 * j, 100.0) for i in (0, 1) for j in (0, 1)], "pi int, pj int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    d = spark.createDataFrame([(0, 0, 0, s, 50.0 if s < 4 else 100.0) for s in range(8)], "cell_id long, i int, j int, slot int, z double")
    got = {r["slot"]: (r["x"], r["y"], r["z"]) for r in layout.pillar_corners(p, d).collect()}
    assert got[0] == (5.0, 0.0, 50.0) and got[7] == (20.0, 10.0, 100.0)
    one = spark.range(1).select(*[c.alias(n) for c, n in zip(layout.map_axes(F.lit(1.0), F.lit(2.0), [0, 10, 0, 0, 10, 0]), "xy", strict=True)]).first()
    assert (one["x"], one["y"]) == (1.0, 2.0)


def test_modes():
    assert spectral.allocate_modes([0.36, 0.33, 0.31], 11) == [4, 4, 3] and spectral.allocate_modes([36, 33, 31], 11) == [4, 4, 3]
    with pytest.raises(ValueError):
        spectral.allocate_modes([0.5, 0.3, 0.2], 2)
    assert spectral.allocate_modes([0.7, 0.2, 0.1], 10) == [7, 2, 1] and sum(spectral.allocate_modes([0.98, 0.01, 0.01], 10)) == 10
    v, up = np.arange(8.0), np.array([0, 0, 0, 0, 0.9, 0, 0.8, 0])
    assert spectral.retained(v, up, 4, 2) == [4, 6, 0, 1] and spectral.reserve(4, 16) == 2
    x = np.random.default_rng(0).standard_normal((40, 3))
    assert spectral.adequate(x, 1e-6) == (True, 40) and spectral.least_width(np.c_[np.zeros(40), x], 1e-6) == 2
