import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import fluids, scalars, units
from terrane.operators import cells, fem, fit, graph, mesh, temporal, wells
from terrane.sources import deck, ecl_source
from terrane.streaming import messages

DATA = Path(__file__).parent / "data"


@pytest.fixture(scope="module")
def records(spark):
    return deck.read(spark, str(DATA / "SMALL.DATA")).cache()


def test_deck_arrays_and_sections(records):
    poro = [r["value"] for r in deck.array(records, "PORO").orderBy("pos").collect()]
    assert poro == [0.1] * 4 + [0.2] * 4 + [0.3] * 4
    assert {r["section"] for r in records.filter("keyword = 'SWOF'").collect()} == {"PROPS"}
    assert deck.unit_system(records).first()["unit_system"] == "METRIC"
    assert deck.oil_model(records).first()["oil_model"] == "stone1"
    assert deck.deck_kind(records).first()["kind"] == "standard"
    assert records.filter("keyword = 'TITLE' AND record_no = 0").first()["tokens"] == ["two by two by three"]


def test_function_tables(records):
    t = [tuple(r)[1:] for r in deck.function_table(records, "SWOF").orderBy("sw").collect()]
    assert t == [(0.2, 0.0, 0.9, None), (0.6, 0.2, 0.3, 0.1), (1.0, 1.0, 0.0, 0.0)]
    live = [(r["rs"], r["p"], r["saturated"]) for r in deck.live_oil(records).orderBy("rs", "p").collect()]
    assert live == [(10.0, 50.0, True), (20.0, 100.0, True), (20.0, 200.0, False)]


def test_schedule_clock_and_controls(records):
    c = {r["source"]: r for r in deck.controls(records).collect()}
    start = dt.datetime(2020, 1, 1)
    assert c["WCONPROD"]["ts"] == start and (c["WCONPROD"]["well"], c["WCONPROD"]["rate"], c["WCONPROD"]["bhpt"]) == ("PROD", 120.0, 80.0)
    assert c["WELOPEN"]["ts"] == start + dt.timedelta(days=22) and c["WELOPEN"]["mode"] == "SHUT"
    assert c["WCONINJE"]["ts"] == dt.datetime(2020, 7, 1) and c["WCONINJE"]["rate"] == 300.0
    assert len(c) == 3


def test_completions_and_tree(records):
    k = deck.completions(records)
    assert sorted((r["well"], r["i"], r["j"], r["k"]) for r in k.collect()) == [("INJ", 2, 2, 1), ("PROD", 1, 2, 1), ("PROD", 1, 2, 2), ("PROD", 1, 2, 3)]
    assert {r["well"] for r in deck.open_blocks(k, F.lit(dt.datetime(2021, 1, 1)).cast("timestamp_ntz")).collect()} == {"PROD"}
    assert {(r["node"], r["parent"]) for r in deck.tree_parents(records).collect()} == {("G1", "FIELD"), ("PROD", "G1"), ("INJ", "G1")}
    rows = deck.keyword_rows(records, "WELSPECS")
    assert deck.wells_matching(rows, rows.limit(1).withColumn("well", F.lit("P*"))).first()["well"] == "PROD"


def test_resolved_controls(spark, records):
    days = [(w, dt.datetime(2020, 1, 1) + dt.timedelta(days=d)) for w in ("PROD", "INJ") for d in (0, 10, 30, 200)]
    report = spark.createDataFrame(days, "well string, ts timestamp_ntz")
    got = {(r["well"], (r["ts"] - dt.datetime(2020, 1, 1)).days): (r["kind"], r["rate"]) for r in wells.resolve_controls(report, deck.controls(records)).collect()}
    assert got[("PROD", 0)] == got[("PROD", 10)] == ("rate", -120.0) and got[("PROD", 30)][0] == "closed"
    assert got[("INJ", 30)] == (None, None) and got[("INJ", 200)] == ("rate", 300.0)


def test_boxes_from_deck_order(spark):
    g = cells.grid(spark, 2, 2, 3).withColumn("permx", F.lit(0.0))
    out = cells.apply_boxes(g, [cells.BoxStep("EQUALS", "permx", 100.0, {}), cells.BoxStep("MULTIPLY", "permx", 0.5, {"k": (1, 1)}), cells.BoxStep("ADD", "permx", 1.0, {"i": (0, 0), "k": (1, 2)})])
    got = {(r["i"], r["j"], r["k"]): r["permx"] for r in out.collect()}
    assert got[(0, 0, 0)] == 100 and got[(0, 1, 1)] == 51 and got[(1, 1, 1)] == 50 and got[(0, 0, 2)] == 101


def test_result_files(spark, tmp_path):
    path = tmp_path / "R.UNRST"
    raw = b""
    for s in range(2):
        raw += ecl_source.encoded("SEQNUM", "INTE", [s]) + ecl_source.encoded("PRESSURE", "REAL", np.arange(2500) + s) + ecl_source.encoded("SWAT", "REAL", np.full(2500, 0.25)) + ecl_source.encoded("ZWEL", "CHAR", ["PROD", "INJ"] * 100)
    path.write_bytes(raw)
    rows = ecl_source.states(spark, str(path), ("PRESSURE", "SWAT"))
    assert rows.count() == 5000 and rows.filter("step = 1 AND cell_id = 2499").first()["pressure"] == 2500.0
    assert ecl_source.read(spark, str(path), "ZWEL").first()["strings"][:3] == ["PROD", "INJ", "PROD"]
    path.write_bytes(raw[:-3])
    with pytest.raises(Exception, match="cut short"):
        ecl_source.read(spark, str(path)).collect()


@pytest.fixture(scope="module")
def small_mesh(spark):
    g = cells.grid(spark, 2, 2, 2).select("cell_id", (F.col("i") * 1.0).alias("x0"), (F.col("j") * 2.0).alias("y0"), (F.col("k") * 3.0).alias("z0"), F.lit(1.0).alias("dx"), F.lit(2.0).alias("dy"), F.lit(3.0).alias("dz"))
    corners = cells.corner_points(g)
    vertices, incidence = mesh.vertices_of(corners)
    box = corners.groupBy("cell_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.array("x", "y", "z").alias("p")))), lambda c: c["p"])).alias("corners"))
    ids = incidence.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "vertex_id"))), lambda c: c["vertex_id"]).alias("v"))
    return vertices.cache(), incidence.cache(), box.join(ids, "cell_id").withColumns({k: F.lit(2.0) for k in ("kx", "ky", "kz")}).cache()


def test_mesh_and_elements(spark, small_mesh):
    vertices, incidence, box = small_mesh
    assert vertices.count() == 27 and sorted(r["vertex_id"] for r in vertices.collect()) == list(range(27))
    assert mesh.reuse(incidence).first()["max_reuse"] == 8
    geo = fem.cell_geometry(box).collect()
    assert all(r["valid"] and abs(r["volume"] - 6.0) < 1e-9 for r in geo)
    mass, stiff = fem.operator(box, "mass").cache(), fem.operator(box, "stiffness").cache()
    assert abs(mass.agg(F.sum("val")).first()[0] - 48.0) < 1e-9
    rows = stiff.groupBy("row").agg(F.sum("val").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert rows < 1e-9  # a constant field has no flux
    assert mesh.null_modes(stiff) == 1
    a, m = fem.dense(stiff, 27), fem.dense(mass, 27)
    values, vectors = fem.eigenpairs(a, m, 4)
    assert values[0] < 1e-9 < values[1] and np.allclose(a @ vectors, m @ vectors * values, atol=1e-8)
    assert np.allclose(fem.subspace_eigenpairs(stiff, mass, 27, 3)[0], values[:3], atol=1e-5)
    keep = mesh.admissibility(incidence, spark.range(8).select(F.col("id").alias("cell_id"), F.lit(1.0).alias("pore_volume")), 0.5).collect()
    assert [(r["n_vertices"], r["share"], r["keep"]) for r in keep] == [(27, 1.0, True)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (7000, None)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50)) and got[5000] == 5000 and 7000 not in got


def test_fluid_closures(spark):
    t = fluids.Tables({"sw": [0.2, 0.6, 1.0], "krw": [0.0, 0.2, 1.0], "krow": [0.9, 0.3, 0.0], "pcow": [2.0, 1.0, 0.0]}, {"sg": [0.0, 0.5, 0.8], "krg": [0.0, 0.4, 0.9], "krog": [0.9, 0.2, 0.0]}, {"p": [100.0, 200.0], "fvf": [2.0, 1.0], "visc": [0.01, 0.02]}, {"rs": [0.0, 1.0], "fvf": [1.0, 1.5], "visc": [2.0, 1.0]}, {"p": 100.0, "fvf": 1.0, "compr": 1e-5, "visc": 0.3})
    df = spark.createDataFrame([(0.1, 0.0, 50.0), (0.4, 0.1, 150.0), (1.0, 0.0, 900.0), (0.3, 0.4, 120.0)], "sw double, sg double, p double")
    got = df.select(t.krw(F.col("sw")).alias("krw"), t.kro(F.col("sw"), F.col("sg"), "stone1").alias("k1"), t.kro(F.col("sw"), F.col("sg")).alias("k2"), t.bg(F.col("p")).alias("bg"), t.pcow(F.col("sw")).alias("pc"), t.kro_baker(F.col("sw"), F.col("sg")).alias("kb")).collect()
    assert [round(r["krw"], 9) for r in got] == [0.0, 0.1, 1.0, 0.05] and [r["bg"] for r in got] == [2.0, 1.5, 1.0, 1.8]
    assert all(0 <= r["k1"] <= 0.9 and 0 <= r["k2"] <= 0.9 and 0 <= r["kb"] <= 0.9 for r in got) and got[0]["k2"] == pytest.approx(0.9)
    two = df.filter("sg = 0").select(t.kro(F.col("sw"), F.col("sg"), "stone1").alias("a"), t.krow(F.col("sw")).alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in two)


def test_peaceman_tensor_and_allocation(spark):
    df = spark.createDataFrame([(100.0, 0.0, 100.0), (100.0, 20.0, 50.0), (1.0, 5.0, 1.0)], "a double, b double, c double")
    w = wells.tensor_index(F.col("a"), F.col("b"), F.col("c"), F.lit(100.0), F.lit(100.0), F.lit(10.0), F.lit(0.25), F.lit(0.0))
    got = df.select(*[v.alias(k) for k, v in w.items()]).collect()
    r_e = 0.28 * np.sqrt(2 * 100.0**2) / 2
    assert got[0]["r_e"] == pytest.approx(r_e) and got[0]["wi"] == pytest.approx(2 * np.pi * 10 * 100 / np.log(r_e / 0.25)) and got[2]["wi"] is None
    controlled = spark.createDataFrame([(1, "P", "rate", -90.0), (1, "Z", "rate", 0.0)], "report_step int, well string, kind string, rate double")
    perf = spark.createDataFrame([("P", 1, 2.0), ("P", 2, 1.0), ("Z", 3, 1.0)], "well string, perf_id int, wi double")
    assert sorted(r["q_perf"] for r in wells.split_rates(controlled, perf).collect()) == [-60.0, -30.0]


def test_gauss_newton(spark):
    net = fit.Network(2, 1, 4, 1)
    flat, x = net.init(3), np.random.default_rng(1).standard_normal((5, 2))
    y, jac = net.jacobian(flat, x)
    for k in range(0, net.size, 5):
        e = np.zeros(net.size)
        e[k] = 1e-6
        assert np.allclose((net.forward(flat + e, x)[0] - net.forward(flat - e, x)[0]) / 2e-6, jac[:, :, k], atol=1e-6)
    rows = [(float(a), float(b), float(np.sin(a) * b)) for a, b in np.random.default_rng(2).standard_normal((200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, t double").repartition(3).cache()
    seen = [loss for _, loss, _, _ in fit.fit(df, net, ["a", "b"], ["t"], 4)]
    assert seen == sorted(seen, reverse=True) and seen[-1] < 0.2


def test_messages_round_trip(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1, 0.1, 0.1, 0.2, 1.7, "prep")], "iteration int, total double, pde double, ic double, data double, well double, fraction double, stage string")
    timed = df.withColumn("took", F.lit(3.0))
    lo = messages.loss(timed, "took").first()
    assert (lo["iteration"], lo["total"], lo["well"]) == (1, 0.5, 0.2) and json.loads(lo["payload"]) == {"wall_s": 3.0, "eta": None}
    s = messages.stage(df, "stage", "fraction", "stage")
    assert s.first()["total"] == 1.0 and json.loads(s.first()["payload"]) == {"stage": "prep", "message": "prep"}
    assert messages.parse(s, "stage string").first()["body"]["stage"] == "prep"
    assert messages.message(df, "grid").first()["payload"] == "" and json.loads(messages.error(df, "stage").first()["payload"]) == {"message": "prep"}
    assert s.select(messages.field_of("7.stage").alias("v")).first()["v"] == "prep"
    with pytest.raises(ValueError):
        messages.message(df, "other")
    n = 50
    grid = spark.range(n).select(F.col("id").alias("cell_id"), *[F.col("id").cast("int").alias(a) for a in "ijk"], F.transform(F.sequence(F.lit(0), F.lit(23)), lambda v: v + F.col("id") * 1.0).alias("corners"))
    parts = messages.grid_parts(grid, 20).orderBy("part").collect()
    assert [r["count"] for r in parts] == [20, 20, 10] and messages.CELLS_PER_PART == 19531
    xyz = np.concatenate([messages.decode_array(r["corners"], "<f4").reshape(-1, 24) for r in parts])
    assert np.array_equal(xyz[:, 0], np.arange(n))
    states = spark.createDataFrame([(0, 0, 5.0), (0, 1, float("nan")), (0, 2, 99.0)], "report_step long, cell_id long, p double")
    packed = messages.state_parts(states, {"p": (1.0, 10.0)}).first()
    assert messages.decode_array(packed["p"], "<f2").tolist() == [5.0, 1.0, 10.0]


def test_stateful_history(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 2, 3.0, 0.5), ("a", 3, 3.0, 0.0), ("a", 4, 9.0, 1.0), ("b", 1, 1.0, 1.0)], "run string, iteration int, total double, eta double").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("run string, iteration int, total double, eta double").parquet(str(src))
    q = messages.with_history(stream, 2).writeStream.format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.sql("SELECT run, iteration, best, n, status FROM history ORDER BY run, iteration").collect()]
    assert got == [("a", 1, 5.0, 1, "running"), ("a", 2, 3.0, 2, "running"), ("a", 3, 3.0, 2, "stalled"), ("b", 1, 1.0, 1, "running")]


def test_units_and_scalars(spark):
    assert units.factor("gas/liquid", "METRIC") == pytest.approx(0.0353147 / 6.28981)
    with pytest.raises(ValueError):
        units.factor("length", "LAB")
    df = spark.createDataFrame([(float("nan"), 2.0, " 'abc' ")], "a double, b double, s string")
    r = df.select(scalars.first_finite(F.col("a"), F.col("b")).alias("v"), scalars.clean_name(F.col("s")).alias("n"), scalars.expand_repeats(F.array(F.lit("2*7"), F.lit("3*"), F.lit("x"))).alias("e")).first()
    assert (r["v"], r["n"], r["e"]) == (2.0, "ABC", ["7", "7", None, None, None, "x"])
    out = units.to_field(df.select("b"), {"b": "pressure"}, "METRIC")
    assert out.schema["b"].metadata == {"unit": "psia"}


def test_asof_nulls_and_ties(spark):
    left = spark.createDataFrame([(1, 10), (1, None), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, None, 3, "c"), (2, 6, 1, "d")], "k int, t int, seq int, v string")
    got = {(r["k"], r["t"]): r["match"] and r["match"]["v"] for r in temporal.asof(left, right, ["k"], "t", "t", ["seq"]).collect()}
    assert got == {(1, 10): "b", (1, None): None, (2, 5): None}
