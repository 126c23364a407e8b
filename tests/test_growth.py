"""Work that grew with the square of its input: copies in large numbers, against plain rules."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import flux, mesh, residual, schedule, well_pack, wells


def perforations(spark, n, shapes=4):
    k = F.col("id")
    return spark.range(n).select(k.alias("perf_no"), *[(k % shapes * s).cast("double").alias(c) for c, s in (("px", 1.1), ("py", 0.7), ("pz", 0.3))], F.lit(1.5).alias("sx"), F.lit(2.0).alias("sy"), F.lit(2.5).alias("sz"), (k % 9 - 3).cast("double").alias("q"))


def nodes(spark, n):
    k = F.col("id")
    return spark.range(n).select(k.alias("vertex_id"), (k % 10).cast("double").alias("x"), (k % 7).cast("double").alias("y"), (k % 3).cast("double").alias("z"), (1 + k % 4).cast("double").alias("volume"))


def gauss(n, p, w=1.0):
    return math.exp(-0.5 * sum(((n[a] - p[f"p{a}"]) / (w * p[f"s{a}"])) ** 2 for a in "xyz"))


def test_many_perforations_of_few_shapes(spark):
    began = time.monotonic()
    n, p = nodes(spark, 40_000), perforations(spark, 40_000)
    e = residual.envelope(n, p, 1.5).join(residual.source_density(n, p, ["q"]), "vertex_id")
    got = {r["vertex_id"]: r for r in e.collect()}
    assert time.monotonic() - began < 30
    ps, ns = p.collect(), n.filter("vertex_id % 5003 = 0").collect()
    for v in ns:
        want = sum(gauss(v, x) * x["q"] for x in ps) / (math.pow(2 * math.pi, 1.5) * 7.5)
        assert got[v["vertex_id"]]["q"] == pytest.approx(want, rel=1e-9) and got[v["vertex_id"]]["envelope"] == pytest.approx(max(gauss(v, x, 1.5) for x in ps[:4]), rel=1e-12)


def test_shares_of_perforations_alike(spark):
    n, p = nodes(spark, 50), perforations(spark, 12).unionByName(perforations(spark, 1).withColumn("perf_no", F.lit(99).cast("long")).withColumn("px", F.lit(None).cast("double")))
    got = {(r["vertex_id"], r["perf_no"]): r["share"] for r in residual.nodal_partition(n, p, 6).collect()}
    ns, ps = n.collect(), p.filter("perf_no <> 99").collect()
    assert len(got) == 50 * 13 and all(got[v["vertex_id"], 99] is None for v in ns)
    for x in ps:
        total = sum(gauss(v, x) * v["volume"] for v in ns)
        assert all(got[v["vertex_id"], x["perf_no"]] == pytest.approx(gauss(v, x) * v["volume"] / total, abs=5.1e-7) for v in ns)
    plan = residual.nodal_partition(n, p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan  # the product stays where it is made


def test_vertices_of_one_file_are_spread(spark):
    n, p = nodes(spark, 40_000).coalesce(1), perforations(spark, 8_000)
    shares = residual.nodal_partition(n, p)
    assert n.rdd.getNumPartitions() == 1 and shares.rdd.getNumPartitions() >= 16  # all cores take part in 320 million rows
    got = shares.agg(F.count("*"), F.sum("share"), F.sum("vertex_id"), F.sum("perf_no")).first()
    assert tuple(got) == (320_000_000, pytest.approx(8_000, rel=1e-6), 8_000 * 799_980_000, 40_000 * 31_996_000)
    many = perforations(spark, 120, shapes=120)
    for df in (residual.envelope(n, many), residual.source_density(n, many, ["q"])):
        assert "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()
    few = residual.nodal_partition(nodes(spark, 20).coalesce(1), perforations(spark, 5))
    assert few.rdd.getNumPartitions() == 1 and few.count() == 100 and residual.nodal_partition(n, p.limit(0)).count() == 0


def test_small_shares_are_rounded_as_others(spark):
    values = [s * v for v in (0.0, 1e-300, 3.9999e-10, 4e-10, 4.0001e-10, 4.9999e-10, 5e-10, 5.0001e-10, 1.5e-9, 0.123456789, 0.1234567885, 0.4, 0.5, 39.0, 50.0, 1e300, math.inf) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "v double")
    for digits in (9, 0, -2):
        assert all(repr(a) == repr(b) for a, b in df.select(residual._rounded(F.col("v"), digits), F.round("v", digits)).collect())
    plan = residual.nodal_partition(nodes(spark, 5), perforations(spark, 2), 9)._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN (abs(" in plan  # a decimal is made only where the result isn't surely 0


def test_contacts_of_vertices_in_few_places(spark):
    k = F.col("id")
    v = spark.range(120_000).select(k.alias("vertex_id"), (k % 3).cast("int").alias("component"), (k % 3 * 0.5 + F.floor(k / 3) % 4 * 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    began = time.monotonic()
    got = {(r["src"], r["dst"]): (r["n"], r["min_distance"], [tuple(s) for s in r["samples"]][:2]) for r in mesh.near_contacts(v, 0.6).collect()}
    assert time.monotonic() - began < 30
    assert got == {(a, b): (40_000, 0.5, [(a, b, 0.5), (a + 3, b + 3, 0.5)]) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))}


def test_nearest_of_a_long_track(spark):
    k, n, m = F.col("id"), 30_000, 12_000
    track = spark.range(m).select(F.lit("t").alias("k"), k.alias("o"), (k * 7919 % 10007).cast("double").alias("x"), (k * 104729 % 9973).cast("double").alias("y"))
    points = spark.range(n).select(F.lit("t").alias("k"), "id", F.when(k != 5, (k * 6007 % 10009).cast("double")).alias("x"), (k * 7001 % 9967).cast("double").alias("y"))
    began = time.monotonic()
    got = {r["id"]: tuple(r["tangent"]) for r in schedule.nearest_segment(points, track, "k", ["x", "y"], "o").collect()}
    assert time.monotonic() - began < 40 and len(got) == n
    t = np.array([(r["x"], r["y"]) for r in track.orderBy("o").collect()])
    d = np.diff(t, axis=0)
    for r in points.filter("id % 997 = 0").collect():
        tau = np.clip(((r["x"] - t[:-1, 0]) * d[:, 0] + (r["y"] - t[:-1, 1]) * d[:, 1]) / (d * d).sum(1), 0, 1)
        g = (r["x"] - t[:-1, 0] - tau * d[:, 0]) ** 2 + (r["y"] - t[:-1, 1] - tau * d[:, 1]) ** 2
        assert got[r["id"]] == tuple(d[g.argmin()])
    assert got[5] == tuple(d[0])  # no place: the first


def test_residuals_are_not_gathered_by_phase(spark):
    k = F.col("id")
    c = spark.range(1000).select(k.alias("report_step"), k.alias("well"), F.lit(1).alias("channel"), (k % 3).cast("int").alias("phase"), (k * 2.0).alias("predicted"), k.cast("double").alias("obs"))
    h = c.select("report_step", "well", F.col("predicted").alias("p_bh"), F.col("obs").alias("bhp_obs"))
    r = wells.residual_rows(h, c, 70.0, spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "phase int, scale double"))
    assert "hashpartitioning(phase" not in r._jdf.queryExecution().executedPlan().toString()
    assert sum(x["residual"] for x in r.filter("grp = 'channel'").collect()) == sum(n / (1, 2, 4)[n % 3] for n in range(1000)) and r.count() == 2000


def test_states_are_sent_once_a_block(spark):
    n = 6
    cells, rows = [], []
    for c in range(n**3):
        x, y, z = c % n, c // n % n, c // n // n
        v = [x + (s & 1) + (n + 1) * (y + (s >> 1 & 1)) + (n + 1) ** 2 * (z + (s >> 2)) for s in range(8)]
        cells.append((c, [float(u) for s in range(8) for u in (x + (s & 1), y + (s >> 1 & 1), z + (s >> 2))], v, 1.0, 1.0, 1.0))
    rows = [(0, v, *[float(v % (n + 1))] * 3, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0) for v in range((n + 1) ** 3)]
    fields = "t long, vertex_id long, " + ", ".join(f"{c} double" for c in (*flux.GATHERED[:6], "du_w", "du_o", "du_g", "f_x"))
    df = spark.createDataFrame(cells, "cell_id long, corners array<double>, v array<long>, kx double, ky double, kz double")
    parts = flux.element_parts(df, spark.createDataFrame(rows, fields), "t")
    assert "hashpartitioning(t#" not in parts._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1]  # never by slice and cell
    got = {r["vertex_id"]: r["r_w"] for r in parts.collect()}
    assert len(got) == (n + 1) ** 3 and all(abs(got[v]) < 1e-9 for v in got if 0 < v % (n + 1) < n)
    assert sum(got[v] for v in got if v % (n + 1) == n) == pytest.approx(n * n)


def test_packed_ids_join_no_rows(spark, capsys):
    rows = [(w, p) for w in (1, 3, 5, 8, None) for p in (*range(200), None)] + [(3, p) for p in range(3000)]
    want = {k: n for n, k in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)))}
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = well_pack.packed(spark.createDataFrame(rows, "well long, perf_id long").repartition(3), once=True)
        got = out.collect()
        every = well_pack.packed(spark.createDataFrame(rows, "well long, perf_id long")).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["well"], r["perf_id"]): r["perf_no"] for r in got} == want and len(got) == len(want) and every == len(rows)
    wells_ = {1: 0, 3: 1, 5: 2, 8: 3, None: 4}
    assert all(r["well_no"] == wells_[r["well"]] for r in got)
    out.explain()
    said = capsys.readouterr().out
    plan = said.split("Initial Plan")[-1]
    assert plan.count("Join ") == plan.count("BroadcastHashJoin") == 2  # with the parts' offsets and, for those, with their last numbers


def test_many_short_runs_cost_little_each():
    import pandas as pd

    from terrane.streaming.run_stream import FOLLOWED, RUNNING, Follower

    class Place:
        def get(self):
            return None

        def update(self, place):
            self.place = place

    f = Follower(adapt_every=4)
    f.place = Place()
    n = 60
    steps = pd.DataFrame({"run": "a", "step": range(n, 0, -1), "total": [float("nan"), *range(n - 1)], **{c: 0.0 for c in ("pde", "ic", "data", "well", "wall_s")}, "eta": 0.5, "failure": None, "n_iter": [40.0] * n})
    began = time.process_time()
    for _ in range(300):
        out, = f.handleInputRows(("a",), iter([steps.iloc[:20], steps.iloc[20:]]), None)
    assert time.process_time() - began < 300 * 3e-3
    assert list(out.columns) == [c.split()[0] for c in FOLLOWED.split(", ")] and len(out) == 40 and f.place.place == (40, 19.0, "completed", 0)
    assert list(out["status"]) == [RUNNING] * 39 + ["completed"] and list(out["best"]) == [float(n - 2 - k) for k in range(40)] and list(out["iteration"][out["redraw"]]) == [5, 9, 13, 17, 21, 25, 29, 33, 37]
