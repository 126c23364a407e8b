"""Mass balances, projections, loss terms and mesh reports bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators import aggregates as agg
from terrane.operators import cells, joins, layout, mesh, residual
from terrane.plans.registry import query, table
from terrane.plans.verify_wells import _T, _sql


def _r(c, n: int = 4):
    return F.round(c, n)


def _state(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (500 + p / 13).alias("pressure"), (q / 50 * 0.6 + 0.2).alias("swat"), (F.col("l_discount") * 1.5).alias("sgas"), (F.col("l_tax") * 15).alias("rs"), F.col("l_tax").alias("depth"))


_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]
_BASE = "SELECT l_orderkey, l_partkey, l_suppkey, l_tax AS depth, 500 + l_extendedprice / 13 AS po, l_quantity / 50 * 0.6 + 0.2 AS sw, l_discount * 1.5 AS sg, l_tax * 15 AS rs FROM lineitem"
_PROPS = f"""WITH s AS ({_BASE}), c AS (SELECT *, po - {_sql(_T.swof['sw'], _T.swof['pcow'], 'sw')} AS pw, po + {_sql(_T.sgof['sg'], _T.sgof['pcgo'], 'sg')} AS pg FROM s),
b AS (SELECT *, {_sql(_T.pvto['rs'], _T.pvto['fvf'], 'rs')} AS bo, 1.03 / greatest(1 + 3e-6 * (pw - 3000), 1e-6) AS bw, {_sql(_T.pvdg['p'], _T.pvdg['fvf'], 'pg')} AS bg FROM c)"""


@query(_PROPS + """, u AS (SELECT *, 0.2 * (1 + 4e-6 * (po - 1000)) AS phi FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, round(phi * sw / bw, 7) AS w, round(phi * (1 - sw - sg) / bo, 7) AS o, round(phi * (sg / bg + rs * (1 - sw - sg) / bo), 7) AS g FROM u""")
def accumulation(spark, d):
    u = residual.accumulation(_T, F.lit(0.2), 4e-6, 1000.0)
    return _state(spark, d).select(*_KEYS, *[_r(c, 7).alias(p) for p, c in u.items()])


@query(_PROPS + """
SELECT l_orderkey, l_partkey, l_suppkey, round(pw - 0.0069444 * 62.4 / bw * (depth + 1 / 7::DOUBLE) * 1000, 4) AS w, round(po - 0.0069444 * (49.1 + rs * 0.06) / bo * (depth + 1 / 7::DOUBLE) * 1000, 4) AS o, round(pg - 0.0069444 * 0.06 / bg * (depth + 1 / 7::DOUBLE) * 1000, 4) AS g FROM b""")
def phase_potentials(spark, d):
    p = residual.potentials(_T, {"w": 62.4, "o": 49.1, "g": 0.06}, 0.0069444, (F.col("depth") + 1 / 7) * 1000)
    return _state(spark, d).select(*_KEYS, *[_r(p[k]).alias(k) for k in "wog"])


_FIELD = "SELECT o_custkey, o_orderkey AS t, 800 + o_totalprice / 500 AS po, 0.25 + (o_orderkey % 7) * 0.05::DOUBLE AS sw, (o_custkey % 5) * 0.03::DOUBLE AS sg, (o_orderkey % 11) * 0.1::DOUBLE AS rs, o_totalprice / 7 AS f FROM orders"


@query(f"""
WITH s AS ({_FIELD}), c AS (SELECT *, po - {_sql(_T.swof['sw'], _T.swof['pcow'], 'sw')} AS pw, po + {_sql(_T.sgof['sg'], _T.sgof['pcgo'], 'sg')} AS pg, 0.2 * (1 + 4e-6 * (po - 1000)) AS phi FROM s),
b AS (SELECT *, {_sql(_T.pvto['rs'], _T.pvto['fvf'], 'rs')} AS bo, 1.03 / greatest(1 + 3e-6 * (pw - 3000), 1e-6) AS bw, {_sql(_T.pvdg['p'], _T.pvdg['fvf'], 'pg')} AS bg FROM c),
u AS (SELECT *, phi * sw / bw AS uw, phi * (1 - sw - sg) / bo AS uo, phi * (sg / bg + rs * (1 - sw - sg) / bo) AS ug FROM b),
r AS (SELECT *, 5.614583 * (uw - lag(uw) OVER k) / (t - lag(t) OVER k) - 0.5 * f - po AS rw, 5.614583 * (uo - lag(uo) OVER k) / (t - lag(t) OVER k) - 0.5 * f - po AS ro,
  5.614583 * (ug - lag(ug) OVER k) / (t - lag(t) OVER k) - 0.5 * f - po AS rg, lag(t) OVER k AS before FROM u WINDOW k AS (PARTITION BY o_custkey ORDER BY t))
SELECT o_custkey, t, round(bw * rw + (bo - rs * bg) * ro + bg * rg, 3) AS r_p, round(rw, 3) AS r_w, CASE WHEN round(rg - rs * ro, 3) = 0 THEN 0 ELSE round(rg - rs * ro, 3) END AS r_g FROM r WHERE before IS NOT NULL""")
def mass_balance(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = table(spark, d, "orders").select("o_custkey", k.alias("t"), (800 + F.col("o_totalprice") / 500).alias("pressure"), (0.25 + (k % 7) * 0.05).alias("swat"), ((c % 5) * 0.03).alias("sgas"), ((k % 11) * 0.1).alias("rs"), (F.col("o_totalprice") / 7).alias("f"), F.lit(0.2).alias("poro"))
    r = residual.balance(x, _T, "poro", 4e-6, 1000.0, ["o_custkey"], "t", dict.fromkeys("wog", "pressure"), dict.fromkeys("wog", "f"), 0.5)
    return r.select("o_custkey", "t", *[_r(n, 3).alias(n) for n in ("r_p", "r_w", "r_g")])


@query("""
SELECT l_linenumber AS step, s_nationkey AS mode, round(sum(s_acctbal / 7 * l_extendedprice), 0) AS r_w, round(sum(s_acctbal / 7 * l_quantity), 2) AS r_g FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def projected_residual(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("vertex_id"), F.col("l_extendedprice").alias("r_w"), F.col("l_quantity").alias("r_g"))
    basis = table(spark, d, "supplier").select(F.col("s_suppkey").alias("vertex_id"), F.col("s_nationkey").alias("mode"), (F.col("s_acctbal") / 7).alias("psi"))
    return residual.projected(rows, basis, ["step"], ["r_w", "r_g"]).select("step", "mode", _r("r_w", 0).alias("r_w"), _r("r_g", 2).alias("r_g"))


_ROWS = """WITH r AS (SELECT o_orderkey AS k, o_totalprice / 70 AS p, (o_orderkey % 8) * 0.1::DOUBLE AS w, (o_custkey % 3) * 0.15::DOUBLE AS g, (o_custkey % 7) * 0.2::DOUBLE AS x FROM orders),
m AS (SELECT k, 'pressure' AS channel, (p * 1.1 - p) / 300 AS residual FROM r UNION ALL SELECT k, 'swat', (w * 0.9 - w) / 0.7 FROM r UNION ALL SELECT k, 'sgas', (g * 0.9 - g) / 0.7 FROM r
UNION ALL SELECT k, 'rs', CASE WHEN 1 - w - g > 1e-3 THEN (x * 1.2 - x) / 1.3 ELSE 0 END FROM r)"""


def _terms(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = table(spark, d, "orders").select(k.alias("k"), (F.col("o_totalprice") / 70).alias("pressure"), ((k % 8) * 0.1).alias("swat"), ((c % 3) * 0.15).alias("sgas"), ((c % 7) * 0.2).alias("rs"))
    predicted = ref.select("k", (F.col("pressure") * 1.1).alias("pressure"), (F.col("swat") * 0.9).alias("swat"), (F.col("sgas") * 0.9).alias("sgas"), (F.col("rs") * 1.2).alias("rs"))
    return residual.state_rows(predicted, ref, ["k"], (300.0, 0.7, 0.7, 1.3), "ic")


@query(_ROWS + " SELECT k, channel, CASE WHEN round(residual, 6) = 0 THEN 0 ELSE round(residual, 6) END AS residual FROM m")
def state_rows(spark, d):
    return _terms(spark, d).select("k", "channel", _r("residual", 6).alias("residual"))


@query(_ROWS + """ SELECT 'ic' AS term, round(avg(residual * residual), 8) AS loss, count(*) AS n, round(0.5 * avg(residual * residual), 8) AS weighted FROM m
UNION ALL SELECT 'well', round(avg(pow(l_tax, 2)), 8), count(*), round(2 * avg(pow(l_tax, 2)), 8) FROM lineitem""")
def term_losses(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_tax").alias("residual"))
    return residual.term_losses({"ic": _terms(spark, d), "well": w}, {"ic": 0.5, "well": 2.0}).select("term", _r("loss", 8).alias("loss"), "n", _r("weighted", 8).alias("weighted"))


@query("""
WITH v AS (SELECT c_custkey AS id, c_nationkey % 4 AS c, (c_custkey % 40) * 1.0::DOUBLE AS x, (c_custkey // 40 % 30) * 1.0::DOUBLE AS y, c_nationkey * 0.1::DOUBLE AS z FROM customer),
p AS (SELECT a.c AS src, b.c AS dst, a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM v a JOIN v b ON a.c <> b.c AND abs(a.x - b.x) <= 1.5 AND abs(a.y - b.y) <= 1.5 AND abs(a.z - b.z) <= 1.5),
n AS (SELECT src, dst, id, min(d) AS d FROM p WHERE d <= 1.5 GROUP BY 1, 2, 3)
SELECT src, dst, count(*) AS n, round(min(d), 6) AS min_distance, least(count(*), 5) AS shown, list_sum(list_slice(list_sort(list(id)), 1, 5))::BIGINT AS sampled FROM n GROUP BY 1, 2""")
def near_contacts(spark, d):
    c = F.col("c_custkey")
    v = table(spark, d, "customer").select(c.alias("vertex_id"), (F.col("c_nationkey") % 4).alias("component"), (c % 40).cast("double").alias("x"), (F.floor(c / 40) % 30).cast("double").alias("y"), (F.col("c_nationkey") * 0.1).alias("z"))
    r = mesh.near_contacts(v, 1.5)
    return r.select("src", "dst", "n", _r("min_distance", 6).alias("min_distance"), F.size("samples").alias("shown"), F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x["vertex_id"]).alias("sampled"))


@query("SELECT DISTINCT s_suppkey AS vertex_id FROM supplier UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 30 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def well_vertices(spark, d):
    t = lambda n, c: table(spark, d, n).withColumn("vertex_id", F.col(c))
    return mesh.well_vertices([t("supplier", "s_suppkey"), t("lineitem", "l_suppkey").filter("l_quantity > 30"), t("customer", "c_custkey").filter("c_acctbal < 0")])


_CORNERS = "SELECT c_custkey AS cell_id, s, (c_custkey % 10 + s % 2) AS i, (c_custkey // 10 % 5 + s // 2 % 2) AS j, (c_custkey // 50 + s // 4) AS k FROM customer, range(8) AS r(s)"


def _mesh(spark, d):
    c = F.col("c_custkey")
    g = table(spark, d, "customer").select(c.alias("cell_id"), (c % 10 * 1.0).alias("x0"), (F.floor(c / 10) % 5 * 2.0).alias("y0"), (F.floor(c / 50) * 3.0).alias("z0"), F.lit(1.0).alias("dx"), F.lit(2.0).alias("dy"), F.lit(3.0).alias("dz"))
    return mesh.vertices_of(cells.corner_points(g))


@query(f"WITH c AS ({_CORNERS}), f AS (SELECT i, j, k, min(cell_id * 8 + s) AS pos FROM c GROUP BY 1, 2, 3) SELECT row_number() OVER (ORDER BY pos) - 1 AS vertex_id, i * 1.0::DOUBLE AS x, j * 2.0::DOUBLE AS y, k * 3.0::DOUBLE AS z FROM f")
def mesh_vertices(spark, d):
    return _mesh(spark, d)[0].select("vertex_id", "x", "y", "z")


@query(f"WITH c AS ({_CORNERS}) SELECT max(n) AS max_reuse FROM (SELECT count(*) AS n FROM c GROUP BY i, j, k)")
def vertex_reuse(spark, d):
    return mesh.reuse(_mesh(spark, d)[1])


@query(f"WITH c AS (SELECT DISTINCT i, j, k FROM ({_CORNERS})) SELECT i * 1.0::DOUBLE AS x, j * 2.0::DOUBLE AS y, count(*) AS levels FROM c GROUP BY 1, 2")
def vertex_columns(spark, d):
    v, _ = _mesh(spark, d)
    return mesh.node_columns(v).join(v, "vertex_id").select("x", "y", "levels").distinct()


_NODES = "SELECT c_custkey AS vertex_id, (c_custkey % 10) * 1.0::DOUBLE AS x, (c_custkey // 10 % 5) * 2.0::DOUBLE AS y, (c_custkey // 50) * 0.5::DOUBLE AS z, 1 + (c_custkey % 4) * 0.5::DOUBLE AS volume FROM customer"
_WELLS = "SELECT s_suppkey AS perf_no, (s_suppkey % 9) * 1.1::DOUBLE AS px, (s_suppkey % 5) * 1.9::DOUBLE AS py, (s_suppkey % 7) * 2.3::DOUBLE AS pz, 1.5::DOUBLE AS sx, 2.5::DOUBLE AS sy, 4.0::DOUBLE AS sz, s_acctbal AS q FROM supplier"
_KERNEL = "exp(-0.5 * (pow((x - px) / (W * sx), 2) + pow((y - py) / (W * sy), 2) + pow((z - pz) / (W * sz), 2)))"


def _near(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    nodes = table(spark, d, "customer").select(c.alias("vertex_id"), (c % 10 * 1.0).alias("x"), (F.floor(c / 10) % 5 * 2.0).alias("y"), (F.floor(c / 50) * 0.5).alias("z"), (1 + c % 4 * 0.5).alias("volume"))
    perfs = table(spark, d, "supplier").select(s.alias("perf_no"), (s % 9 * 1.1).alias("px"), (s % 5 * 1.9).alias("py"), (s % 7 * 2.3).alias("pz"), F.lit(1.5).alias("sx"), F.lit(2.5).alias("sy"), F.lit(4.0).alias("sz"), F.col("s_acctbal").alias("q"))
    return nodes, perfs


@query(f"WITH n AS ({_NODES}), p AS ({_WELLS}), g AS (SELECT vertex_id, perf_no, {_KERNEL.replace('W', '1')} * volume AS g FROM n, p) SELECT vertex_id, perf_no, round(g / sum(g) OVER (PARTITION BY perf_no), 9) AS share FROM g")
def nodal_partition(spark, d):
    return residual.nodal_partition(*_near(spark, d), digits=9)


@query(f"WITH n AS ({_NODES}), p AS ({_WELLS}) SELECT vertex_id, round(max({_KERNEL.replace('W', '1.5')}), 8) AS envelope, round(sum({_KERNEL.replace('W', '1')} / (pow(2 * pi(), 1.5) * sx * sy * sz) * q), 5) AS q FROM n, p GROUP BY 1")
def well_densities(spark, d):
    n, p = _near(spark, d)
    e, q = residual.envelope(n, p, 1.5), residual.source_density(n, p, ["q"])
    return e.join(q, "vertex_id").select("vertex_id", _r("envelope", 8).alias("envelope"), _r("q", 5).alias("q"))


@query("""
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity * 7 AS t FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, round(2 * t / 353 - 1, 8) AS linear, round(2 * ln(1 + t / 11) / ln(1 + 353 / 11::DOUBLE) - 1, 8) AS warped, round(t, 6) AS back FROM t""")
def time_channels(spark, d):
    t = F.col("l_quantity") * 7
    warped = scalars.time_channel(t, 353.0, 11.0)
    return table(spark, d, "lineitem").select(*_KEYS, _r(scalars.time_channel(t, 353.0), 8).alias("linear"), _r(warped, 8).alias("warped"), _r(scalars.time_of_channel(warped, 353.0, 11.0), 6).alias("back"))


@query("""
WITH p AS (SELECT p_partkey, p_size / 3.0::DOUBLE AS dx, p_retailprice / 700 AS dy FROM part), r AS (SELECT *, sqrt(dx * dx + dy * dy) AS r FROM p)
SELECT p_partkey, round(2 * (ln(greatest(r, 2.5)) - ln(2.5)) / (ln(20) - ln(2.5)) - 1, 8) AS phi, round(CASE WHEN r > 2.5 THEN 2 / (ln(20) - ln(2.5)) * dx / (r * r) ELSE 0 END, 8) AS gx FROM r""")
def near_well_channel(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 3.0).alias("dx"), (F.col("p_retailprice") / 700).alias("dy"))
    r = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    phi, grad = layout.near_well_channel(r, [F.col("dx"), F.col("dy")], 2.5, 20.0)
    return p.select("p_partkey", _r(phi, 8).alias("phi"), _r(grad[0], 8).alias("gx"))


@query("""
WITH l AS (SELECT user_id, event_id, event_id % 3 AS b, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS k FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, event_id % 3 AS b, value, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'error')),
j AS (SELECT l.user_id, event_id, value, bool_and(r.k IS NOT NULL) OVER (PARTITION BY l.user_id) AS complete FROM l LEFT JOIN r USING (user_id, b, k))
SELECT event_id, complete, CASE WHEN complete THEN round(value, 2) ELSE -1.0 END AS value FROM j""")
def multiset_or_default(spark, d):
    e = table(spark, d, "events").withColumn("b", F.col("event_id") % 3)
    left = e.filter("event_type = 'click'").select("user_id", "b", "event_id")
    right = e.filter("event_type IN ('view', 'error')").select("user_id", "b", "value", F.col("event_id").alias("at"))
    m = joins.match_or_default(left, right, ["user_id"], ["b"], ["event_id"], ["at"], {"value": -1.0})
    return m.select("event_id", "complete", _r("value", 2).alias("value"))


@query("""
WITH s AS (SELECT DISTINCT l_linenumber AS t FROM lineitem), n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS m FROM s),
c AS (SELECT t FROM n WHERE i IN (0, round_even((m - 1) / 3.0, 0), round_even(2 * (m - 1) / 3.0, 0), m - 1)),
r AS (SELECT t, sqrt(avg(pow(l_extendedprice / 1000 - l_quantity, 2))) AS rmse FROM lineitem JOIN c ON l_linenumber = t GROUP BY 1)
SELECT round(avg(rmse), 6) AS mean, round(arg_max(rmse, t), 6) AS final, count(*) AS n FROM r""")
def rmse_mean_of_steps(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    return agg.rmse_mean(li, "l_linenumber", "p", "l_quantity", 4).select(_r("mean", 6).alias("mean"), _r("final", 6).alias("final"), "n")


@query(f"""
WITH c AS ({_CORNERS}), b AS (SELECT DISTINCT cell_id, c_custkey % 10 AS ci FROM c JOIN customer ON c_custkey = cell_id),
f AS (SELECT cell_id, CASE WHEN ci = 0 THEN 'X-' ELSE 'X' END AS face FROM b WHERE ci IN (0, 9)), ids AS (SELECT i, j, k, row_number() OVER (ORDER BY min(cell_id * 8 + s)) - 1 AS vertex_id FROM c GROUP BY 1, 2, 3),
v AS (SELECT cell_id, s, vertex_id FROM c JOIN ids USING (i, j, k))
SELECT DISTINCT array_to_string(list_sort(list(vertex_id)), ',') AS quad FROM v JOIN f USING (cell_id) WHERE s % 2 = CASE face WHEN 'X' THEN 1 ELSE 0 END GROUP BY cell_id""")
def boundary_quads(spark, d):
    _, incidence = _mesh(spark, d)
    i = F.col("c_custkey") % 10
    faces = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.when(i == 0, "X-").when(i == 9, "X").alias("face")).filter("face IS NOT NULL")
    return layout.boundary_quads(faces, incidence).select(F.array_join("quad", ",").alias("quad"))
