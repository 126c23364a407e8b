"""The balance at the vertices of a mesh, the whole loss and what a basis tells apart, bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import flux, mesh_build, residual, spectral
from terrane.plans.registry import query, table
from terrane.plans.storage import written
from terrane.plans.verify_wells import _T, _sql

_DENSITY, _GRAVITY = {"w": 62.4, "o": 49.1, "g": 0.06}, 0.0069444

_KR = {"krw": _sql(_T.swof["sw"], _T.swof["krw"], "sw"), "krow": _sql(_T.swof["sw"], _T.swof["krow"], "sw"), "krg": _sql(_T.sgof["sg"], _T.sgof["krg"], "sg"), "krog": _sql(_T.sgof["sg"], _T.sgof["krog"], "sg")}
#: A grid of 10 x 5 columns: a cell a customer; vertices are numbered along x, y and z; an order is a vertex' state in a slice.
_TERMS = f"""
size AS (SELECT 66 * (max(c_custkey // 50) + 2) AS n FROM customer),
cell AS (SELECT c_custkey AS cell_id, 10.0 + c_nationkey AS kx, 5.0 + c_nationkey / 3 AS ky, 1.0 + c_nationkey / 10 AS kz FROM customer),
corner AS (SELECT cell_id, s, (cell_id % 10 + s % 2) + 11 * (cell_id // 10 % 5 + s // 2 % 2) + 66 * (cell_id // 50 + s // 4) AS v FROM cell, range(8) AS r(s)),
st AS (SELECT o_orderkey // n AS step, o_orderkey % n AS v, o_orderkey % n // 66 * 3.0::DOUBLE AS z, 800 + o_totalprice / 2000 AS po, 0.25 + (o_orderkey % 7) * 0.05::DOUBLE AS sw, (o_orderkey % 5) * 0.03::DOUBLE AS sg, (o_orderkey % 11) * 0.1::DOUBLE AS rs FROM orders, size),
c1 AS (SELECT *, po - {_sql(_T.swof['sw'], _T.swof['pcow'], 'sw')} AS pw, po + {_sql(_T.sgof['sg'], _T.sgof['pcgo'], 'sg')} AS pg, {', '.join(f'{e} AS {k}' for k, e in _KR.items())} FROM st),
c2 AS (SELECT *, {_sql(_T.pvto['rs'], _T.pvto['fvf'], 'rs')} AS bo, {_sql(_T.pvto['rs'], _T.pvto['visc'], 'rs')} AS muo, {_T.pvtw['fvf']} / greatest(1 + {_T.pvtw['compr']} * (pw - {_T.pvtw['p']}), 1e-6) AS bw, {_T.pvtw['visc']} / greatest(1 - {_T.pvtw.get('viscosibility', 0.0)} * (pw - {_T.pvtw['p']}), 1e-6) AS muw, {_sql(_T.pvdg['p'], _T.pvdg['fvf'], 'pg')} AS bg, {_sql(_T.pvdg['p'], _T.pvdg['visc'], 'pg')} AS mug FROM c1),
c3 AS (SELECT *, 0.2 * (1 + 4e-6 * (po - 1000)) AS phi, greatest({_T.krc} * ((krow / {_T.krc} + krw) * (krog / {_T.krc} + krg) - (krw + krg)), 0) / greatest(muo * bo, 1e-12) AS f_o, krw / greatest(muw * bw, 1e-12) AS f_w, krg / greatest(mug * bg, 1e-12) AS f_g FROM c2),
c4 AS (SELECT *, rs * f_o AS f_x, phi * sw / bw AS u_w, phi * (1 - sw - sg) / bo AS u_o, phi * (sg / bg + rs * (1 - sw - sg) / bo) AS u_g,
  pw - {_GRAVITY} * 62.4 / bw * z AS phi_w, po - {_GRAVITY} * (49.1 + rs * 0.06) / bo * z AS phi_o, pg - {_GRAVITY} * 0.06 / bg * z AS phi_g FROM c3),
t AS (SELECT *, {', '.join(f'(u_{p} - lag(u_{p}) OVER k) / (step - lag(step) OVER k) AS du_{p}' for p in 'wog')} FROM c4 WINDOW k AS (PARTITION BY v ORDER BY step))"""
_D, _M = "CASE WHEN {0} = {1} THEN 1 ELSE -1 END", "CASE WHEN {0} = {1} THEN 1 / 3::DOUBLE ELSE 1 / 6::DOUBLE END"
_AXES = [("a.s % 2", "b.s % 2"), ("a.s // 2 % 2", "b.s // 2 % 2"), ("a.s // 4", "b.s // 4")]


def _element(lumped: bool) -> str:
    d, m = [_D.format(*x) for x in _AXES], [_M.format(*x) for x in _AXES]
    stiff = f"kx * 6 * ({d[0]}) * ({m[1]}) * ({m[2]}) + ky * 1.5 * ({m[0]}) * ({d[1]}) * ({m[2]}) + kz * (2 / 3::DOUBLE) * ({m[0]}) * ({m[1]}) * ({d[2]})"
    mass = "CASE WHEN a.s = b.s THEN 6 / 8::DOUBLE ELSE 0 END" if lumped else f"6 * ({m[0]}) * ({m[1]}) * ({m[2]})"
    donors = ", ".join(f"sum(exp({phi} - mean_{phi}) * {f}) / sum(exp({phi} - mean_{phi})) AS d_{f[2:]}" for phi, f in (("phi_w", "f_w"), ("phi_o", "f_o"), ("phi_g", "f_g"), ("phi_o", "f_x")))
    return f"""WITH {_TERMS},
e AS (SELECT t.*, corner.cell_id, s, {', '.join(f'avg(phi_{p}) OVER c AS mean_phi_{p}' for p in 'wog')}, count(*) OVER c AS n_held FROM corner JOIN t USING (v) WINDOW c AS (PARTITION BY step, cell_id)),
h AS (SELECT step, cell_id, {donors} FROM e WHERE n_held = 8 GROUP BY 1, 2),
b AS (SELECT a.step, a.v, a.cell_id, a.s, {', '.join(f'sum(({stiff}) * b.phi_{p}) AS k_{p}, sum(({mass}) * b.du_{p}) AS m_{p}' for p in 'wog')}, count(b.du_w) AS n_du
  FROM e a JOIN e b ON a.step = b.step AND a.cell_id = b.cell_id JOIN cell ON cell.cell_id = a.cell_id WHERE a.n_held = 8 GROUP BY 1, 2, 3, 4),
p AS (SELECT b.step, b.v, sum(0.5 * d_w * k_w + 5.614583 * m_w) AS r_w, sum(0.5 * d_o * k_o + 5.614583 * m_o) AS r_o, sum(0.5 * (d_g * k_g + d_x * k_o) + 5.614583 * m_g) AS r_g FROM b JOIN h ON h.step = b.step AND h.cell_id = b.cell_id
  GROUP BY 1, 2 HAVING min(n_du) = 8),
share AS (SELECT s_suppkey AS perf_no, s_suppkey * 7 % n AS v, 0.75 AS share FROM supplier, size UNION ALL SELECT s_suppkey, (s_suppkey * 7 + 1) % n, 0.25 FROM supplier, size),
rate AS (SELECT l_linenumber - 1 AS step, l_suppkey AS perf_no, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
q AS (SELECT step, v, sum(share * q) AS q FROM rate JOIN share USING (perf_no) GROUP BY 1, 2),
x AS (SELECT p.*, bw, bo, bg, rs, r_w - coalesce(q, 0) AS a_w, r_o - coalesce(q / 2, 0) AS a_o, r_g - coalesce(q / 4, 0) AS a_g FROM p JOIN t ON t.step = p.step AND t.v = p.v LEFT JOIN q ON q.step = p.step AND q.v = p.v),
r AS (SELECT step, v, bw * a_w + (bo - rs * bg) * a_o + bg * a_g AS r_p, a_w AS r_w, a_g - rs * a_o AS r_g FROM x),
basis AS (SELECT v, mode, v * (mode + 1) % 13 / 13::DOUBLE - 0.4 AS psi FROM (SELECT unnest(range(n)) AS v FROM size), range(4) AS m(mode))"""


def _grid(spark, d):
    c = F.col("c_custkey")
    i, j, k = c % 10, F.floor(c / 10) % 5, F.floor(c / 50)
    at = lambda s: (i + s % 2) + 11 * (j + s // 2 % 2) + 66 * (k + s // 4)
    corner = lambda s: [((i + s % 2) * 1.0).cast("double"), ((j + s // 2 % 2) * 2.0).cast("double"), ((k + s // 4) * 3.0).cast("double")]
    n = F.col("c_nationkey")
    return table(spark, d, "customer").select(c.alias("cell_id"), F.array(*[x for s in range(8) for x in corner(s)]).alias("corners"), F.array(*[at(s).cast("long") for s in range(8)]).alias("v"), (10 + n).cast("double").alias("kx"), (5 + n / 3).alias("ky"), (1 + n / 10).alias("kz"))


def _balance(spark, d, consistent):
    size = 66 * (table(spark, d, "customer").agg(F.max(F.floor(F.col("c_custkey") / 50))).first()[0] + 2)
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    st = table(spark, d, "orders").select(F.floor(k / size).alias("step"), (k % size).alias("vertex_id"), (F.floor(k % size / 66) * 3.0).alias("z"), (800 + F.col("o_totalprice") / 2000).alias("pressure"), (0.25 + (k % 7) * 0.05).alias("swat"), ((k % 5) * 0.03).alias("sgas"), ((k % 11) * 0.1).alias("rs"), F.lit(0.2).alias("poro"))
    terms = flux.vertex_terms(st, _T, _DENSITY, _GRAVITY, "z", "poro", 4e-6, 1000.0)
    share = lambda by, w: table(spark, d, "supplier").select(s.alias("perf_no"), ((s * 7 + by) % size).alias("vertex_id"), F.lit(w).alias("share"))
    rates = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("step"), F.col("l_suppkey").alias("perf_no")).agg(F.sum("l_quantity").alias("q_w"))
    rates = rates.withColumns({"q_o": F.col("q_w") / 2, "q_g": F.col("q_w") / 4})
    return size, flux.nodal_balance(_grid(spark, d), terms, flux.loads(share(0, 0.75).unionByName(share(1, 0.25)), rates, "step"), "step", consistent, 0.5)


def _basis(spark, size):
    v, m = F.col("id"), F.col("mode")
    modes = spark.range(size).withColumn("mode", F.explode(F.array(*map(F.lit, range(4)))))
    mu = written(spark.createDataFrame([(k, 1 / (k + 1)) for k in range(4)], "mode int, mu double"))
    return modes.select(v.alias("vertex_id"), "mode", (v * (m + 1) % 13 / 13 - 0.4).alias("psi")), mu


def _rounded(df):
    return df.select("step", "mode", *[F.round(F.col(c), 2).alias(c) for c in ("r_p", "r_w", "r_g")])


@query(f"""{_element(False)}
SELECT step, mode, round(sqrt(1 / (mode + 1)) * sum(psi * r_p), 2) AS r_p, round(sqrt(1 / (mode + 1)) * sum(psi * r_w), 2) AS r_w, round(sqrt(1 / (mode + 1)) * sum(psi * r_g), 2) AS r_g FROM r JOIN basis USING (v) GROUP BY 1, 2""")
def pde_galerkin_rows(spark, d):
    """Flux, storage and loads of a grid of customers with orders as states, on four modes."""
    size, r = _balance(spark, d, True)
    return _rounded(flux.project(r, *_basis(spark, size), "step"))


@query(f"""{_element(True)}, w AS (SELECT v, 1 + 2 * (v % 5 = 0)::INT AS w FROM (SELECT unnest(range(n)) AS v FROM size))
SELECT step, mode, round(sqrt(1 / (mode + 1) * sum(abs(psi) * w * r_p * r_p) + 1e-30), 2) AS r_p, round(sqrt(1 / (mode + 1) * sum(abs(psi) * w * r_w * r_w) + 1e-30), 2) AS r_w, round(sqrt(1 / (mode + 1) * sum(abs(psi) * w * r_g * r_g) + 1e-30), 2) AS r_g
FROM r JOIN basis USING (v) JOIN w USING (v) GROUP BY 1, 2""")
def pde_block_norm_rows(spark, d):
    """The same with lumped storage, as norms weighted towards wells."""
    size, r = _balance(spark, d, False)
    nodes = spark.range(size).select(F.col("id").alias("vertex_id"), (F.col("id") % 5 == 0).cast("double").alias("envelope"))
    return _rounded(flux.project(r, *_basis(spark, size), "step", "blocknorm", flux.node_weights(nodes, "wells", 2.0)))


@query(f"""{_element(False)},
g AS (SELECT step, mode, sqrt(1 / (mode + 1)) * sum(psi * r_p) AS r_p, sqrt(1 / (mode + 1)) * sum(psi * r_w) AS r_w, sqrt(1 / (mode + 1)) * sum(psi * r_g) AS r_g FROM r JOIN basis USING (v) GROUP BY 1, 2),
m AS (SELECT 'pde' AS term, unnest([r_p / 3e4, r_w / 2e4, r_g / 5e4]) AS residual FROM g UNION ALL SELECT 'ic', unnest([po * 0.01 / 300, sw * 0.1 / 0.7, sg * 0.1 / 0.7, CASE WHEN 1 - sw - sg > 1e-3 THEN rs * 0.2 / 1.3 ELSE 0 END]) FROM st WHERE step = 0
UNION ALL SELECT 'data', unnest([po * 0.01 / 300, sw * 0.1 / 0.7, sg * 0.1 / 0.7, CASE WHEN 1 - sw - sg > 1e-3 THEN rs * 0.2 / 1.3 ELSE 0 END]) FROM st WHERE step > 0 UNION ALL SELECT 'well', l_tax FROM lineitem)
SELECT term, count(*) AS n, round(avg(residual * residual), 5) AS loss, round(avg(residual * residual) * CASE term WHEN 'pde' THEN 1 WHEN 'ic' THEN 0.5 WHEN 'data' THEN 2 ELSE 3 END, 5) AS weighted FROM m GROUP BY term""")
def whole_loss(spark, d):
    """All four terms of the loss: balances, first states, later states, wells."""
    size, r = _balance(spark, d, True)
    k = F.col("o_orderkey")
    ref = table(spark, d, "orders").select(F.floor(k / size).alias("step"), (k % size).alias("vertex_id"), (800 + F.col("o_totalprice") / 2000).alias("pressure"), (0.25 + (k % 7) * 0.05).alias("swat"), ((k % 5) * 0.03).alias("sgas"), ((k % 11) * 0.1).alias("rs"))
    predicted = ref.select("step", "vertex_id", (F.col("pressure") * 1.01).alias("pressure"), (F.col("swat") * 1.1).alias("swat"), (F.col("sgas") * 1.1).alias("sgas"), (F.col("rs") * 1.2).alias("rs"))
    states = lambda term, rows: residual.state_rows(predicted.filter(rows), ref.filter(rows), ["step", "vertex_id"], (300.0, 0.7, 0.7, 1.3), term)
    pde = flux.term_rows(flux.project(r, *_basis(spark, size), "step"), ["step", "mode"], (3e4, 2e4, 5e4))
    terms = {"pde": pde, "ic": states("ic", "step = 0"), "data": states("data", "step > 0"), "well": table(spark, d, "lineitem").select(F.col("l_tax").alias("residual"))}
    out = residual.term_losses(terms, {"pde": 1.0, "ic": 0.5, "data": 2.0, "well": 3.0})
    return out.select("term", "n", F.round("loss", 5).alias("loss"), F.round("weighted", 5).alias("weighted"))


_WIDTHS = """WITH w AS (SELECT k, {pick} AS picked FROM range(1, 13) AS r(k)),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT c, stddev_pop(v[c + 1]) AS s FROM v, range(64) AS r(c) GROUP BY c),
cell AS (SELECT k, picked, {tol} * avg(s) AS cell FROM (SELECT k, picked, unnest(picked) AS c FROM w) JOIN s USING (c) GROUP BY k, picked)
SELECT k::INTEGER AS width, count(*) AS n_rows, count(DISTINCT list_transform(picked, lambda c: floor(v[c + 1] / cell + 0.5))) AS n_distinct, round(any_value(cell), 9) AS cell FROM v, cell GROUP BY k"""


@query(_WIDTHS.format(pick="range(k)", tol=2.0))
def distinct_by_width(spark, d):
    """How many embeddings each number of leading components tells apart."""
    return spectral.distinct_by_width(table(spark, d, "embeddings"), "embedding", [range(k) for k in range(1, 13)], 2.0).withColumn("cell", F.round("cell", 9))


@query(_WIDTHS.format(pick="CASE WHEN k < 4 THEN range(20, 20 + k) ELSE list_concat(range(40, 40 + k // 4), range(20, 20 + k - k // 4)) END", tol=1.5))
def distinct_by_selection(spark, d):
    """The same where the choice of components changes with their number: a quarter of them upright ones."""
    upright = [1.0 if c >= 40 else 0.0 for c in range(64)]
    values = [float((c - 20) % 64) for c in range(64)]
    picked = [[20 + c for c in range(k)] if k < 4 else spectral.retained(values, upright, k, k // 4) for k in range(1, 13)]
    return spectral.distinct_by_width(table(spark, d, "embeddings"), "embedding", picked, 1.5).withColumn("cell", F.round("cell", 9))


@query("""
WITH cell AS (SELECT c_custkey AS cell_id, c_custkey % 10 AS i, c_custkey // 10 % 5 AS j, c_custkey // 50 AS k, c_acctbal < 0 AS flat, 6.0 * (1 + c_nationkey % 3 * 0.1::DOUBLE) AS known FROM customer WHERE c_custkey % 17 <> 0),
corner AS (SELECT cell_id, flat, s, i + s % 2 AS x, j + s // 2 % 2 AS y, CASE WHEN flat THEN k ELSE k + s // 4 END AS z, CASE WHEN flat AND s >= 4 THEN cell_id * 8 + s ELSE -1 END AS own FROM cell, range(8) AS r(s)),
v AS (SELECT x, y, z, own, bool_or(NOT flat) AS used FROM corner GROUP BY 1, 2, 3, 4),
o AS (SELECT * FROM (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) AS t(di, dj, dk)),
f AS (SELECT c.cell_id, c.i, c.j, c.k, di, dj, dk FROM cell c, o WHERE NOT flat AND NOT EXISTS (SELECT 1 FROM cell n WHERE n.i = c.i + di AND n.j = c.j + dj AND n.k = c.k + dk)),
b AS (SELECT DISTINCT i + s % 2 AS x, j + s // 2 % 2 AS y, k + s // 4 AS z FROM f, range(8) AS r(s) WHERE (di = 0 OR s % 2 = (di > 0)::INT) AND (dj = 0 OR s // 2 % 2 = (dj > 0)::INT) AND (dk = 0 OR s // 4 = (dk > 0)::INT)),
e AS (SELECT abs(CASE WHEN flat THEN 0 ELSE 6 END - known) / known AS e FROM cell)
SELECT 'cells' AS step, unnest(['active', 'valid', 'borrowing', 'volume']) AS measure, unnest([count(*), count(*) FILTER (NOT flat), count(*) FILTER (flat), 6 * count(*) FILTER (NOT flat)])::DOUBLE AS value FROM cell
UNION ALL SELECT 'vertices', unnest(['made', 'reused']), unnest([count(*), 8 * (SELECT count(*) FROM cell) - count(*)])::DOUBLE FROM v UNION ALL SELECT 'kept', 'vertices', count(*) FILTER (used) FROM v
UNION ALL SELECT 'boundary', 'quads', count(*) FROM f UNION ALL SELECT 'boundary', 'vertices', count(*) FROM b UNION ALL SELECT 'volume_error', unnest(['mean', 'largest']), round(unnest([avg(e), max(e)]), 6) FROM e""")
def mesh_report(spark, d):
    """A grid of customers, inactive and collapsed ones among them, as a repaired mesh: what each step did."""
    c = F.col("c_custkey")
    i, j, k = c % 10, F.floor(c / 10) % 5, F.floor(c / 50)
    high = F.when(F.col("c_acctbal") < 0, 0).otherwise(3)
    corner = lambda s: [(i + s % 2).cast("double"), ((j + s // 2 % 2) * 2).cast("double"), (k * 3 + s // 4 * high).cast("double")]
    g = table(spark, d, "customer").select(c.alias("cell_id"), i.alias("i"), j.alias("j"), k.alias("k"), (c % 17 != 0).alias("active"), F.array(*[x for s in range(8) for x in corner(s)]).alias("corners"), (6.0 * (1 + F.col("c_nationkey") % 3 * 0.1)).alias("known"))
    r = mesh_build.build(g, volume="known").report.filter("measure NOT IN ('by_centroid', 'most_hops')")
    return r.select("step", "measure", F.when(F.col("step") == "volume_error", F.round("value", 6)).otherwise(F.round("value", 3)).alias("value"))
