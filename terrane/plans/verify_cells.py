"""Grid, graph, box and fluid operators bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import fluids
from terrane.operators import aggregates as agg
from terrane.operators import cells, graph, windows
from terrane.plans.registry import query, table


def _r(c, n: int = 4):
    return F.round(c, n)


_LATTICE = "SELECT DISTINCT p_size AS i, CAST(substr(p_brand, 7) AS INT) AS j FROM part WHERE (p_size * 7 + CAST(substr(p_brand, 7) AS INT)) % 4 <> 0"


def _lattice(spark, d):
    j = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return table(spark, d, "part").select(F.col("p_size").alias("i"), j.alias("j")).filter("(i * 7 + j) % 4 <> 0").distinct()


@query(f"""
WITH c AS ({_LATTICE}), f AS (SELECT i, j, di, dj FROM c, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(di, dj))
SELECT f.i, f.j, f.di, f.dj FROM f LEFT JOIN c ON c.i = f.i + f.di AND c.j = f.j + f.dj WHERE c.i IS NULL""")
def neighbor_boundary(spark, d):
    return cells.boundary_faces(_lattice(spark, d), ["i", "j"]).select("i", "j", F.col("d_i").alias("di"), F.col("d_j").alias("dj"))


@query()  # recursion over whole components is too slow; tests compare with union-find
def connected_components(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") + 1000000000).alias("dst")).distinct()
    return graph.connected_components(e)


@query()  # a recursion without a bound on hops never ends; tests compare with a breadth-first search
def bfs_owner_hops(spark, d):
    c = _lattice(spark, d).withColumn("id", F.col("i") * 1000 + F.col("j"))
    seeds = c.filter("(i + j) % 23 = 0").select("i", "j", F.col("id").alias("owner"))
    return cells.owners(c.select("i", "j"), seeds, ["i", "j"]).select("i", "j", "hops", "owner")


@query("""
SELECT bi::INT AS bi, bj::INT AS bj, round(sum(v), 2) AS v, avg(a::INT) > 0.5 AS active FROM (
SELECT p_size // 2 AS bi, CAST(substr(p_brand, 7) AS INT) // 2 AS bj, p_retailprice AS v, p_retailprice > 1400 AS a FROM part) GROUP BY 1, 2""")
def block_upscale_vote(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("bi"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("bj"), F.col("p_retailprice").alias("v"), (F.col("p_retailprice") > 1400).cast("int").alias("a"))
    return agg.upscale(p, {"bi": 2, "bj": 2}, [_r(F.sum("v"), 2).alias("v"), (F.avg("a") > 0.5).alias("active")]).withColumns({c: F.col(c).cast("int") for c in ("bi", "bj")})


@query("""
WITH a AS (SELECT p_partkey, p_size AS i, p_retailprice AS poro FROM part),
b AS (SELECT p_partkey, i, CASE WHEN i BETWEEN 1 AND 10 THEN 0.25 ELSE poro END AS poro FROM a),
c AS (SELECT p_partkey, i, CASE WHEN i BETWEEN 5 AND 30 THEN poro * 2 ELSE poro END AS poro FROM b),
e AS (SELECT p_partkey, i, poro, CASE WHEN i BETWEEN 8 AND 40 THEN poro END AS permx FROM c)
SELECT p_partkey, round(CASE WHEN i BETWEEN 20 AND 22 THEN poro + 1 ELSE poro END, 4) AS poro, round(permx, 4) AS permx FROM e""")
def box_update_sequence(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("i"), F.col("p_retailprice").alias("poro"), F.lit(None).cast("double").alias("permx"))
    steps = [
        cells.BoxStep("EQUALS", "poro", 0.25, {"i": (1, 10)}),
        cells.BoxStep("MULTIPLY", "poro", 2.0, {"i": (5, 30)}),
        cells.BoxStep("COPY", "permx", "poro", {"i": (8, 40)}),
        cells.BoxStep("ADD", "poro", 1.0, {"i": (20, 22)}),
    ]
    return cells.apply_boxes(p, steps).select("p_partkey", _r("poro").alias("poro"), _r("permx").alias("permx"))


@query("""
SELECT p_partkey, round(sum(s) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - s, 4) AS top
FROM (SELECT *, p_size / 2.0 AS s FROM part)""")
def layer_tops(spark, d):
    p = table(spark, d, "part").withColumn("s", F.col("p_size") / 2.0)
    return windows.running_tops(p, ["p_brand"], ["p_partkey"], "s").select("p_partkey", _r("top").alias("top"))


@query("""
SELECT p_partkey, (id % 4)::INT AS i, (id // 4 % 5)::INT AS j, (id // 20)::INT AS k FROM (SELECT p_partkey, p_partkey % 60 AS id FROM part)""")
def cell_addresses(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 60).alias("id"))
    i, j, k = cells.address(F.col("id"), 4, 5)
    return p.select("p_partkey", i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))


_SW, _KRW, _KROW = [0.0, 0.2, 0.5, 0.8, 1.0], [0.0, 0.0, 0.1, 0.45, 1.0], [1.0, 0.9, 0.35, 0.02, 0.0]
_SG, _KRG, _KROG = [0.0, 0.1, 0.4, 0.8], [0.0, 0.02, 0.3, 0.9], [1.0, 0.7, 0.1, 0.0]
TABLES = fluids.Tables(
    swof={"sw": _SW, "krw": _KRW, "krow": _KROW, "pcow": []}, sgof={"sg": _SG, "krg": _KRG, "krog": _KROG, "pcgo": []},
    pvdg={"p": [100.0, 4000.0], "fvf": [30.0, 0.7], "visc": [0.01, 0.025]}, pvto={"rs": [0.0, 1.5], "p": [15.0, 4000.0], "fvf": [1.05, 1.8], "visc": [1.1, 0.5]},
    pvtw={"p": 3000.0, "fvf": 1.03, "compr": 3e-6, "visc": 0.31, "viscosibility": 0.0},
)


def _sql_curve(x, y, q):
    parts = [f"WHEN {q} <= {x[0]} THEN {y[0]}"] + [f"WHEN {q} < {b} THEN {c} + ({q} - {a}) * {(e - c) / (b - a)!r}" for a, b, c, e in zip(x, x[1:], y, y[1:], strict=False)]
    return f"(CASE {' '.join(parts)} ELSE {y[-1]} END)"


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity / 50 * 0.7 + 0.1 AS sw, l_discount * 2 AS sg FROM lineitem),
k AS (SELECT *, {_sql_curve(_SW, _KRW, 'sw')} AS krw, {_sql_curve(_SW, _KROW, 'sw')} AS krow, {_sql_curve(_SG, _KRG, 'sg')} AS krg, {_sql_curve(_SG, _KROG, 'sg')} AS krog FROM s)
SELECT l_orderkey, l_partkey, l_suppkey, round(krw, 6) AS krw, round(greatest((krow + krw) * (krog + krg) - (krw + krg), 0), 6) AS kro FROM k""")
def relperm_stone2(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50 * 0.7 + 0.1).alias("sw"), (F.col("l_discount") * 2).alias("sg"))
    return s.select("l_orderkey", "l_partkey", "l_suppkey", _r(TABLES.krw(F.col("sw")), 6).alias("krw"), _r(TABLES.kro_stone2(F.col("sw"), F.col("sg")), 6).alias("kro"))


@query("SELECT o_orderkey, round(1.03 / greatest(1 + 3e-6 * (o_totalprice / 100 - 3000), 1e-6), 8) AS bw, round(0.31 / greatest(1 - 0.0 * (o_totalprice / 100 - 3000), 1e-6), 8) AS muw FROM orders")
def water_properties(spark, d):
    p = F.col("o_totalprice") / 100
    return table(spark, d, "orders").select("o_orderkey", _r(TABLES.bw(p), 8).alias("bw"), _r(TABLES.muw(p), 8).alias("muw"))
