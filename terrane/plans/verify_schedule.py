"""Schedule and well operators bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import schedule as sch
from terrane.operators import wells
from terrane.plans.registry import query, table


def _r(c, n: int = 4):
    return F.round(c, n)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity BETWEEN 10 - 5e-5 AND 50 + 5e-5 AS in_span, l_quantity BETWEEN 10 - 5e-5 AND 30 + 5e-5 AS in_obs, 1 - l_discount * 8 - l_tax * 2 > 1e-3 AS gas_seen FROM lineitem")
def window_masks(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sch.in_span(q, 10, 50).alias("in_span"), sch.in_span(q, 10, 30, 50).alias("in_obs"), sch.gas_is_observed(F.col("l_discount") * 8, F.col("l_tax") * 2).alias("gas_seen"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 7 AND 20 AND p_partkey >= 30")
def slice_view(spark, d):
    return sch.slice_view(table(spark, d, "part").select("p_partkey", "p_size"), p_size=(7, 20), p_partkey=(30, None))


_STEPS = """SELECT o_orderkey AS report_step, o_custkey AS well, o_orderpriority < '3' AS is_rate, o_totalprice - 150000 AS q_ctrl, (o_orderkey % 3)::INT AS ctrl_phase,
CASE WHEN o_custkey % 5 = 0 THEN o_totalprice - 200000 END AS inj_water, CASE WHEN o_custkey % 7 = 0 THEN o_totalprice - 250000 END AS inj_gas FROM orders"""


def _steps(spark, d):
    o = table(spark, d, "orders")
    p, c = F.col("o_totalprice"), F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("report_step"), c.alias("well"), (F.col("o_orderpriority") < "3").alias("is_rate"), (p - 150000).alias("q_ctrl"), (F.col("o_orderkey") % 3).cast("int").alias("ctrl_phase"), F.when(c % 5 == 0, p - 200000).alias("inj_water"), F.when(c % 7 == 0, p - 250000).alias("inj_gas"))


@query(f"""
WITH s AS ({_STEPS}),
h AS (SELECT well, coalesce(bool_or(inj_water > 0), false) AS w, coalesce(bool_or(inj_gas > 0), false) AS g, coalesce(bool_or(q_ctrl > 0), false) AS r,
  arg_min(ctrl_phase, report_step) FILTER (q_ctrl > 0) AS p FROM s GROUP BY well)
SELECT report_step, well, CASE WHEN is_rate THEN q_ctrl > 0 ELSE w OR g OR r END AS is_inj,
  CASE WHEN is_rate THEN ctrl_phase WHEN w THEN 1 WHEN g THEN 2 ELSE coalesce(p, 2) END AS inj_phase FROM s JOIN h USING (well)""")
def injector_flags(spark, d):
    return sch.injector_flags(_steps(spark, d)).select("report_step", "well", "is_inj", "inj_phase")


@query("""
WITH c AS (SELECT c_acctbal - 4000 AS rate, c_acctbal / 2 + 100 AS bhpt FROM customer),
l AS (SELECT max(CASE WHEN rate > 0 THEN bhpt END) AS cap, min(CASE WHEN rate < 0 THEN bhpt END) AS low FROM c),
s AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)
SELECT round(cap, 2) AS inj_cap, round(low, 2) AS prod_floor, floor(greatest(0.0, lo - 0.1 * (hi - lo)) / 50) * 50.0 AS p_min,
  ceil(greatest(hi + 0.1 * (hi - lo), cap) / 50) * 50.0 AS p_max, round((ceil(1.27 / 0.05) + 2) * 0.05, 6)::DOUBLE AS rs_max FROM l, s""")
def output_ranges(spark, d):
    c = table(spark, d, "customer").select((F.col("c_acctbal") - 4000).alias("rate"), (F.col("c_acctbal") / 2 + 100).alias("bhpt"))
    limits = sch.head_limits(c)
    found = sch.output_ranges(table(spark, d, "supplier"), limits, "s_acctbal", 1.27, 50.0, 0.1, 0.05, 2)
    return limits.crossJoin(found).select(_r("inj_cap", 2).alias("inj_cap"), _r("prod_floor", 2).alias("prod_floor"), "p_min", "p_max", "rs_max")


@query("SELECT l_returnflag, l_linestatus, round(coalesce(stddev_pop(l_extendedprice), 0) + 1e-12, 4) AS scale FROM lineitem GROUP BY 1, 2")
def residual_scales(spark, d):
    return sch.residual_scales(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").select("l_returnflag", "l_linestatus", _r("scale").alias("scale"))


@query("""
SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def first_of_each(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return sch.first_of_each(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", _r("value").alias("value"))


@query("""
SELECT user_id, arg_min(event_id, ts) AS first, arg_max(event_id, ts) AS last, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 1""")
def group_ends(spark, d):
    return sch.ends(table(spark, d, "events").filter("event_type = 'error'"), ["user_id"], "ts", "event_id").filter("n > 1")


@query("""
WITH a AS (SELECT c_custkey, c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey, 100 + c_nationkey AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT 'w' AS mode, c_custkey, v FROM (SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) UNION ALL SELECT * FROM b)
UNION ALL SELECT 'a', c_custkey, v FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def tree_upsert(spark, d):
    c = table(spark, d, "customer")
    a = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_nationkey").alias("v"))
    b = c.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_nationkey") + 100).alias("v"))
    w, x = (sch.upsert(a, b, ["c_custkey"], m).select(F.lit(m).alias("mode"), "c_custkey", "v") for m in "wa")
    return w.unionByName(x)


@query("SELECT 0 AS source_no, 'one' AS source, n_nationkey AS id FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 1, 'two', n_nationkey FROM nation WHERE n_regionkey > 1")
def merged_sources(spark, d):
    n = table(spark, d, "nation").withColumn("id", F.col("n_nationkey"))
    return sch.merged([("one", n.filter("n_regionkey < 3")), ("two", n.filter("n_regionkey > 1"))]).select("source_no", "source", "id")


@query("SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS slot FROM lineitem")
def rank_in_run(spark, d):
    li = sch.rank_in_run(table(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"])
    return li.select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("slot").cast("long").alias("slot"))


@query("""
WITH t AS (SELECT s_nationkey AS k, s_suppkey AS o, s_acctbal AS x, (s_suppkey % 17) * 500.0::DOUBLE AS y FROM supplier),
g AS (SELECT k, o, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM t WINDOW w AS (PARTITION BY k ORDER BY o)),
s AS (SELECT *, dx * dx + dy * dy AS l FROM g WHERE dx * dx + dy * dy > 1e-12),
p AS (SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS px, (c_custkey % 13) * 700.0::DOUBLE AS py FROM customer),
j AS (SELECT p.*, s.*, least(greatest(((px - x) * dx + (py - y) * dy) / l, 0.0), 1.0) AS tau FROM p JOIN s USING (k))
SELECT id, round(arg_min(dx, struct_pack(g := pow(px - x - tau * dx, 2) + pow(py - y - tau * dy, 2), o := o)), 4) AS dx,
  round(arg_min(dy, struct_pack(g := pow(px - x - tau * dx, 2) + pow(py - y - tau * dy, 2), o := o)), 4) AS dy FROM j GROUP BY id""")
def nearest_segment(spark, d):
    track = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("o"), F.col("s_acctbal").alias("x"), ((F.col("s_suppkey") % 17) * 500.0).alias("y"))
    points = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") % 13) * 700.0).alias("y"))
    return sch.nearest_segment(points, track, "k", ["x", "y"], "o").select("id", _r("tangent.x").alias("dx"), _r("tangent.y").alias("dy"))


@query("SELECT p_size, round(m, 4) AS m FROM (SELECT p_size, avg(p_retailprice) AS m FROM part GROUP BY 1) ORDER BY m, p_size LIMIT 4")
def worst_components(spark, d):
    rows = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m"))
    return sch.worst(rows, "m", 4, ["p_size"]).select("p_size", _r("m").alias("m"))


@query("SELECT l_suppkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount < 0.02 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def shared_indices(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return sch.shared({"a": li.filter("l_quantity > 45"), "b": li.filter("l_discount < 0.02"), "c": s}, ["l_suppkey"])


_SPLIT = "SELECT o_orderkey, o_totalprice - 150000 AS rate, CASE WHEN o_custkey % 4 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE o_custkey * 1.0 END END AS obs_0, CASE WHEN o_custkey % 4 <> 0 AND o_custkey % 5 = 0 THEN o_custkey * 2.0 END AS obs_1, CAST(NULL AS DOUBLE) AS obs_2 FROM orders"


@query(f"""
WITH s AS ({_SPLIT})
SELECT o_orderkey, phase, round(r, 2) AS rate FROM (
SELECT o_orderkey, 0 AS phase, obs_0 AS r FROM s WHERE obs_0 <> 0 UNION ALL SELECT o_orderkey, 1, obs_1 FROM s WHERE obs_1 <> 0
UNION ALL SELECT o_orderkey, CASE WHEN rate > 0 THEN 1 ELSE 0 END, rate FROM s WHERE coalesce(obs_0, obs_1, obs_2) IS NULL)""")
def phase_split(spark, d):
    c, p = F.col("o_custkey"), F.col("o_totalprice")
    rows = table(spark, d, "orders").select("o_orderkey", (p - 150000).alias("rate"), F.when(c % 4 != 0, F.when(c % 3 == 0, 0.0).otherwise(c * 1.0)).alias("obs_0"), F.when((c % 4 != 0) & (c % 5 == 0), c * 2.0).alias("obs_1"), F.lit(None).cast("double").alias("obs_2"))
    return wells.phase_split(rows).select("o_orderkey", "phase", _r("rate", 2).alias("rate"))


@query("""
WITH r AS (SELECT l_orderkey AS report_step, l_suppkey AS well, l_quantity > 10 AS is_rate, l_extendedprice AS q, l_linenumber % 3 AS phase, l_tax * 1000 AS bhp FROM lineitem),
g AS (SELECT report_step, well, bool_or(is_rate) AS is_rate, sum(q) FILTER (is_rate) AS q, avg(bhp) AS bhp,
  count(*) FILTER (is_rate AND phase = 0) AS n0, count(*) FILTER (is_rate AND phase = 1) AS n1, count(*) FILTER (is_rate AND phase = 2) AS n2 FROM r GROUP BY 1, 2)
SELECT report_step, well, is_rate, CASE WHEN is_rate THEN round(q, 2) END AS q_ctrl,
  CASE WHEN is_rate THEN CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END END AS ctrl_phase, CASE WHEN NOT is_rate THEN round(bhp, 4) END AS p_bh_ctrl FROM g""")
def packed_steps(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_step"), F.col("l_suppkey").alias("well"), (F.col("l_quantity") > 10).alias("is_rate"), F.col("l_extendedprice").alias("q"), (F.col("l_linenumber") % 3).alias("phase"), (F.col("l_tax") * 1000).alias("bhp_target"))
    return wells.pack_steps(li).select("report_step", "well", "is_rate", _r("q_ctrl", 2).alias("q_ctrl"), "ctrl_phase", _r("p_bh_ctrl").alias("p_bh_ctrl"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority < '4' AS is_rate, (o_orderkey % 3)::INT AS ctrl_phase, o_totalprice AS q_ctrl,
  CASE WHEN o_custkey % 6 <> 0 THEN o_totalprice * (0.75 + (o_custkey % 4) * 0.25)::DOUBLE END AS q_obs, CASE WHEN o_custkey % 2 = 0 THEN 1.0 END AS bhp_obs FROM orders)
SELECT o_orderkey, round(CASE WHEN ctrl_phase = 2 THEN q_ctrl ELSE coalesce(q_obs, q_ctrl) END, 4) AS q_pin,
  coalesce(is_rate AND bhp_obs IS NOT NULL AND abs(q_obs) < 0.99 * abs(q_ctrl), false) AS binding FROM s""")
def realized_mode(spark, d):
    c, p = F.col("o_custkey"), F.col("o_totalprice")
    s = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") < "4").alias("is_rate"), (F.col("o_orderkey") % 3).cast("int").alias("ctrl_phase"), p.alias("q_ctrl"), F.when(c % 6 != 0, p * (F.lit(0.75) + (c % 4) * 0.25)).alias("q_obs"), F.when(c % 2 == 0, 1.0).alias("bhp_obs"))
    return wells.realized_mode(s).select("o_orderkey", _r("q_pin").alias("q_pin"), "binding")


@query("""
WITH s AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS o, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal * 1.5 END AS k FROM customer),
r AS (SELECT least(coalesce(least(min(o), min(k)), 900), 900) AS a, greatest(coalesce(greatest(max(o), max(k)), 5100), 5100) AS b FROM s)
SELECT round(a - 0.05 * (b - a), 4) AS lo, round(b + 0.05 * (b - a), 4) AS hi FROM r""")
def head_range(spark, d):
    k = F.col("c_custkey") % 3
    s = table(spark, d, "customer").select(F.when(k == 0, F.col("c_acctbal")).alias("bhp_obs"), F.when(k == 1, F.col("c_acctbal") * 1.5).alias("p_bh_ctrl"))
    return wells.head_range(s, 900.0, 5100.0).select(_r("lo").alias("lo"), _r("hi").alias("hi"))
