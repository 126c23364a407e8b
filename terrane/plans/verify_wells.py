"""The well pack, its rates and the fluid closures bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import fluids
from terrane.operators import well_pack, wells
from terrane.plans.registry import query, table


def _r(c, n: int = 4):
    return F.round(c, n)


_OBSERVED = {"wopr": (3, 0.5), "wwpr": (4, 0.25), "wgpr": (5, 2.0), "wwir": (7, 0.75), "wgir": (11, 1.5)}


def _observed_sql(key, value):
    return ", ".join(f"CASE WHEN {key} % {m} = 0 THEN {value} * {f} END AS {c}" for c, (m, f) in _OBSERVED.items())


def _observed(key, value):
    return [F.when(F.col(key) % m == 0, F.col(value) * f).alias(c) for c, (m, f) in _OBSERVED.items()]


_SIM = f"SELECT o_orderkey, o_orderkey % 5 <> 0 AS is_open, CASE WHEN o_custkey % 4 = 0 THEN 'Injector' WHEN o_custkey % 4 < 3 THEN 'PRODUCER' END AS well_type, {_observed_sql('o_custkey', 'o_totalprice')}, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 10 END AS wbhp FROM orders"


@query(f"""
WITH s AS ({_SIM}),
t AS (SELECT *, coalesce(wopr, 0) + coalesce(wwpr, 0) + coalesce(wgpr, 0) AS made, coalesce(wwir, 0) + coalesce(wgir, 0) AS put FROM s),
u AS (SELECT *, coalesce(well_type LIKE 'Inj%', false) OR (put > 0 AND made = 0) AS injects FROM t),
v AS (SELECT *, CASE WHEN injects THEN CASE WHEN put > 0 THEN put END WHEN made > 0 THEN -made END AS rate FROM u),
k AS (SELECT *, CASE WHEN NOT is_open THEN NULL WHEN rate IS NOT NULL THEN 'rate' WHEN wbhp IS NOT NULL THEN 'bhp' END AS kind FROM v)
SELECT o_orderkey, kind AS syn_kind, CASE WHEN kind IS NULL THEN NULL WHEN injects THEN CASE WHEN wwir > 0 THEN 'WATER' WHEN wgir > 0 THEN 'GAS' END
  WHEN wopr > 0 THEN 'OIL' WHEN wwpr > 0 THEN 'WATER' WHEN wgpr > 0 THEN 'GAS' END AS syn_phase,
  CASE WHEN kind IS NOT NULL THEN round(rate, 6) END AS syn_rate, CASE WHEN kind IS NOT NULL THEN round(wbhp, 6) END AS syn_bhpt FROM k""")
def synthetic_control(spark, d):
    c = F.col("o_custkey") % 4
    s = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 != 0).alias("is_open"), F.when(c == 0, "Injector").when(c < 3, "PRODUCER").alias("well_type"), *_observed("o_custkey", "o_totalprice"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") / 10).alias("wbhp"))
    return well_pack.synthetic_control(s).select("o_orderkey", "syn_kind", "syn_phase", _r("syn_rate", 6).alias("syn_rate"), _r("syn_bhpt", 6).alias("syn_bhpt"))


@query("""
WITH p AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'),
c AS (SELECT * FROM events WHERE event_type IN ('signup', 'error')), o AS (SELECT * FROM events WHERE event_type = 'view'), k AS (SELECT * FROM events WHERE event_type = 'click'),
j AS (SELECT p.user_id, p.ts, c.ts AS cts, c.event_type AS ct, c.value AS cv, o.ts AS ots, o.value AS ov, k.value AS kv FROM p
  ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts ASOF LEFT JOIN o ON p.user_id = o.user_id AND p.ts >= o.ts ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.ts >= k.ts),
x AS (SELECT *, CASE WHEN cts IS NULL THEN NULL WHEN ots >= cts AND ov < 10 THEN 'closed' WHEN cv > 30 THEN 'rate' ELSE 'bhp' END AS deck FROM j WHERE kv IS NULL OR kv >= 5),
y AS (SELECT user_id, ts, coalesce(deck, CASE WHEN kv IS NOT NULL THEN 'rate' END) AS kind,
  CASE WHEN deck IS NULL THEN 'SIMULATION' WHEN ct = 'error' THEN 'WCONINJE' ELSE 'WCONPROD' END AS source,
  CASE WHEN deck IS NULL THEN -kv WHEN ct = 'error' THEN cv ELSE -cv END AS rate, CASE WHEN deck IS NULL THEN kv * 100 ELSE cv * 10 END AS bhpt FROM x),
f AS (SELECT DISTINCT user_id, p AS perf_id, ((user_id + p) % 3)::DOUBLE AS w FROM events, (VALUES (0), (1), (2)) AS n(p)),
z AS (SELECT y.*, perf_id, w, sum(w) OVER (PARTITION BY y.user_id, ts) AS sw FROM y JOIN f USING (user_id) WHERE kind IN ('rate', 'bhp'))
SELECT user_id::VARCHAR AS well, epoch_us(ts) AS at, perf_id, kind, source, 0 AS phase, CASE WHEN kind = 'bhp' THEN round(bhpt, 3) END AS p_bh,
  CASE WHEN kind = 'rate' THEN round(rate * CASE WHEN sw > 0 THEN w / sw ELSE 1 / 3.0::DOUBLE END, 3) END AS rate FROM z""")
def well_entries(spark, d):
    e = table(spark, d, "events").withColumn("well", F.col("user_id").cast("string"))
    kind, v = F.col("event_type"), F.col("value")
    report = e.filter("event_type = 'purchase'").select("well", "ts").distinct()
    source = F.when(kind == "signup", "WCONPROD").when(kind == "error", "WCONINJE").when(kind == "view", "WELOPEN")
    opened = kind == "view"
    schedule = e.filter(source.isNotNull()).select("well", "ts", F.col("event_id").alias("seq"), source.alias("source"), F.when(opened, F.when(v < 10, "SHUT").otherwise("OPEN")).alias("mode"), F.lit(None).cast("string").alias("control"), F.lit(None).cast("string").alias("phase"), F.when(~opened & (v > 30), v).alias("rate"), F.when(~opened, v * 10).alias("bhpt"))
    clicks = e.filter("event_type = 'click'")
    none = F.lit(None).cast("double")
    results = clicks.select("well", "ts", v.alias("wopr"), *[none.alias(c) for c in ("wwpr", "wgpr", "wwir", "wgir")], (v * 100).alias("wbhp"))
    simulated = clicks.select("well", "ts", (v >= 5).alias("is_open"), F.lit("PRODUCER").alias("well_type"))
    perfs = e.select("user_id", "well").distinct().select("well", "user_id", F.explode(F.array(*[F.lit(p) for p in range(3)])).alias("perf_id")).select("well", "perf_id", ((F.col("user_id") + F.col("perf_id")) % 3).cast("double").alias("weight"))
    out = well_pack.well_entries(report, schedule, simulated, results, perfs)
    return out.select("well", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "perf_id", "kind", "source", "phase", _r("p_bh", 3).alias("p_bh"), _r("rate", 3).alias("rate"))


@query("""
WITH p AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'),
c AS (SELECT *, CASE WHEN event_type = 'signup' THEN ['LRAT', 'ORAT', 'RESV'][event_id % 3 + 1] END AS control FROM events WHERE event_type IN ('signup', 'error')), k AS (SELECT * FROM events WHERE event_type = 'click'),
v AS (SELECT user_id, event_id % 26 AS cell, ts, value >= 8 AS is_open, CASE WHEN event_id % 5 = 0 THEN value END AS cf FROM events WHERE event_type = 'view'),
j AS (SELECT p.user_id, p.ts, c.event_type AS ct, c.value AS cv, control, k.value AS kv, k.event_id AS ke FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.ts >= k.ts),
x AS (SELECT *, CASE WHEN ct IS NULL THEN CASE WHEN kv IS NOT NULL THEN 'rate' END WHEN ct = 'signup' OR cv > 30 THEN 'rate' ELSE 'bhp' END AS kind, CASE WHEN ct IS NULL THEN 'SIMULATION' WHEN ct = 'error' THEN 'WCONINJE' ELSE 'WCONPROD' END AS source,
  CASE WHEN ct IS NULL THEN -(kv + kv / 3 + CASE WHEN ke % 2 = 0 THEN kv / 7 ELSE 0 END) WHEN cv > 30 THEN CASE WHEN ct = 'error' THEN cv ELSE -cv END END AS total, kv AS f0, kv / 3 AS f1, CASE WHEN ke % 2 = 0 THEN kv / 7 ELSE 0 END AS f2 FROM j WHERE kv IS NULL OR kv >= 5),
s AS (SELECT *, CASE WHEN kind = 'rate' AND kv IS NOT NULL AND control = 'LRAT' THEN [f0 / (f0 + f1), f1 / (f0 + f1), 0] WHEN kind = 'rate' AND kv IS NOT NULL AND control = 'RESV' THEN [f0 / (f0 + f1 + f2), f1 / (f0 + f1 + f2), f2 / (f0 + f1 + f2)] ELSE [1, 0, 0] END AS parts FROM x WHERE kind IS NOT NULL),
q AS (SELECT *, total * parts[phase + 1] AS rate FROM s, range(3) AS n(phase) WHERE parts[phase + 1] > 0),
b AS (SELECT n_nationkey AS cell, 10.0 + n_nationkey AS kx, 2 * (10.0 + n_nationkey) AS ky, 10.0 + n_nationkey AS h, sqrt(2::DOUBLE) AS ratio FROM nation),
w AS (SELECT cell, 2 * pi() * h * sqrt(kx * ky) / (ln(0.28 * sqrt(ratio * 1e4 + 6400 / ratio) / (sqrt(ratio) + 1 / sqrt(ratio)) / 0.5) + 0.25) AS wi FROM b),
o AS (SELECT t.user_id, t.cell, t.ts, v.cf FROM (SELECT p.user_id, p.ts, u.cell FROM p JOIN (SELECT DISTINCT user_id, cell FROM v) u ON u.user_id = p.user_id) t ASOF JOIN v ON t.user_id = v.user_id AND t.cell = v.cell AND t.ts >= v.ts WHERE is_open),
m AS (SELECT o.*, coalesce(cf, wi, 0) AS weight, CASE WHEN cf IS NULL AND wi IS NULL THEN 'no block' END AS why FROM o LEFT JOIN w USING (cell)),
z AS (SELECT q.user_id, q.ts, m.cell, kind, source, phase, rate, cv, weight, why, sum(weight) OVER g AS sw, count(*) OVER g AS n FROM q JOIN m ON m.user_id = q.user_id AND m.ts = q.ts WINDOW g AS (PARTITION BY q.user_id, q.ts, phase))
SELECT user_id::VARCHAR AS well, epoch_us(ts) AS at, cell AS perf_id, kind, source, phase::INTEGER AS phase, round(weight, 4) AS weight, CASE WHEN kind = 'bhp' THEN round(cv * 10, 3) END AS p_bh,
  CASE WHEN kind = 'rate' THEN round(rate * CASE WHEN sw > 0 THEN weight / sw ELSE 1 / n::DOUBLE END, 4) END AS rate, why FROM z WHERE kind = 'bhp' OR rate <> 0""")
def well_metadata(spark, d):
    """Controls, splits, completions by time and Peaceman's index of every report, in one plan."""
    e = table(spark, d, "events").withColumn("well", F.col("user_id").cast("string"))
    kind, v, n = F.col("event_type"), F.col("value"), F.col("event_id")
    none = F.lit(None).cast("double")
    report = e.filter("event_type = 'purchase'").select("well", "ts").distinct()
    code = F.when(kind == "signup", F.element_at(F.array(*map(F.lit, ("LRAT", "ORAT", "RESV"))), (n % 3 + 1).cast("int")))
    schedule = e.filter(kind.isin("signup", "error")).select("well", "ts", n.alias("seq"), F.when(kind == "signup", "WCONPROD").otherwise("WCONINJE").alias("source"), F.lit(None).cast("string").alias("mode"), code.alias("control"), F.lit(None).cast("string").alias("phase"), F.when(v > 30, v).alias("rate"), (v * 10).alias("bhpt"))
    clicks = e.filter("event_type = 'click'")
    results = clicks.select("well", "ts", v.alias("wopr"), (v / 3).alias("wwpr"), F.when(n % 2 == 0, v / 7).alias("wgpr"), none.alias("wwir"), none.alias("wgir"), (v * 100).alias("wbhp"))
    simulated = clicks.select("well", "ts", (v >= 5).alias("is_open"), F.lit("PRODUCER").alias("well_type"))
    completions = e.filter("event_type = 'view'").select("well", (n % 26).alias("cell_id"), "ts", n.alias("seq"), F.when(v >= 8, "OPEN").otherwise("SHUT").alias("status"), F.when(n % 5 == 0, v).alias("cf"), none.alias("r_w"), F.lit(0.25).alias("skin"))
    k = F.col("n_nationkey").cast("double")
    zero = F.lit(0.0)
    blocks = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("cell_id"), F.array(10 + k, zero, zero, zero, 2 * (10 + k), zero, zero, zero, F.lit(1.0)).alias("k"), zero.alias("tx"), zero.alias("ty"), F.lit(1.0).alias("tz"), F.lit(100.0).alias("hx"), F.lit(80.0).alias("hy"), (10 + k).alias("hz"))
    out = well_pack.well_metadata(report, schedule, simulated, results, completions, blocks)
    return out.select("well", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "perf_id", "kind", "source", "phase", _r("weight", 4).alias("weight"), _r("p_bh", 3).alias("p_bh"), _r("rate", 4).alias("rate"), "why")


@query("""
SELECT l_suppkey AS well, l_partkey AS perf_id, dense_rank() OVER (ORDER BY l_suppkey, l_partkey) - 1 AS perf_no, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS well_no
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def packed_ids(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("well"), F.col("l_partkey").alias("perf_id"))
    return well_pack.packed(p, once=True).select("well", "perf_id", "perf_no", "well_no")


@query("""
WITH s AS (SELECT l_linenumber AS report_step, l_suppkey AS well, sum(l_extendedprice) AS q, bool_or(l_quantity > 48) AS is_rate FROM lineitem WHERE l_suppkey % 3 <> 0 OR l_linenumber < 4 GROUP BY 1, 2)
SELECT report_step, well, coalesce(is_rate, false) AS is_rate, round(coalesce(q, 0), 2) AS q_ctrl, q IS NOT NULL AS active
FROM (SELECT DISTINCT l_linenumber AS report_step FROM lineitem) CROSS JOIN (SELECT s_suppkey AS well FROM supplier) LEFT JOIN s USING (report_step, well)""")
def dense_steps(spark, d):
    li = table(spark, d, "lineitem")
    s = li.filter("l_suppkey % 3 <> 0 OR l_linenumber < 4").groupBy(F.col("l_linenumber").alias("report_step"), F.col("l_suppkey").alias("well")).agg(F.sum("l_extendedprice").alias("q_ctrl"), F.bool_or(F.col("l_quantity") > 48).alias("is_rate"))
    out = well_pack.dense_steps(s, li.select(F.col("l_linenumber").alias("report_step")).distinct(), table(spark, d, "supplier").select(F.col("s_suppkey").alias("well")))
    return out.select("report_step", "well", "is_rate", _r("q_ctrl", 2).alias("q_ctrl"), "active")


_STEPS = f"""SELECT o_orderkey AS report_step, o_custkey AS well, o_totalprice / 1000 AS time, o_orderkey % 5 <> 0 AS active, o_orderpriority < '4' AS is_rate, (o_orderkey % 3)::INT AS ctrl_phase, o_totalprice - 200000 AS q_ctrl,
o_totalprice * 0.9 AS q_pin, o_custkey % 6 = 0 AS binding, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 10 END AS bhp_obs, {_observed_sql('o_orderkey', 'o_totalprice')} FROM orders"""
_NAMES = list(_OBSERVED)


def _steps(spark, d):
    c, p, k = F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("report_step"), c.alias("well"), (p / 1000).alias("time"), (k % 5 != 0).alias("active"), (F.col("o_orderpriority") < "4").alias("is_rate"), (k % 3).cast("int").alias("ctrl_phase"), (p - 200000).alias("q_ctrl"), (p * 0.9).alias("q_pin"), (c % 6 == 0).alias("binding"), F.when(c % 2 == 0, p / 10).alias("bhp_obs"), *_observed("o_orderkey", "o_totalprice"))


@query(f"""
WITH s AS ({_STEPS}), m AS (SELECT *, time BETWEEN 50 - 4e-4 AND 400 + 4e-4 AS in_ctrl, time BETWEEN 50 - 4e-4 AND 250 + 4e-4 AS in_obs FROM s)
SELECT report_step, in_ctrl, in_obs, binding AND in_obs AS binding, round(CASE WHEN in_obs THEN q_pin ELSE q_ctrl END, 6) AS q_pin,
  CASE WHEN in_obs THEN round(bhp_obs, 6) END AS bhp_obs, {', '.join(f'CASE WHEN in_obs THEN round({c}, 6) END AS {c}' for c in _NAMES)} FROM m""")
def windowed_steps(spark, d):
    x = well_pack.apply_windows(_steps(spark, d), "time", 50.0, 400.0, 250.0, _NAMES)
    return x.select("report_step", "in_ctrl", "in_obs", "binding", *[_r(c, 6).alias(c) for c in ("q_pin", "bhp_obs", *_NAMES)])


@query(f"""
WITH s AS ({_STEPS}) SELECT count(DISTINCT report_step) AS n_times, count(DISTINCT well) AS n_wells, count(bhp_obs) AS n_bhp, {' + '.join(f'count({c})' for c in _NAMES)} AS n_rate,
  count(bhp_obs) + {' + '.join(f'count({c})' for c in _NAMES)} AS n_rows FROM s""")
def pack_row_counts(spark, d):
    return well_pack.row_counts(_steps(spark, d), _NAMES)


@query(f"""
WITH s AS ({_STEPS}),
v AS (SELECT 0 AS phase, wopr AS v FROM s UNION ALL SELECT 1, wwpr FROM s UNION ALL SELECT 2, wgpr FROM s UNION ALL SELECT 1, wwir FROM s UNION ALL SELECT 2, wgir FROM s),
a AS (SELECT phase, coalesce(stddev_pop(v), 0) AS sd, coalesce(0.05 * avg(abs(v)), 0) AS m FROM v GROUP BY 1),
b AS (SELECT ctrl_phase AS phase, greatest(0.05 * avg(abs(q_ctrl)), 1) AS f FROM s WHERE is_rate GROUP BY 1),
c AS (SELECT phase, greatest(sd, m, coalesce(f, 1)) AS scale FROM a LEFT JOIN b USING (phase))
SELECT phase, round(greatest(scale, 1e-3 * (SELECT max(scale) FROM c)), 3) AS scale FROM c
UNION ALL SELECT NULL, round(greatest(stddev_pop(bhp_obs), 0.05 * avg(abs(bhp_obs)), 1), 3) FROM s""")
def pack_scales(spark, d):
    return well_pack.pack_scales(_steps(spark, d)).select("phase", _r("scale", 3).alias("scale"))


def _forcing_sql(phase, channels):
    seen = "coalesce(" + ", ".join(c for c, _ in channels) + ") IS NOT NULL"
    total = " + ".join(f"{s} * coalesce({c}, 0)" for c, s in channels)
    return f"CASE WHEN time > 200 + 1e-6 THEN CASE WHEN is_rate AND ctrl_phase = {phase} AND active THEN q_ctrl ELSE 0 END WHEN {seen} THEN {total} WHEN is_rate AND ctrl_phase = {phase} THEN q_ctrl ELSE 0 END"


@query(f"""
WITH s AS ({_STEPS}), f AS (SELECT c_custkey AS well, p AS perf_id, (1 + (c_custkey + p) % 4)::DOUBLE AS wi FROM customer, (VALUES (0), (1)) AS n(p)),
g AS (SELECT *, wi / greatest(sum(wi) OVER (PARTITION BY well), 1e-30) AS part FROM f),
q AS (SELECT report_step, well, {_forcing_sql(1, [('wwpr', -1), ('wwir', 1)])} AS w, {_forcing_sql(0, [('wopr', -1)])} AS o, {_forcing_sql(2, [('wgpr', -1), ('wgir', 1)])} AS g FROM s)
SELECT report_step, well, perf_id, round(q.w * part, 6) AS q_w, round(q.o * part, 6) AS q_o, round(q.g * part, 6) AS q_g FROM q JOIN g USING (well)""")
def well_forcing(spark, d):
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("well"), F.explode(F.array(F.lit(0), F.lit(1))).alias("perf_id")).withColumn("wi", (1 + (F.col("well") + F.col("perf_id")) % 4).cast("double"))
    q = well_pack.forcing(_steps(spark, d), f, controls_from=200.0)
    return q.select("report_step", "well", "perf_id", *[_r(c, 6).alias(c) for c in ("q_w", "q_o", "q_g")])


_PERF = """SELECT l_orderkey AS report_step, l_suppkey % 5 AS well, l_quantity / 10 AS wi, l_tax * 100 AS dz, l_discount AS rs, l_linenumber < 6 AS active, 900.0 + l_quantity AS p_wf,
l_quantity / 50 AS lam_w, l_discount * 4 AS lam_o, l_tax * 3 AS lam_g, 0.43 AS gamma_w, 0.35 AS gamma_o, 0.05 AS gamma_g, 1000.0 + l_quantity AS p_w, 1010.0 - l_quantity AS p_o, 890 + l_quantity AS p_g FROM lineitem"""


def _perforated(spark, d):
    q, x, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_step"), (F.col("l_suppkey") % 5).alias("well"), (q / 10).alias("wi"), (t * 100).alias("dz"), x.alias("rs"), (F.col("l_linenumber") < 6).alias("active"), (900.0 + q).alias("p_wf"), (q / 50).alias("lam_w"), (x * 4).alias("lam_o"), (t * 3).alias("lam_g"), F.lit(0.43).alias("gamma_w"), F.lit(0.35).alias("gamma_o"), F.lit(0.05).alias("gamma_g"), (1000.0 + q).alias("p_w"), (1010.0 - q).alias("p_o"), (890 + q).alias("p_g"))


_TOTALS = f"""WITH p AS ({_PERF}),
a AS (SELECT *, {', '.join(f'CASE WHEN active THEN 1 / 7::DOUBLE * wi * lam_{p} * (p_wf + gamma_{p} * dz - p_{p}) ELSE 0 END AS f_{p}' for p in 'wog')} FROM p),
t AS (SELECT report_step, well, sum(f_w) AS q_w, sum(f_o) AS q_o, sum(f_g + rs * f_o) AS q_g, bool_or(active) AS active FROM a GROUP BY 1, 2)"""


@query(_TOTALS + f" SELECT report_step, well, {', '.join(f'CASE WHEN round(q_{p}, 3) = 0 THEN 0 ELSE round(q_{p}, 3) END AS q_{p}' for p in 'wog')}, active FROM t")
def rates_at_head(spark, d):
    t = well_pack.well_totals(well_pack.rates_at(_perforated(spark, d), "p_wf", 1 / 7))
    return t.select("report_step", "well", *[_r(f"q_{p}", 3).alias(f"q_{p}") for p in "wog"], "active")


@query(_TOTALS + f" SELECT report_step, well, {', '.join(f'CASE WHEN {s} * {q} > -1e-9 AND active THEN round(greatest({s} * {q}, 0), 3) END AS {c}' for c, q, s in [('wopr', 'q_o', -1), ('wwpr', 'q_w', -1), ('wgpr', 'q_g', -1), ('wwir', 'q_w', 1), ('wgir', 'q_g', 1)])} FROM t")
def synthesized_channels(spark, d):
    t = well_pack.synthesized(well_pack.well_totals(well_pack.rates_at(_perforated(spark, d), "p_wf", 1 / 7)))
    return t.select("report_step", "well", *[_r(c, 3).alias(c) for c in _NAMES])


@query("""
WITH c AS (SELECT o_orderkey AS report_step, o_custkey AS well, o_totalprice AS q FROM orders WHERE o_orderpriority < '4'),
f AS (SELECT c_custkey AS well, p AS perf_id, ((c_custkey * p) % 3)::DOUBLE AS wi FROM customer, (VALUES (0), (1), (2)) AS n(p)),
j AS (SELECT *, sum(wi) OVER (PARTITION BY report_step, well) AS s, count(*) OVER (PARTITION BY report_step, well) AS n FROM c JOIN f USING (well))
SELECT report_step, well, perf_id, round(q * CASE WHEN s > 0 THEN wi / s ELSE 1.0::DOUBLE / n END, 3) AS q_perf FROM j""")
def split_rates(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_step"), F.col("o_custkey").alias("well"), F.when(F.col("o_orderpriority") < "4", "rate").otherwise("bhp").alias("kind"), F.col("o_totalprice").alias("rate"))
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("well"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("perf_id")).withColumn("wi", ((F.col("well") * F.col("perf_id")) % 3).cast("double"))
    return wells.split_rates(c, f).select("report_step", "well", "perf_id", _r("q_perf", 3).alias("q_perf"))


_WAY = {"wopr": (0, 0, -1), "wwpr": (1, 1, -1), "wgpr": (2, 2, -1), "wwir": (3, 1, 1), "wgir": (4, 2, 1)}


@query(f"""
WITH s AS ({_STEPS}), t AS (SELECT *, coalesce(nullif(q_ctrl * (o % 2), 0), {' + '.join(f'{s} * coalesce({c}, 0)' for c, (_, _, s) in _WAY.items())}) AS way FROM (SELECT *, report_step AS o FROM s)),
u AS ({' UNION ALL '.join(f'SELECT report_step, well, {n} AS channel, {p} AS phase, {s} * {c} AS obs, way FROM t' for c, (n, p, s) in _WAY.items())})
SELECT report_step, well, channel, phase, CASE WHEN sign(way) = 0 OR sign(obs) = sign(way) THEN round(obs, 6) END AS obs FROM u""")
def observed_channels(spark, d):
    x = _steps(spark, d).withColumn("q_ctrl", F.col("q_ctrl") * (F.col("report_step") % 2))
    return wells.observed_channels(x).select("report_step", "well", "channel", "phase", _r("obs", 6).alias("obs"))


@query("""
WITH p AS (SELECT l_orderkey AS report_step, l_suppkey % 4 AS well, l_linenumber % 3 AS ph, l_quantity / 10 AS wi, 0.1 + l_discount AS lo, 0.2 + l_tax AS lw, 0.3 + l_tax AS lg, 1000 + l_quantity * 20 AS p, l_tax * 1000 AS z FROM lineitem),
a AS (SELECT *, wi * CASE ph WHEN 1 THEN lw WHEN 2 THEN lg ELSE lo END AS a FROM p)
SELECT report_step, well, round(least(greatest((-500 + sum(a * (p - 0.4 * (z - 30)))) / greatest(sum(a), 1e-12), 800), 1900), 3) AS p_bh FROM a GROUP BY 1, 2""")
def closed_form_head(spark, d):
    q, x, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_step"), (F.col("l_suppkey") % 4).alias("well"), F.lit(-500.0).alias("q_pin"), (F.col("l_linenumber") % 3).alias("ctrl_phase"), (q / 10).alias("wi"), (0.1 + x).alias("lam_o"), (0.2 + t).alias("lam_w"), (0.3 + t).alias("lam_g"), (1000 + q * 20).alias("pressure"), F.lit(0.4).alias("gamma"), (t * 1000).alias("z_cell"), F.lit(30.0).alias("z_bh"))
    return wells.closed_form_head(p, 800.0, 1900.0).select("report_step", "well", _r("p_bh", 3).alias("p_bh"))


@query("""
WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice * 0.9 AS p_bh, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END AS bhp_obs FROM orders),
c AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_linenumber % 3 AS phase, l_extendedprice AS predicted, CASE WHEN l_quantity > 20 THEN l_quantity * 1000 END AS obs FROM lineitem)
SELECT 'bhp' AS grp, o_orderkey AS report_step, o_custkey AS well, -1 AS channel, round((p_bh - bhp_obs) / 70, 4) AS residual FROM h WHERE bhp_obs IS NOT NULL
UNION ALL SELECT 'channel', l_orderkey, l_suppkey, l_linenumber, round((predicted - obs) / CASE phase WHEN 0 THEN 70 WHEN 1 THEN 130 ELSE 370 END, 4) FROM c WHERE obs IS NOT NULL""")
def well_residual_rows(spark, d):
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_step"), F.col("o_custkey").alias("well"), (F.col("o_totalprice") * 0.9).alias("p_bh"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice")).alias("bhp_obs"))
    n = F.col("l_linenumber")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_step"), F.col("l_suppkey").alias("well"), n.alias("channel"), (n % 3).alias("phase"), F.col("l_extendedprice").alias("predicted"), F.when(F.col("l_quantity") > 20, F.col("l_quantity") * 1000).alias("obs"))
    scales = spark.createDataFrame([(0, 70.0), (1, 130.0), (2, 370.0)], "phase int, scale double")
    return wells.residual_rows(h, c, 70.0, scales).select("grp", "report_step", "well", "channel", _r("residual").alias("residual"))


@query("""
WITH t AS (SELECT p_partkey, p_retailprice AS a, (p_size - 25) * 20.0::DOUBLE AS b, p_retailprice / 2 + p_size AS c FROM part),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS hi, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS lo FROM t),
r AS (SELECT *, CASE WHEN lo > 0 AND a > 0 THEN sqrt(hi / lo) END AS q FROM e),
s AS (SELECT *, 0.28 * sqrt(q * 100 * 100 + 80 * 80 / q) / (sqrt(q) + 1 / sqrt(q)) AS re FROM r)
SELECT p_partkey, round(CASE WHEN q IS NOT NULL THEN sqrt(hi * lo) END, 4) AS k_eff, round(re, 6) AS r_e, round(CASE WHEN re > 0.25 THEN 2 * pi() * 12 * sqrt(hi * lo) / (ln(re / 0.25) + 0.5) END, 3) AS wi FROM s""")
def tensor_index(spark, d):
    a, n = F.col("p_retailprice"), F.col("p_size")
    w = wells.tensor_index(a, (n - 25) * 20.0, a / 2 + n, F.lit(100.0), F.lit(80.0), F.lit(12.0), F.lit(0.25), F.lit(0.5))
    return table(spark, d, "part").select("p_partkey", *[_r(w[c], n).alias(c) for c, n in (("k_eff", 4), ("r_e", 6), ("wi", 3))])


_SW, _SG, _P, _RS = "(l_quantity / 50 * 0.6 + 0.2)", "(l_discount * 1.5)", "(500 + l_extendedprice / 10)", "(l_tax * 15)"
_T = fluids.Tables(
    swof={"sw": [0.2, 0.4, 0.7, 1.0], "krw": [0.0, 0.05, 0.4, 1.0], "krow": [0.9, 0.5, 0.0, 0.0], "pcow": [8.0, 3.0, 1.0, 0.0]},
    sgof={"sg": [0.0, 0.1, 0.5, 0.7], "krg": [0.0, 0.0, 0.5, 0.8], "krog": [0.9, 0.6, 0.1, 0.0], "pcgo": [0.0, 0.5, 2.0, 5.0]},
    pvdg={"p": [100.0, 2000.0, 6000.0], "fvf": [30.0, 1.4, 0.6], "visc": [0.01, 0.018, 0.03]}, pvto={"rs": [0.0, 0.6, 1.5], "p": [15.0, 1500.0, 4000.0], "fvf": [1.05, 1.3, 1.8], "visc": [1.1, 0.8, 0.5]},
    pvtw={"p": 3000.0, "fvf": 1.03, "compr": 3e-6, "visc": 0.31, "viscosibility": 1e-6},
)


def _sql(x, y, q):
    parts = [f"WHEN {q} <= {x[0]} THEN {y[0]}"] + [f"WHEN {q} < {b} THEN {c} + ({q} - {a}) * {(e - c) / (b - a)!r}::DOUBLE" for a, b, c, e in zip(x, x[1:], y, y[1:], strict=False)]
    return f"(CASE {' '.join(parts)} ELSE {y[-1]} END)::DOUBLE"


_W, _G = _T.swof, _T.sgof
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]
_STATE = f"""SELECT l_orderkey, l_partkey, l_suppkey, {_P} AS po, {_SW} AS sw, {_SG} AS sg, {_RS} AS rs, {_sql(_W['sw'], _W['krw'], _SW)} AS krw, {_sql(_W['sw'], _W['krow'], _SW)} AS krow, {_sql(_W['sw'], _W['pcow'], _SW)} AS pcow,
{_sql(_G['sg'], _G['krg'], _SG)} AS krg, {_sql(_G['sg'], _G['krog'], _SG)} AS krog, {_sql(_G['sg'], _G['pcgo'], _SG)} AS pcgo, {_sql(_T.pvto['rs'], _T.pvto['fvf'], _RS)} AS bo, {_sql(_T.pvto['rs'], _T.pvto['visc'], _RS)} AS muo FROM lineitem"""


def _state(spark, d):
    return table(spark, d, "lineitem").select(*_KEYS, (500 + F.col("l_extendedprice") / 10).alias("po"), (F.col("l_quantity") / 50 * 0.6 + 0.2).alias("sw"), (F.col("l_discount") * 1.5).alias("sg"), (F.col("l_tax") * 15).alias("rs"))


@query(f"WITH s AS ({_STATE}) SELECT l_orderkey, l_partkey, l_suppkey, round(po - pcow, 8) AS p_w, round(po + pcgo, 8) AS p_g, round(1 - sw - sg, 6) AS s_o FROM s")
def phase_pressures(spark, d):
    p = _T.phase_pressures(F.col("po"), F.col("sw"), F.col("sg"))
    return _state(spark, d).select(*_KEYS, _r(p["p_w"], 8).alias("p_w"), _r(p["p_g"], 8).alias("p_g"), _r(p["s_o"], 6).alias("s_o"))


@query(f"WITH s AS ({_STATE}) SELECT l_orderkey, l_partkey, l_suppkey, round(bo, 6) AS bo, round(muo, 6) AS muo, round({_sql(_T.pvdg['p'], _T.pvdg['fvf'], 'po')}, 6) AS bg, round({_sql(_T.pvdg['p'], _T.pvdg['visc'], 'po')}, 8) AS mug FROM s")
def oil_gas_properties(spark, d):
    return _state(spark, d).select(*_KEYS, _r(_T.bo(F.col("rs")), 6).alias("bo"), _r(_T.muo(F.col("rs")), 6).alias("muo"), _r(_T.bg(F.col("po")), 6).alias("bg"), _r(_T.mug(F.col("po")), 8).alias("mug"))


_SWC, _SORW, _SORG = _T.residuals


@query(f"""
WITH s AS ({_STATE}), a AS (SELECT *, 1 - sg / {1 - _SWC - _SORG!r}::DOUBLE AS al FROM s), b AS (SELECT *, al * {_SORW!r}::DOUBLE + (1 - al) * {_SORG!r}::DOUBLE AS som FROM a),
c AS (SELECT *, greatest(1 - {_SWC}::DOUBLE - som, 1e-9) AS span FROM b),
e AS (SELECT *, least(greatest((1 - sw - sg - som) / span, 0), 1) AS so_, least(greatest((sw - {_SWC}::DOUBLE) / span, 0), 1) AS sw_, least(greatest(sg / span, 0), 1) AS sg_ FROM c)
SELECT l_orderkey, l_partkey, l_suppkey, round(greatest(so_ * krow * krog / ({_T.krc}::DOUBLE * greatest((1 - sw_) * (1 - sg_), 1e-9)), 0), 6) AS stone1,
  round(CASE WHEN sw - {_SWC}::DOUBLE + sg > 1e-9 THEN ((sw - {_SWC}::DOUBLE) * krow + sg * krog) / (sw - {_SWC}::DOUBLE + sg) ELSE krow END, 6) AS baker FROM e""")
def relperm_stone1(spark, d):
    sw, sg = F.col("sw"), F.col("sg")
    return _state(spark, d).select(*_KEYS, _r(_T.kro_stone1(sw, sg), 6).alias("stone1"), _r(_T.kro_baker(sw, sg), 6).alias("baker"))


_MOBILE = f"""WITH s AS ({_STATE}), k AS (SELECT *, greatest({_T.krc}::DOUBLE * ((krow / {_T.krc}::DOUBLE + krw) * (krog / {_T.krc}::DOUBLE + krg) - (krw + krg)), 0) AS kro, po - pcow AS pw, po + pcgo AS pg FROM s),
m AS (SELECT *, kro / greatest(muo * bo, 1e-12) AS lam_o, krw / greatest(0.31 / greatest(1 - 1e-6 * (pw - 3000), 1e-6) * (1.03 / greatest(1 + 3e-6 * (pw - 3000), 1e-6)), 1e-12) AS lam_w,
  krg / greatest({_sql(_T.pvdg['p'], _T.pvdg['visc'], 'pg')} * {_sql(_T.pvdg['p'], _T.pvdg['fvf'], 'pg')}, 1e-12) AS lam_g FROM k)"""


@query(_MOBILE + " SELECT l_orderkey, l_partkey, l_suppkey, round(lam_o, 5) AS lam_o, round(lam_w, 5) AS lam_w, round(lam_g, 4) AS lam_g FROM m")
def phase_mobilities(spark, d):
    m = _T.mobilities(F.col("po"), F.col("sw"), F.col("sg"), F.col("rs"))
    return _state(spark, d).select(*_KEYS, _r(m["o"], 5).alias("lam_o"), _r(m["w"], 5).alias("lam_w"), _r(m["g"]).alias("lam_g"))


@query(_MOBILE + """, i AS (SELECT *, l_suppkey % 3 = 0 AS inj, l_partkey % 3 AS ph, lam_o + lam_w + lam_g AS total FROM m)
SELECT l_orderkey, l_partkey, l_suppkey, """ + ", ".join(f"round(CASE WHEN inj THEN CASE WHEN ph = {n} THEN total ELSE 0 END ELSE lam_{p} END, 4) AS lam_{p}" for n, p in enumerate("owg")) + " FROM i")
def perforation_state(spark, d):
    x = _state(spark, d).withColumnRenamed("po", "pressure").withColumnRenamed("sw", "swat").withColumnRenamed("sg", "sgas").withColumn("is_inj", F.col("l_suppkey") % 3 == 0).withColumn("inj_phase", F.col("l_partkey") % 3)
    return wells.perforation_state(x, _T).select(*_KEYS, *[_r(f"lam_{p}").alias(f"lam_{p}") for p in "owg"])


@query(f"WITH s AS ({_STATE}) SELECT l_suppkey, round(sum(1000 * (1 / 5.614583::DOUBLE) * 0.25 * (1 - sw - sg) / bo), 3) AS oil, round(sum(1000 * (1 / 5.614583::DOUBLE) * 0.25 * sw / 1.03), 3) AS water FROM s GROUP BY 1")
def fluid_in_place(spark, d):
    oil = fluids.in_place(F.lit(1000.0), F.lit(0.25), 1 - F.col("sw") - F.col("sg"), _T.bo(F.col("rs")))
    water = fluids.in_place(F.lit(1000.0), F.lit(0.25), F.col("sw"), F.lit(1.03))
    return _state(spark, d).groupBy("l_suppkey").agg(_r(F.sum(oil), 3).alias("oil"), _r(F.sum(water), 3).alias("water"))
