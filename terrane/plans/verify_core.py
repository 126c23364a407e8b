"""The relational operators bound to the driver's tables, each beside its SQL.

Roles: users are wells, event types are schedule sources, purchases are report times,
line quantities are perforation weights, part sizes are layers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions import sampling, scalars, units
from terrane.operators import aggregates as agg
from terrane.operators import joins, temporal, windows
from terrane.plans.registry import query, table
from terrane.streaming import messages


def _events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = table(spark, d, "events")
    return e if kind is None else e.filter(F.col("event_type") == kind)


def _r(c, n: int = 4):
    return F.round(c, n)


@query("""
SELECT p.event_id, p.user_id, s.event_id AS control_id, round(s.value, 4) AS control_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_latest_row(spark, d):
    m = temporal.asof(_events(spark, d, "purchase"), _events(spark, d, "signup"), ["user_id"], "ts", "ts")
    return m.select("event_id", "user_id", F.col("match.event_id").alias("control_id"), _r("match.value").alias("control_value"))


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
s AS (SELECT * FROM events WHERE event_type IN ('signup', 'error')),
w AS (SELECT * FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, p.user_id, s.event_type AS source, s.ts AS sts, s.value AS sval, w.ts AS wts, w.value AS wval
FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts >= w.ts)
SELECT event_id, user_id, source, CASE WHEN source IS NULL THEN 'none' WHEN wts >= sts AND wval < 10 THEN 'closed' WHEN sval > 50 THEN 'rate' ELSE 'bhp' END AS control FROM j""")
def asof_with_precedence(spark, d):
    m = temporal.asof_precedence(_events(spark, d, "purchase"), [(k, _events(spark, d, k)) for k in ("signup", "error")], ["user_id"], "ts", "ts", name="c")
    m = temporal.asof(m, _events(spark, d, "view"), ["user_id"], "ts", "ts", name="w")
    closed = (F.col("w.ts") >= F.col("c.ts")) & (F.col("w.value") < 10)
    control = F.when(F.col("c").isNull(), "none").when(F.coalesce(closed, F.lit(False)), "closed").when(F.col("c.value") > 50, "rate").otherwise("bhp")
    return m.select("event_id", "user_id", F.col("c.source").alias("source"), control.alias("control"))


@query("""
WITH s AS (SELECT * FROM events WHERE event_type = 'signup')
SELECT p.event_id, coalesce(s.event_id, f.event_id) AS snapshot_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts
LEFT JOIN (SELECT user_id, arg_min(event_id, ts) AS event_id FROM s GROUP BY 1) f ON f.user_id = p.user_id""")
def asof_fallback_first(spark, d):
    m = temporal.asof_or_first(_events(spark, d, "purchase"), _events(spark, d, "signup"), ["user_id"], "ts", "ts")
    return m.select("event_id", F.col("match.event_id").alias("snapshot_id"))


@query("""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS block FROM events),
q AS (SELECT p.event_id, p.user_id, p.ts, b.block FROM (SELECT * FROM e WHERE event_type = 'purchase') p, (SELECT unnest([0, 1, 2, 3]) AS block) b)
SELECT q.event_id, count(*) AS n_open FROM q ASOF JOIN (SELECT * FROM e WHERE event_type = 'view') c
ON q.user_id = c.user_id AND q.block = c.block AND q.ts >= c.ts WHERE c.value >= 20 GROUP BY 1""")
def asof_per_key_open(spark, d):
    e = _events(spark, d).withColumn("block", F.get_json_object("props", "$.k").cast("long") % 4)
    q = e.filter("event_type = 'purchase'").drop("block").withColumn("block", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])))
    m = temporal.asof(q, e.filter("event_type = 'view'"), ["user_id", "block"], "ts", "ts")
    return m.filter("match.value >= 20").groupBy("event_id").agg(F.count("*").alias("n_open"))


@query("""
SELECT o_custkey, o_orderkey, round(sum(alloc), 2) AS allocated, count(*) AS n FROM (
SELECT o_custkey, o_orderkey, o_totalprice * l_quantity / greatest(sum(l_quantity) OVER (PARTITION BY o_orderkey), 1e-30) AS alloc
FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1, 2""")
def allocate_by_weight(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a = agg.allocate(j.select("o_custkey", "o_orderkey", "o_totalprice", "l_quantity"), ["o_orderkey"], "o_totalprice", "l_quantity")
    return a.groupBy("o_custkey", "o_orderkey").agg(_r(F.sum("allocated"), 2).alias("allocated"), F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, round(1000 * CASE WHEN s > 0 THEN w / s ELSE 1.0 / n END, 4) AS part FROM (
SELECT *, sum(w) OVER (PARTITION BY l_orderkey) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (
SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE l_quantity END AS w FROM lineitem))""")
def allocate_equal_fallback(spark, d):
    w = table(spark, d, "lineitem").withColumn("w", F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity"))).withColumn("t", F.lit(1000.0))
    return agg.allocate_or_equal(w, ["l_orderkey"], "t", "w").select("l_orderkey", "l_partkey", "l_suppkey", _r("allocated").alias("part"))


@query("""
SELECT l_partkey, round(sum(w * l_extendedprice) / sum(w), 2) AS mean FROM (
SELECT *, CASE WHEN l_quantity > 5 THEN l_quantity ELSE 1.0 END AS w FROM lineitem) GROUP BY 1""")
def weighted_mean_by_owner(spark, d):
    li = table(spark, d, "lineitem").withColumn("w", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(F.lit(-1.0)))
    return agg.weighted_mean(li, ["l_partkey"], "l_extendedprice", "w").select("l_partkey", _r("mean", 2).alias("mean"))


@query("""
SELECT p_size, round(m, 4) AS mean, round((m + lead(m) OVER (ORDER BY p_size)) / 2, 4) AS boundary
FROM (SELECT p_size, avg(p_retailprice) AS m FROM part GROUP BY 1)""")
def layer_profile_midpoints(spark, d):
    return agg.layer_profile(table(spark, d, "part"), "p_size", "p_retailprice").select("p_size", _r("mean").alias("mean"), _r("boundary").alias("boundary"))


@query("""
WITH b AS (SELECT n_nationkey * 450.0 AS z FROM nation)
SELECT o_orderkey, (SELECT count(*) FROM b WHERE z < o_totalprice) AS layer FROM orders""")
def layer_lookup_range_join(spark, d):
    b = table(spark, d, "nation").select((F.col("n_nationkey") * 450.0).alias("z"))
    return joins.layer_of(table(spark, d, "orders"), b, "z", "o_totalprice").select("o_orderkey", F.col("layer").cast("long").alias("layer"))


def _curve(spark, d):
    return table(spark, d, "part").groupBy((F.col("p_size") * 2.0).alias("x")).agg(F.avg("p_retailprice").alias("y"))


_SEGMENTS = """
WITH c AS (SELECT p_size * 2.0 AS x, avg(p_retailprice) AS y FROM part GROUP BY 1),
s AS (SELECT x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS k, count(*) OVER () AS n FROM c WINDOW w AS (ORDER BY x)),
q AS (SELECT DISTINCT l_quantity * 2.3 - 3 AS q FROM lineitem),
lim AS (SELECT min(x) AS lo, max(x) AS hi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi FROM c)
"""


def _queries_of(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_quantity") * 2.3 - 3).alias("q")).distinct()


@query(_SEGMENTS + """SELECT round(q, 4) AS q, round(CASE WHEN q <= lo THEN ylo WHEN q >= hi THEN yhi ELSE y0 + (y1 - y0) * (q - x0) / (x1 - x0) END, 4) AS v
FROM q CROSS JOIN lim LEFT JOIN s ON q >= x0 AND q < x1""")
def interp_clamped(spark, d):
    return joins.interpolate(_queries_of(spark, d), _curve(spark, d), "x", "y", "q", "v").select(_r("q").alias("q"), _r("v").alias("v"))


@query(_SEGMENTS + """SELECT round(q, 4) AS q, round(y0 + (y1 - y0) * (q - x0) / (x1 - x0), 4) AS v
FROM q JOIN s ON x1 IS NOT NULL AND (q >= x0 OR k = 1) AND (q < x1 OR k = n - 1)""")
def interp_extrapolated(spark, d):
    return joins.interpolate(_queries_of(spark, d), _curve(spark, d), "x", "y", "q", "v", extrapolate=True).select(_r("q").alias("q"), _r("v").alias("v"))


@query(_SEGMENTS + """SELECT round(q, 4) AS q, round(1 / (CASE WHEN q <= lo THEN 1 / ylo WHEN q >= hi THEN 1 / yhi ELSE 1 / y0 + (1 / y1 - 1 / y0) * (q - x0) / (x1 - x0) END), 4) AS v
FROM q CROSS JOIN lim LEFT JOIN s ON q >= x0 AND q < x1""")
def interp_inverse(spark, d):
    return joins.interpolate_inverse(_queries_of(spark, d), _curve(spark, d), "x", "y", "q", "v").select(_r("q").alias("q"), _r("v").alias("v"))


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) AS x, value AS y, lead(epoch_us(ts)) OVER w AS x1, lead(value) OVER w AS y1 FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
f AS (SELECT user_id, arg_min(y, x) AS y FROM s GROUP BY 1),
p AS (SELECT event_id, user_id, epoch_us(ts) AS q FROM events WHERE event_type = 'purchase')
SELECT p.event_id, round(CASE WHEN s.x IS NULL THEN f.y WHEN s.x1 IS NULL THEN s.y ELSE s.y + (s.y1 - s.y) * (q - s.x) / (s.x1 - s.x) END, 4) AS value
FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND q >= s.x LEFT JOIN f ON f.user_id = p.user_id""")
def time_interp_series(spark, d):
    us = lambda df: df.withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")))
    series = us(_events(spark, d, "click")).select("user_id", "x", F.col("value").alias("y"))
    m = temporal.interpolate_at(us(_events(spark, d, "purchase")).withColumnRenamed("x", "q").withColumnRenamed("value", "own"), series, ["user_id"], "q", "x", "y")
    return m.select("event_id", _r("value").alias("value"))


@query("""
SELECT user_id, round(greatest(coalesce(stddev_pop(v), 1.0), coalesce(0.05 * avg(abs(v)), 1.0), 1.0), 4) AS scale
FROM (SELECT user_id, CASE WHEN value > 100 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""")
def robust_scale(spark, d):
    v = _events(spark, d).withColumn("v", F.when(F.col("value") <= 100, F.col("value")))
    return v.groupBy("user_id").agg(_r(agg.robust_scale(F.col("v"), 1.0)).alias("scale"))


@query("""
WITH s AS (SELECT event_type, greatest(coalesce(stddev_pop(value), 0), coalesce(0.05 * avg(abs(value)), 0), coalesce(0.05 * avg(abs(user_id)), 1), 1) AS s FROM events GROUP BY 1)
SELECT event_type, round(greatest(s, 1e-3 * max(s) OVER ()), 4) AS scale FROM s""")
def phase_scale_floor(spark, d):
    return agg.phase_scales(_events(spark, d), "event_type", "value", "user_id").select("event_type", _r("scale").alias("scale"))


@query("""
WITH r AS (SELECT event_type, greatest(min(value) - 1.5 * stddev_pop(value), 0.0) AS lo, least(max(value) + 1.5 * stddev_pop(value), 900.0) AS hi FROM events GROUP BY 1)
SELECT event_type, round(lo, 4) AS lo, round(CASE WHEN hi > lo THEN hi ELSE lo + 1 END, 4) AS hi FROM r""")
def range_widen_sigma(spark, d):
    return agg.widened_range(_events(spark, d), ["event_type"], "value", low=0.0, high=900.0).select("event_type", _r("lo").alias("lo"), _r("hi").alias("hi"))


@query("SELECT event_id, round(coalesce(least(greatest(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, 5.0), 80.0), 5.0), 4) AS v FROM events")
def clip_into_range(spark, d):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return _events(spark, d).select("event_id", _r(agg.clipped(v, F.lit(5.0), F.lit(80.0))).alias("v"))


@query("SELECT l_returnflag, l_linestatus, round(sqrt(avg(pow(l_extendedprice / 1000 - l_quantity, 2))), 6) AS rmse FROM lineitem GROUP BY 1, 2")
def rmse_by_group(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    return agg.rmse(li, ["l_returnflag", "l_linestatus"], "p", "l_quantity").select("l_returnflag", "l_linestatus", _r("rmse", 6).alias("rmse"))


_WEIGHTS = {"click": 1.0, "view": 0.5, "purchase": 2.0}


@query("""
SELECT event_type, count(*) AS n, round(avg(value * value), 4) AS loss,
round(CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 2.0 ELSE 0 END * avg(value * value), 4) AS weighted FROM events GROUP BY 1""")
def group_loss_weighted(spark, d):
    return agg.group_losses(_events(spark, d), "event_type", "value", _WEIGHTS).select("event_type", "n", _r("loss").alias("loss"), _r("weighted").alias("weighted"))


@query("""
SELECT event_type, round(sum(r * r), 4) AS loss FROM (
SELECT event_type, sqrt(2.0 / count(*) OVER (PARTITION BY event_type)) * value AS r FROM events) GROUP BY 1""")
def residual_rows_identity(spark, d):
    return agg.residual_rows(_events(spark, d), "event_type", "value", F.lit(2.0)).groupBy("event_type").agg(_r(F.sum(F.col("row") * F.col("row"))).alias("loss"))


@query("""
SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS filled
FROM (SELECT *, CASE WHEN value > 40 THEN NULL ELSE value END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def forward_back_fill(spark, d):
    v = _events(spark, d).withColumn("v", F.when(F.col("value") <= 40, F.col("value")))
    return temporal.fill(v, ["user_id"], ["ts"], "v").select("event_id", _r("filled").alias("filled"))


@query("""
WITH s AS (SELECT event_id, abs(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts), value)) AS s FROM events)
SELECT event_id, round(1 + 2.0 * s / (SELECT max(s) FROM s), 4) AS boost FROM s""")
def transient_boost(spark, d):
    return temporal.transient(_events(spark, d), ["user_id"], ["ts"], "value", 2.0).select("event_id", _r("boost").alias("boost"))


@query("""
WITH m AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(first_value(CASE WHEN event_type = 'signup' THEN value END) OVER w + sum(CASE WHEN event_type = 'signup' THEN 0 ELSE value END) OVER w, 4) AS clock
FROM m WINDOW w AS (PARTITION BY user_id, island ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def running_clock_islands(spark, d):
    reset = F.when(F.col("event_type") == "signup", F.col("value"))
    return temporal.running_clock(_events(spark, d), ["user_id"], ["ts"], reset, F.col("value")).select("event_id", _r("clock").alias("clock"))


@query("""
WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def rle_islands(spark, d):
    return windows.run_lengths(_events(spark, d), ["user_id"], ["ts"], "event_type").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


@query("""
SELECT l_suppkey, l_linenumber, first_pos, dense_rank() OVER (ORDER BY first_pos) - 1 AS vertex_id
FROM (SELECT l_suppkey, l_linenumber, min(l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber) AS first_pos FROM lineitem GROUP BY 1, 2)""")
def first_appearance_ids(spark, d):
    pos = F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return windows.first_appearance_ids(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], pos).select("l_suppkey", "l_linenumber", "first_pos", F.col("vertex_id").cast("long").alias("vertex_id"))


@query("""
WITH z AS (SELECT *, exp(l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY l_orderkey)) AS e FROM lineitem)
SELECT l_orderkey, round(sum(w * w), 6) AS concentration FROM (SELECT l_orderkey, e / sum(e) OVER (PARTITION BY l_orderkey) AS w FROM z) GROUP BY 1""")
def softmax_donor_weights(spark, d):
    z = windows.softmax(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") / 10)
    return z.groupBy("l_orderkey").agg(_r(F.sum(F.col("weight") * F.col("weight")), 6).alias("concentration"))


@query("""
WITH t AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) + 1e-8 AS s FROM customer)
SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, t""")
def standardize_columns(spark, d):
    return windows.standardized(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", _r("c_acctbal", 6).alias("c_acctbal"))


@query("""
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS r FROM events)
WHERE r <= CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 4 ELSE 2 END""")
def retain_last_n(spark, d):
    return windows.retain_last(_events(spark, d), ["event_type", "user_id"], ["ts"], {"click": 12, "view": 4}, "event_type", 2).select("event_id")


@query("""
WITH s AS (SELECT avg(sd) * 0.5 AS cell FROM (SELECT i, stddev_pop(embedding[i]) AS sd FROM embeddings, unnest(generate_series(1, 64)) AS u(i) GROUP BY i)),
q AS (SELECT [floor(x / cell + 0.5) FOR x IN embedding] AS q FROM embeddings, s)
SELECT count(*) AS n_rows, count(DISTINCT q) AS n_distinct FROM q""")
def distinct_quantized_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return agg.quantized_distinct(e, "v", 64, 0.5)


@query("""
WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(generate_series(1, 64)) AS u(i) GROUP BY i),
n AS (SELECT vec_id, sqrt(sum(pow(embedding[i]::DOUBLE - m, 2))) AS n FROM embeddings, m GROUP BY 1)
SELECT round(avg((n < 0.9 * (SELECT max(n) FROM n))::INT), 6) AS blind FROM n""")
def blind_fraction(spark, d):
    e = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return agg.blind_fraction(e, "v", 64, 0.9).select(_r("blind", 6).alias("blind"))


@query("""
WITH g AS (SELECT *, avg(p_retailprice) OVER (PARTITION BY p_size) AS m, avg(p_retailprice) OVER () AS t FROM part)
SELECT round(sum(pow(p_retailprice - m, 2)) / sum(pow(p_retailprice - t, 2)), 6) AS within_share FROM g""")
def anova_within_total(spark, d):
    return agg.anova_share(table(spark, d, "part"), "p_size", "p_retailprice").select(_r("within_share", 6).alias("within_share"))


@query("""
SELECT c_mktsegment, c_nationkey, round(s / sum(s) OVER (), 8) AS share, s / sum(s) OVER () >= 0.008 AS keep
FROM (SELECT c_mktsegment, c_nationkey, sum(abs(c_acctbal)) AS s FROM customer GROUP BY 1, 2)""")
def share_keep_threshold(spark, d):
    c = table(spark, d, "customer").withColumn("w", F.abs("c_acctbal"))
    return agg.share_keep(c, ["c_mktsegment", "c_nationkey"], "w", 0.008).select("c_mktsegment", "c_nationkey", _r("share", 8).alias("share"), "keep")


@query("""
SELECT l_returnflag, round(median(e), 6) AS p50, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS top
FROM (SELECT l_returnflag, abs(l_extendedprice / 1000 - l_quantity) / greatest(l_quantity, 1) AS e FROM lineitem) GROUP BY 1""")
def relative_error_quantiles(spark, d):
    e = table(spark, d, "lineitem").withColumn("e", agg.relative_error(F.col("l_extendedprice") / 1000, F.col("l_quantity")))
    return agg.exact_quantiles(e, ["l_returnflag"], "e", {"p50": 0.5, "p95": 0.95}).select("l_returnflag", _r("p50", 6).alias("p50"), _r("p95", 6).alias("p95"), _r("top", 6).alias("top"))


@query("""
WITH t AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS phase, round(s, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS r FROM t) WHERE r = 1""")
def argmax_phase(spark, d):
    m = agg.largest(_events(spark, d), ["user_id"], "event_type", "value")
    return m.select("user_id", F.col("event_type").alias("phase"), _r("total").alias("total"))


@query("""
WITH c AS (SELECT user_id, event_id, event_type, value - 50 AS q FROM events),
dir AS (SELECT user_id, coalesce(sign(max(q) FILTER (event_type = 'signup')), 0) AS dir FROM c GROUP BY 1)
SELECT event_id, dir::INT AS dir, (dir = 0 OR sign(q) = dir) AS kept FROM c JOIN dir USING (user_id)""")
def flow_direction_mask(spark, d):
    c = _events(spark, d).select("user_id", "event_id", "event_type", (F.col("value") - 50).alias("q"))
    top = c.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("q"))).alias("q_ctrl"))
    way = top.select("user_id", F.coalesce(scalars.flow_direction(F.lit(True), F.col("q_ctrl"), F.lit(0.0)), F.lit(0.0)).cast("int").alias("dir"))
    return c.join(way, "user_id").select("event_id", "dir", ((F.col("dir") == 0) | (F.signum("q") == F.col("dir"))).alias("kept"))


@query("""
SELECT o_orderkey, abs(s) < 0.99 * abs(o_totalprice) AND n > 1 AS binding, round(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE s END, 2) AS q_pin
FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def binding_flag(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n"))
    j = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    pin = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")).otherwise(F.col("s"))
    return j.select("o_orderkey", scalars.binding("s", "o_totalprice", F.col("n") > 1).alias("binding"), _r(pin, 2).alias("q_pin"))


@query("""
WITH s AS (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part)),
pick AS (SELECT DISTINCT round_even(i * (n - 1) / 7.0, 0)::INT AS k FROM (SELECT max(n) AS n FROM s), unnest(generate_series(0, 7)) AS u(i))
SELECT p_partkey FROM part JOIN s USING (p_size) JOIN pick USING (k)""")
def even_step_subset(spark, d):
    return joins.even_subset(table(spark, d, "part"), "p_size", 8).select("p_partkey")


@query("""
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM events),
pick AS (SELECT DISTINCT round_even(i * (m - 1) / 99.0, 0)::BIGINT AS k FROM (SELECT max(n) AS m FROM n), unnest(generate_series(0, 99)) AS u(i))
SELECT event_id FROM n JOIN pick USING (k)""")
def strided_cap(spark, d):
    ids = windows.first_appearance_ids(_events(spark, d), ["event_id"], F.unix_micros(F.col("ts").cast("timestamp")), "k")
    return sampling.capped(ids, "k", ids.count(), 100).select("event_id")


@query("SELECT c_custkey, round(c_acctbal * 14.503774, 4) AS psia, round(c_nationkey * 3.28084::DOUBLE, 4) AS ft, round(c_acctbal * 6.28981, 4) AS bbl, round(c_acctbal * 0.0353147, 4) AS mscf FROM customer")
def unit_normalize(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("psia"), F.col("c_nationkey").cast("double").alias("ft"), F.col("c_acctbal").alias("bbl"), F.col("c_acctbal").alias("mscf"))
    u = units.to_field(c, {"psia": "pressure", "ft": "length", "bbl": "liquid", "mscf": "gas"}, "METRIC")
    return u.select("c_custkey", *[_r(x).alias(x) for x in ("psia", "ft", "bbl", "mscf")])


@query("""
SELECT c_custkey, arg_min(s_suppkey, struct_pack(d := pow(c_acctbal - s_acctbal, 2), i := s_suppkey)) AS nearest_id
FROM customer, supplier GROUP BY 1""")
def nearest_reference(spark, d):
    return joins.nearest_on_axis(table(spark, d, "customer"), table(spark, d, "supplier"), "s_suppkey", "c_acctbal", "s_acctbal").select("c_custkey", "nearest_id")


@query("""
WITH l AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS matched, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'view')
SELECT event_id, k, matched FROM l LEFT JOIN r USING (user_id, k)""")
def multiset_match(spark, d):
    m = joins.match_multiset(_events(spark, d, "click"), _events(spark, d, "view"), ["user_id"], ["ts"], ["ts"], "event_id")
    return m.select("event_id", F.col("k").cast("long").alias("k"), "matched")


@query("""
SELECT p_partkey, pat AS pattern FROM part JOIN (SELECT DISTINCT substr(p_type, 1, 4) || '*' AS pat FROM part) ON starts_with(p_type, rtrim(pat, '*'))""")
def prefix_wildcard_join(spark, d):
    pats = table(spark, d, "part").select(F.concat(F.substring("p_type", 1, 4), F.lit("*")).alias("pattern")).distinct()
    return joins.prefix_join(table(spark, d, "part").select("p_partkey", "p_type"), pats, "p_type", "pattern", 4).select("p_partkey", "pattern")


@query("""
WITH a AS (SELECT c_custkey, md5(c_name) AS s FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE md5(c_name) END AS s FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'appeared' WHEN b.c_custkey IS NULL THEN 'vanished' ELSE 'changed' END AS reason
FROM a FULL JOIN b USING (c_custkey) WHERE a.s IS DISTINCT FROM b.s""")
def stale_signature_diff(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.md5("c_name").alias("s"))
    new = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(F.md5("c_name")).alias("s"))
    return joins.signature_diff(old, new, "c_custkey", "s")


@query("""
SELECT p_partkey, CASE WHEN p_size IN (1, 50) THEN 'boundary' WHEN p_brand LIKE '%1' THEN 'well' WHEN p_retailprice > 1800 THEN 'aquifer' ELSE 'interior' END AS category FROM part""")
def category_buckets(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.category(F.col("p_size").isin(1, 50), F.col("p_brand").endswith("1"), F.col("p_retailprice") > 1800).alias("category"))


@query("""
SELECT l_suppkey, l_linenumber, round(sum(l_extendedprice), 2) AS val FROM lineitem GROUP BY 1, 2""")
def coo_assemble(spark, d):
    return agg.assemble(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_extendedprice").select("l_suppkey", "l_linenumber", _r("val", 2).alias("val"))


@query("""
SELECT l_suppkey AS row, round(sum(l_quantity * o_totalprice / 1000), 2) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def sparse_matvec(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_orderkey").alias("col"), F.col("l_quantity").alias("val"))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("col"), (F.col("o_totalprice") / 1000).alias("x"))
    return agg.matvec(t, x).select("row", _r("y", 2).alias("y"))


@query("""
WITH l AS (SELECT l_suppkey AS node, date_trunc('month', l_shipdate)::DATE AS d, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE, sum(l_discount) FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2),
t AS (SELECT node, d, sum(v) AS t FROM l GROUP BY 1, 2)
SELECT node, strftime(d, '%Y-%m') AS month, round(t, 4) AS total, round(sum(t) OVER (PARTITION BY node ORDER BY d ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM t""")
def outer_add_align_cum(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("d"), "l_quantity", "l_discount", "l_linenumber")
    parts = [li.select("node", "d", F.col("l_quantity").alias("v")), li.filter("l_linenumber > 3").select("node", "d", F.col("l_discount").alias("v"))]
    return agg.add_aligned(parts, "node", "d", "v").select("node", F.date_format("d", "yyyy-MM").alias("month"), _r("total").alias("total"), _r("cumulative").alias("cumulative"))


@query("SELECT p_partkey, u.k::INT AS k FROM part, unnest(generate_series(least(p_size, 25), greatest(p_size, 25))) AS u(k)")
def layer_explode(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(scalars.layers(F.col("p_size"), F.lit(25))).alias("k"))


@query("""
SELECT p_partkey, string_agg(v, ' ' ORDER BY i, j) AS expanded FROM (
SELECT p_partkey, i, j, CASE WHEN t LIKE '%*%' THEN split_part(t, '*', 2) ELSE t END AS v
FROM (SELECT p_partkey, i, [p_size || '*' || (p_size % 3), p_size::VARCHAR, '2*7'][i] AS t FROM part, unnest([1, 2, 3]) AS u(i)),
unnest(generate_series(1, CASE WHEN t LIKE '%*%' THEN split_part(t, '*', 1)::INT ELSE 1 END)) AS w(j)) GROUP BY 1""")
def repeat_token_expand(spark, d):
    line = F.concat(F.col("p_size").cast("string"), F.lit("*"), (F.col("p_size") % 3).cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" 2*7"))
    return table(spark, d, "part").select("p_partkey", F.array_join(scalars.expand_repeats(F.split(line, " ")), " ").alias("expanded"))


@query("""
SELECT p_partkey, upper(trim(split_part(p_type || ' /  -- ' || p_name, '--', 1))) AS line,
len(list_filter(regexp_extract_all(upper(split_part(p_type || ' /  -- ' || p_name, '--', 1)), '[^ ]+'), lambda x: x <> '/'))::INT AS n_tokens FROM part""")
def comment_strip_tokens(spark, d):
    raw = F.concat("p_type", F.lit(" /  -- "), "p_name")
    return table(spark, d, "part").select("p_partkey", scalars.strip_comment(raw).alias("line"), F.size(scalars.tokens(raw)).alias("n_tokens"))


@query("SELECT event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def message_json_path(spark, d):
    m = _events(spark, d).filter(F.col("event_type").isin("click", "view")).withColumnRenamed("props", "payload")
    return m.groupBy(F.col("event_type").alias("kind"), messages.field_of("7.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT user_id, ts, epoch_us(ts) / 8.64e10 AS x, min(epoch_us(ts) / 8.64e10) OVER (PARTITION BY user_id) AS x0 FROM events),
d AS (SELECT c, ln(ln(1 + (x - x0) / c) - lag(ln(1 + (x - x0) / c)) OVER (PARTITION BY user_id, c ORDER BY ts)) AS v FROM t, (SELECT pow(2.0, i) AS c FROM unnest(generate_series(-6, 6)) AS u(i))),
g AS (SELECT c, round(avg(v - 0.0), 6) AS score FROM d GROUP BY c)
SELECT c, score, score = (SELECT max(score) FROM g) AS best FROM g""")
def time_warp_argmax(spark, d):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(8.64e10)
    w = Window.partitionBy("user_id")
    t = _events(spark, d).select("user_id", "ts", x.alias("x")).withColumn("s", F.col("x") - F.min("x").over(w))
    scored = scalars.warp_scores(t, ["user_id"], "ts", "s", [2.0**i for i in range(-6, 7)]).withColumn("score", _r("score", 6))
    return agg.with_totals(scored, F.max("score").alias("m")).select("c", "score", (F.col("score") == F.col("m")).alias("best"))


@query("""
WITH w AS (SELECT p_partkey, c, exp(-pow((p_retailprice - c) / 200, 2) / 2) AS g FROM part, (SELECT (1000 + 200 * i)::DOUBLE AS c FROM unnest(generate_series(0, 4)) AS u(i)))
SELECT p_partkey, c, round(g / sum(g) OVER (PARTITION BY p_partkey), 6) AS share FROM w""")
def gaussian_partition(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.explode(F.array(*[F.lit(1000.0 + 200 * i) for i in range(5)])).alias("c"))
    g = F.exp(-F.pow((F.col("p_retailprice") - F.col("c")) / 200, 2) / 2)
    return windows.normalized(p, ["p_partkey"], g).select("p_partkey", "c", _r("share", 6).alias("share"))


@query("SELECT event_id, round(10 + 90 / (1 + exp(-(value - 50) / 20)), 4) AS p FROM events")
def primaries_sigmoid(spark, d):
    return _events(spark, d).select("event_id", _r(scalars.anchored_sigmoid((F.col("value") - 50) / 20, 10.0, 100.0)).alias("p"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN l_discount > 0.05 THEN l_discount / 0.001127 ELSE 2 * pi() * l_quantity * sqrt(l_extendedprice) / (ln(l_extendedprice / 0.5) + l_tax) END, 4) AS wi FROM lineitem""")
def wellindex_precedence(spark, d):
    explicit = F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    wi = scalars.well_index(explicit, F.col("l_quantity"), F.col("l_extendedprice"), F.lit(1.0), F.col("l_extendedprice"), F.lit(None).cast("double"), F.col("l_tax"), conversion=0.001127)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", _r(wi).alias("wi"))


@query("""
SELECT o_orderkey, round(0.99731 * least(greatest((o_totalprice + sum(l_quantity * l_discount * 100)) / greatest(sum(l_quantity), 1e-12), 10.0), 9000.0), 4) AS p_bh
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice""")
def closed_form_elimination(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    p = scalars.closed_form_bhp("o_totalprice", "l_quantity", F.col("l_discount") * 100, 10.0, 9000.0)
    return j.groupBy("o_orderkey", "o_totalprice").agg(_r(0.99731 * p).alias("p_bh")).select("o_orderkey", "p_bh")


@query("SELECT event_id FROM events ORDER BY md5(event_id || '/30'), event_id LIMIT 200")
def hash_sample_window(spark, d):
    return scalars.sample_rows(_events(spark, d), "event_id", 30, 200).select("event_id")


@query("""
WITH s AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, l_discount AS c, l_tax AS r FROM lineitem)
SELECT * FROM (SELECT 0 AS i, 0 AS j, round(sum(a * a), 4) AS g FROM s UNION ALL SELECT 0, 1, round(sum(a * b), 4) FROM s UNION ALL SELECT 0, 2, round(sum(a * c), 4) FROM s
UNION ALL SELECT 1, 1, round(sum(b * b), 4) FROM s UNION ALL SELECT 1, 2, round(sum(b * c), 4) FROM s UNION ALL SELECT 2, 2, round(sum(c * c), 4) FROM s
UNION ALL SELECT 0, -1, round(2 * sum(a * r), 4) FROM s UNION ALL SELECT 1, -1, round(2 * sum(b * r), 4) FROM s UNION ALL SELECT 2, -1, round(2 * sum(c * r), 4) FROM s)""")
def gramian_normal_eq(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("r"))
    return agg.gramian(s, ["a", "b", "c"], "r").select("i", "j", _r("g").alias("g"))
