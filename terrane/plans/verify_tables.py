"""Loaders, trees, array actions and the ordered stream bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import arrays, sql_functions
from terrane.operators import cells, layout, temporal, tree, windows
from terrane.plans.registry import query, table
from terrane.sources import cases, well_text
from terrane.plans.storage import shared_dir
from terrane.streaming import messages, run_stream


def _r(c, n: int = 4):
    return F.round(c, n)


def _lines(spark, d, text):
    """A file for each user, a line for each event."""
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), text.alias("text"))


def _v(n=0.0):
    return F.format_string("%.2f", F.col("value") + n)


def _head():
    return F.concat(F.lit("'W"), F.col("user_id").cast("string"), F.lit("' "), F.date_format("ts", "dd.MM.yyyy"), F.lit(" "))


@query("""
SELECT event_id AS line_no, 'W' || user_id || CASE WHEN event_id % 3 = 0 THEN ':2' ELSE '' END AS well, strftime(ts, '%Y-%m-%d') AS day, round(value, 2) AS l1, round(value + 10, 2) AS l2, 0.1524::DOUBLE AS rad, 0.0::DOUBLE AS skin, 0.5::DOUBLE AS mult, event_id % 2 = 0 AS close
FROM events WHERE event_type = 'view'""")
def event_perforations(spark, d):
    k = F.col("event_id")
    text = F.concat(_head(), F.when(F.col("event_type") == "view", F.concat(F.lit("perforation "), _v(), F.lit(" "), _v(10), F.lit(" 2* 0.5"))).when(F.col("event_type") == "error", "SQUE 1 2").otherwise(F.concat(F.lit("PROD OIL "), _v())), F.when(k % 3 == 0, " BRANCH 2").otherwise(""), F.when(k % 2 == 0, " CLOSE").otherwise(""))
    p = well_text.perforations(_lines(spark, d, text), ["L1", "L2", "RAD", "SKIN", "MULT"])
    return p.select("line_no", "well", F.date_format("date", "yyyy-MM-dd").alias("day"), "l1", "l2", "rad", "skin", "mult", "close")


@query("""
SELECT event_id AS line_no, 'W' || user_id AS well, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 'PROD' WHEN 'signup' THEN 'INJE' WHEN 'purchase' THEN 'STOP' END AS mode,
  CASE WHEN event_type = 'click' THEN round(value + 5, 2) END AS oil, CASE WHEN event_type = 'signup' THEN round(value, 2) END AS wit, CASE WHEN event_type IN ('click', 'signup') THEN round(value + 100, 2) END AS bhpt
FROM events WHERE event_type NOT IN ('view', 'error')""")
def event_controls(spark, d):
    kind = F.col("event_type")
    body = F.when(kind == "view", "PERF 1 2").when(kind == "error", "SQUE 1 2").when(kind == "click", F.concat(F.lit("PROD OIL "), _v(), F.lit(" bhpt "), _v(100), F.lit(" OIL "), _v(5))).when(kind == "signup", F.concat(F.lit("INJE WIT "), _v(), F.lit(" BHPT "), _v(100))).otherwise("STOP")
    c = well_text.control_events(_lines(spark, d, F.concat(_head(), body)), ["OIL", "WIT", "BHPT"])
    return c.select("line_no", "well", F.date_format("date", "yyyy-MM-dd").alias("day"), "mode", "oil", "wit", "bhpt")


@query("""
WITH e AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id AS line_no, 'W' || v.user_id AS well, round(value, 2) AS qoil, round(value + 1, 2) AS qwat FROM events v LEFT JOIN e ON e.user_id = v.user_id WHERE stop IS NULL OR event_id < stop""")
def history_rows(spark, d):
    text = F.when(F.col("event_type") == "signup", "ENDH").otherwise(F.concat(_head(), _v(), F.lit(" "), _v(1)))
    return well_text.history(_lines(spark, d, text), ["QOIL", "QWAT"]).select("line_no", "well", "qoil", "qwat")


@query("""
WITH e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS track_no FROM events),
s AS (SELECT *, coalesce(bool_or(event_type = 'error') OVER w, false) AS slashed, coalesce(bool_or(event_type = 'click') OVER (PARTITION BY user_id, track_no ORDER BY event_id), false) AS worded
  FROM e WHERE track_no > 0 WINDOW w AS (PARTITION BY user_id, track_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id::VARCHAR AS path, track_no, 'W' || min(event_id) OVER (PARTITION BY user_id, track_no) AS well, event_id::DOUBLE AS x, round(value, 2) AS md, row_number() OVER (PARTITION BY user_id, track_no ORDER BY event_id) - 1 AS place
FROM (SELECT * FROM s WHERE NOT slashed AND NOT worded) QUALIFY event_type <> 'signup'""")
def welltracks(spark, d):
    kind = F.col("event_type")
    numbers = F.concat(F.col("event_id").cast("string"), F.lit(" 1 2 "), _v())
    text = F.when(kind == "signup", F.concat(F.lit("WELLTRACK 'w"), F.col("event_id").cast("string"), F.lit("'"))).when(kind == "error", F.concat(numbers, F.lit(" / end"))).when(kind == "click", "WORDS AND 1 2").otherwise(numbers)
    return well_text.tracks(_lines(spark, d, text)).select("path", "track_no", "well", "x", "md", (F.col("place") + 1).cast("long").alias("place"))


_TREE = """SELECT 'FIELD' AS node, NULL AS parent, 'group' AS kind UNION ALL SELECT 'R' || r_regionkey, 'FIELD', 'group' FROM region
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'group' FROM nation UNION ALL SELECT 'W' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_nationkey ELSE 'W' || (c_custkey - 1) END, 'well' FROM customer"""


def _tree(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    k = F.col("c_custkey")
    root = spark.createDataFrame([("FIELD", None, "group")], "node string, parent string, kind string")
    regions = table(spark, d, "region").select(name("R", "r_regionkey").alias("node"), F.lit("FIELD").alias("parent"), F.lit("group").alias("kind"))
    nations = table(spark, d, "nation").select(name("N", "n_nationkey").alias("node"), name("R", "n_regionkey").alias("parent"), F.lit("group").alias("kind"))
    wells = table(spark, d, "customer").select(name("W", "c_custkey").alias("node"), F.when(k % 3 == 0, name("N", "c_nationkey")).otherwise(F.concat(F.lit("W"), (k - 1).cast("string"))).alias("parent"), F.lit("well").alias("kind"))
    return root.unionByName(regions).unionByName(nations).unionByName(wells)


@query(f"""
WITH RECURSIVE t AS ({_TREE}), p AS (SELECT node, node AS path, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, p.path || '/' || t.node, p.depth + 1 FROM t JOIN p ON t.parent = p.node)
SELECT * FROM p""")
def tree_paths(spark, d):
    return tree.paths(_tree(spark, d)).select("node", F.array_join("path", "/").alias("path"), "depth")


@query(f"WITH t AS ({_TREE}) SELECT t.node, t.parent, t.kind FROM t JOIN t AS n ON t.parent = n.node JOIN t AS r ON n.parent = r.node WHERE r.parent = 'FIELD' AND n.node LIKE 'N1%' AND t.node LIKE 'W%5'")
def tree_glob(spark, d):
    return tree.glob(_tree(spark, d), "R*/N1*/W*5")


@query(f"""
WITH t AS ({_TREE}), c AS (SELECT DISTINCT 'W' || o_custkey AS node FROM orders WHERE o_totalprice > 400000),
w AS (SELECT c_custkey, 'W' || c_custkey AS node, 'W' || c_custkey IN (SELECT node FROM c) AS has FROM customer),
k AS (SELECT w.node, CASE WHEN w.c_custkey % 3 = 2 AND b.has THEN b.node WHEN w.c_custkey % 3 > 0 AND a.has THEN a.node ELSE z.parent END AS parent
  FROM w LEFT JOIN w AS b ON b.c_custkey = w.c_custkey - 1 LEFT JOIN w AS a ON a.c_custkey = w.c_custkey - w.c_custkey % 3 LEFT JOIN t AS z ON z.node = a.node WHERE w.has)
SELECT node, parent, kind FROM t WHERE kind = 'group' UNION ALL SELECT node, parent, 'well' FROM k""")
def tree_inside_wells(spark, d):
    blocks = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.concat(F.lit("W"), F.col("o_custkey").cast("string")).alias("node"))
    return tree.inside_wells(_tree(spark, d), blocks)


@query("""
WITH t AS (SELECT 'FIELD' AS node, NULL AS parent, 'group' AS kind UNION ALL SELECT 'R' || r_regionkey, 'FIELD', 'group' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'group' FROM nation
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'well' FROM supplier WHERE s_acctbal > 5000)
SELECT * FROM t WHERE kind = 'well' OR node = 'FIELD' OR node IN (SELECT parent FROM t WHERE kind = 'well') OR node IN (SELECT n.parent FROM t JOIN t AS n ON t.parent = n.node WHERE t.kind = 'well')""")
def tree_without_empty_groups(spark, d):
    groups = _tree(spark, d).filter("kind = 'group'")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    wells = table(spark, d, "supplier").filter("s_acctbal > 5000").select(name("S", "s_suppkey").alias("node"), name("N", "s_nationkey").alias("parent"), F.lit("well").alias("kind"))
    return tree.without_empty_groups(groups.unionByName(wells))


_GRID = "SELECT c_custkey % 10 AS i, c_custkey // 10 % 5 AS j, c_custkey // 50 AS k, c_acctbal AS v FROM customer"


def _grid(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select((c % 10).cast("int").alias("i"), (F.floor(c / 10) % 5).cast("int").alias("j"), F.floor(c / 50).cast("int").alias("k"), F.col("c_acctbal").alias("v"))


@query(f"WITH g AS ({_GRID}) SELECT i AS j, j AS i, k, round(least(greatest(v, 0), 5000), 2) AS v FROM (SELECT 9 - i AS i, 4 - j AS j, k, v FROM g)")
def array_actions(spark, d):
    g = arrays.clipped(_grid(spark, d), ["v"], 0.0, 5000.0)
    return arrays.turned(arrays.flipped(g, "i", 10), "i", "j", 10, 5).select("i", "j", "k", _r("v", 2).alias("v"))


@query(f"""
WITH g AS ({_GRID})
SELECT i, j, k, round(CASE WHEN lag(v) OVER w IS NULL AND lead(v) OVER w IS NULL THEN 0 WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END, 4) AS dv
FROM g WINDOW w AS (PARTITION BY j, k ORDER BY i)""")
def array_gradient(spark, d):
    return arrays.gradient(_grid(spark, d), "i", ["j", "k"], "v", "dv").select("i", "j", "k", _r("dv").alias("dv"))


@query(f"""
WITH g AS ({_GRID}), o AS (SELECT * FROM (VALUES (0, 0, 0.5), (-1, 0, 0.1), (1, 0, 0.1), (0, -1, 0.2), (0, 1, 0.1)) AS t(di, dj, w))
SELECT g.i, g.j, g.k, round(sum(w * s.v), 4) AS mean FROM g, o JOIN g AS s ON s.i = least(greatest(g.i + di, 0), 9) AND s.j = least(greatest(g.j + dj, 0), 4) AND s.k = g.k GROUP BY 1, 2, 3""")
def array_stencil(spark, d):
    kernel = {(0, 0, 0): 0.5, (-1, 0, 0): 0.1, (1, 0, 0): 0.1, (0, -1, 0): 0.2, (0, 1, 0): 0.1}
    out = arrays.filtered(_grid(spark, d), ["i", "j", "k"], {"i": 10, "j": 5, "k": 1 << 30}, "v", kernel, "mean")
    return out.select("i", "j", "k", _r("mean").alias("mean"))


@query(f"SELECT i * 2 + a AS i, j * 3 + b AS j, k, round(v, 2) AS v FROM ({_GRID}), (VALUES (0), (1)) AS x(a), (VALUES (0), (1), (2)) AS y(b)")
def array_downscale(spark, d):
    return arrays.downscaled(_grid(spark, d), {"i": 2, "j": 3}).select("i", "j", "k", _r("v", 2).alias("v"))


@query(f"""
WITH g AS (SELECT i + 1 AS i, j, round(sum(v), 2) AS v FROM ({_GRID}) GROUP BY 1, 2)
SELECT a AS i, b AS j, coalesce(v, -1) AS v FROM range(11) AS x(a), range(7) AS y(b) LEFT JOIN g ON g.i = a AND g.j = b""")
def array_pad(spark, d):
    g = _grid(spark, d).groupBy("i", "j").agg(_r(F.sum("v"), 2).alias("v"))
    return arrays.padded(g, {"i": 10, "j": 5}, {"i": 1}, {"j": 2}, ["v"], -1.0)


@query("SELECT 'tax' AS rule, count(*) FILTER (NOT (l_tax < 0.05)) AS n_broken FROM lineitem UNION ALL SELECT 'price', count(*) FILTER (NOT (l_extendedprice > 1000)) FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag <> 'N') FROM lineitem")
def rule_checks(spark, d):
    return arrays.checked(table(spark, d, "lineitem"), {"tax": F.col("l_tax") < 0.05, "price": F.col("l_extendedprice") > 1000, "flag": F.when(F.col("l_returnflag") == "N", True)})


@query("SELECT o_orderkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM orders LEFT JOIN customer ON o_custkey * 2 = c_custkey")
def gathered_rows(spark, d):
    index = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    return arrays.gathered(index, table(spark, d, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"]).select("o_orderkey", "c_nationkey", _r("c_acctbal", 2).alias("c_acctbal"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, upper('w' || l_suppkey) AS well, round(ln(1 + (l_quantity - 1) / 7), 8) AS tau, round(ln(greatest(l_quantity, 0.5) / 0.5), 8) AS lr, l_linenumber + 8 * (l_suppkey + 100 * l_partkey) AS cell,
  round(l_quantity / 5.614583 * l_discount * l_tax / 1.25, 8) AS volume FROM lineitem""")
def sql_functions_of_engine(spark, d):
    sql_functions.register(spark, "engine_")
    table(spark, d, "lineitem").createOrReplaceTempView("engine_lines")
    return spark.sql("""SELECT l_orderkey, l_partkey, l_suppkey, engine_clean_name(concat("'w", l_suppkey, "' ")) AS well, round(engine_log_time(l_quantity, 1D, 7D), 8) AS tau, round(engine_log_radius(l_quantity, 0.5D), 8) AS lr,
        engine_cell_ordinal(l_linenumber, l_suppkey, l_partkey, 8, 100) AS cell, round(engine_in_place(l_quantity, l_discount, l_tax, 1.25D), 8) AS volume FROM engine_lines""")


@query("""
WITH a AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'WOPR:' || w WHEN 1 THEN w || '/WOPR' WHEN 2 THEN 'WOPRH:' || w ELSE 'XWBHP ' || w || 'A' END AS address FROM (SELECT p_size, 'P' || (p_partkey % 40) AS w FROM part)),
q AS (SELECT v.vector, 'P' || (s_suppkey % 40) AS well FROM (SELECT DISTINCT s_suppkey % 40 AS s_suppkey FROM supplier), (VALUES ('WOPR'), ('WBHP')) AS v(vector)),
s AS (SELECT vector, well, address, string_split_regex(address, '[^A-Z0-9_]+') AS t FROM a, q WHERE contains(address, vector) AND contains(address, well)),
r AS (SELECT vector, well, address, CASE WHEN list_contains(t, vector) THEN 20 ELSE 8 END + CASE WHEN list_contains(t, well) THEN 12 ELSE 6 END + CASE WHEN starts_with(address, vector) THEN 3 ELSE 0 END + CASE WHEN ends_with(address, well) THEN 3 ELSE 0 END AS score FROM s)
SELECT vector, well, address, score FROM r QUALIFY row_number() OVER (PARTITION BY vector, well ORDER BY score DESC, length(address), address) = 1""")
def summary_addresses(spark, d):
    w, n = F.concat(F.lit("P"), (F.col("p_partkey") % 40).cast("string")), F.col("p_size") % 4
    a = table(spark, d, "part").select(F.when(n == 0, F.concat(F.lit("WOPR:"), w)).when(n == 1, F.concat(w, F.lit("/WOPR"))).when(n == 2, F.concat(F.lit("WOPRH:"), w)).otherwise(F.concat(F.lit("XWBHP "), w, F.lit("A"))).alias("address")).distinct()
    wanted = table(spark, d, "supplier").select(F.concat(F.lit("P"), (F.col("s_suppkey") % 40).cast("string")).alias("well")).distinct().select(F.explode(F.array(F.lit("WOPR"), F.lit("WBHP"))).alias("vector"), "well")
    return cases.best_addresses(a, wanted)


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS at FROM events")
def guessed_epochs(spark, d):
    e = table(spark, d, "events")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("user_id") % 3 == 0, sec).when(F.col("user_id") % 3 == 1, sec * 1000).otherwise(sec * 1000000000)
    x = cases.epoch_dates(e.select("event_id", "user_id", raw.alias("raw")), ["user_id"], "event_id", "raw")
    return x.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT o_orderkey, strftime(make_timestamp(2000 + (o_orderkey % 30)::BIGINT, greatest(1, o_custkey % 13), 1 + o_custkey % 28, o_orderkey % 24, 0, 0), '%Y-%m-%d %H') AS at FROM orders")
def dates_of_parts(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = cases.stamp(2000 + k % 30, c % 13, 1 + c % 28, k % 24)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd HH").alias("at"))


def _plan_sql(log, snap, k):
    n = "(SELECT count(*) FROM events)"
    return f"""
WITH s AS (SELECT least((i + 1) * {log}, {n}) AS iteration FROM range((({n} + {log} - 1) / {log})::BIGINT) AS r(i) WHERE i * {log} < {n}), k AS (SELECT slot FROM range({k}) AS r(slot)),
m AS (SELECT 0 AS a, 0 AS b, i AS c, 'stage' AS kind, 0 AS iteration, NULL AS slot FROM range(4) AS r(i) UNION ALL SELECT 0, 1, 0, 'grid', 0, NULL UNION ALL SELECT 0, 2, 0, 'stage', 0, NULL
UNION ALL SELECT 0, 3, slot, 'state', 0, slot FROM k UNION ALL SELECT iteration, 0, 0, 'loss', iteration, NULL FROM s
UNION ALL SELECT iteration, 1, slot, 'state', iteration, slot FROM s, k WHERE iteration % {snap} = 0 AND iteration < {n}
UNION ALL SELECT {n}, 2, slot, 'state', {n}, slot FROM k UNION ALL SELECT {n}, 3, 0, 'metrics', {n}, NULL UNION ALL SELECT {n}, 4, 0, 'stage', {n}, NULL)
SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS seq, kind, iteration, slot FROM m"""


@query(_plan_sql(3, 50, 8))
def message_plan(spark, d):
    """The plan of a run with a step for each event."""
    return run_stream.plan(spark, table(spark, d, "events").count(), 3, 50, 8)


@query("""
WITH e AS (
  SELECT user_id::VARCHAR AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value AS total, value / 4 AS pde,
         CASE WHEN event_id % 211 = 0 THEN 'lost' END AS failure, CASE WHEN event_id % 61 = 0 THEN 0.0 ELSE 0.5 END AS eta, CASE WHEN user_id % 2 = 0 THEN 40 END AS n_iter
  FROM events),
s AS (
  SELECT *, min(total) OVER (PARTITION BY run ORDER BY i) AS best,
         CASE WHEN failure IS NOT NULL THEN 'failed' WHEN eta = 0 THEN 'stalled' WHEN i >= n_iter THEN 'completed' ELSE 'running' END AS status
  FROM e),
f AS (SELECT * FROM s QUALIFY coalesce(sum((status <> 'running')::INT) OVER (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0),
l AS (SELECT *, status IN ('completed', 'stalled') AS ended, status <> 'failed' AND (i % 3 = 0 OR status IN ('completed', 'stalled')) AS logged FROM f),
k AS (SELECT slot FROM range(2) AS r(slot)),
m AS (
  SELECT run, i AS step, 0 AS g, n AS c, 'stage' AS kind, 0 AS iteration, NULL AS slot, [0.02, 0.18, 0.38, 0.55][n + 1]::DOUBLE AS total, 0.0 AS pde, '' AS said, NULL AS best FROM l, range(4) AS r(n) WHERE i = 1
  UNION ALL SELECT run, i, 1, 0, 'grid', 0, NULL, 0.0, 0.0, NULL, NULL FROM l WHERE i = 1
  UNION ALL SELECT run, i, 2, 0, 'stage', 0, NULL, 0.6, 0.0, 'steps to go: ' || coalesce(n_iter::VARCHAR, 'no end set'), NULL FROM l WHERE i = 1
  UNION ALL SELECT run, i, 3, slot, 'state', 0, slot, 0.0, 0.0, NULL, NULL FROM l, k WHERE i = 1
  UNION ALL SELECT run, i, 4, 0, 'loss', i, NULL, total, pde, NULL, NULL FROM l WHERE logged
  UNION ALL SELECT run, i, 5, 0, 'error', i, NULL, 0.0, 0.0, failure, NULL FROM l WHERE status = 'failed'
  UNION ALL SELECT run, i, 6, 0, 'stage', 0, NULL, 0.95, 0.0, 'no step helps after iteration ' || i, NULL FROM l WHERE status = 'stalled'
  UNION ALL SELECT run, i, 7, slot, 'state', i, slot, 0.0, 0.0, NULL, NULL FROM l, k WHERE logged AND NOT ended AND i % 6 = 0
  UNION ALL SELECT run, i, 8, slot, 'state', i, slot, 0.0, 0.0, NULL, NULL FROM l, k WHERE ended
  UNION ALL SELECT run, i, 9, 0, 'metrics', i, NULL, 0.0, 0.0, NULL, best FROM l WHERE ended
  UNION ALL SELECT run, i, 10, 0, 'stage', 0, NULL, 1.0, 0.0, 'ended with iteration ' || i, NULL FROM l WHERE ended)
SELECT run, step, row_number() OVER (PARTITION BY run, step ORDER BY g, c) - 1 AS place, kind, iteration::INTEGER AS iteration, slot::INTEGER AS slot, total, pde, said, best FROM m""")
def run_messages(spark, d):
    """Events as the steps of their users' runs, streamed through the state of each run."""
    e, losses = table(spark, d, "events"), {c: F.lit(0.0).alias(c) for c in ("ic", "data", "well", "wall_s")}
    failure, eta = F.when(F.col("event_id") % 211 == 0, "lost"), F.when(F.col("event_id") % 61 == 0, 0.0).otherwise(0.5)
    steps = e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("total"), (F.col("value") / 4).alias("pde"), *losses.values(), eta.alias("eta"), failure.alias("failure"), F.when(F.col("user_id") % 2 == 0, 40).alias("n_iter"))
    m = run_stream.replay(steps, shared_dir(spark), log_every=3, snapshot_every=6, n_snapshots=2)
    return m.select("run", "step", "place", "kind", "iteration", "slot", "total", "pde", messages.field_of("message").alias("said"), messages.field_of("best").cast("double").alias("best"))


@query("SELECT event_id, round(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 8.64e10, 8) AS days FROM events")
def report_days(spark, d):
    return table(spark, d, "events").select("event_id", _r(temporal.report_days(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz")), 8).alias("days"))


@query("""
SELECT event_id, round(CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 4) AS slope
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def path_slopes(spark, d):
    return windows.path_difference(table(spark, d, "events"), ["user_id"], ["ts"], "value").select("event_id", _r("slope").alias("slope"))


@query(f"""
WITH g AS (SELECT i, j, k, v, v * 0.001 * 100 * CASE WHEN k % 3 = 0 THEN 0.5 ELSE 1 END >= 250 AND k % 7 <> 0 AS active FROM ({_GRID}))
SELECT i, j, k, round(CASE WHEN active THEN v ELSE -999 END, 2) AS v, active FROM g""")
def padded_active_cells(spark, d):
    g = _grid(spark, d).withColumn("cell_id", cells.ordinal(F.col("i"), F.col("j"), F.col("k"), 10, 5)).withColumns({"poro": F.col("v") * 0.001, "volume": F.lit(100.0), "ntg": F.when(F.col("k") % 3 == 0, 0.5), "active": F.when(F.col("k") % 7 == 0, False)})
    g = cells.with_active(g, "poro", "volume", "ntg", 250.0)
    inside = cells.strip_inactive(g.select("cell_id", "v"), g)
    return cells.pad_inactive(inside, g, ["v"], -999.0).join(g.select("cell_id", "i", "j", "k", "active"), "cell_id").select("i", "j", "k", _r("v", 2).alias("v"), "active")


@query("""
WITH f AS (SELECT s_suppkey AS name, s_suppkey % 5 + 1 AS i1, s_suppkey % 7 + 1 AS i2, 2 AS j1, 3 AS j2, 1 AS k, CASE s_suppkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y-' ELSE 'Z' END AS face FROM supplier)
SELECT 'F' || name AS name, i, j, k - 1 AS k, face, CASE face WHEN 'X' THEN '1,3,5,7' WHEN 'Y-' THEN '0,1,4,5' ELSE '4,5,6,7' END AS slots
FROM f, range(10) AS a(i), range(10) AS b(j) WHERE i + 1 BETWEEN least(i1, i2) AND greatest(i1, i2) AND j + 1 BETWEEN j1 AND j2""")
def fault_faces(spark, d):
    s = F.col("s_suppkey")
    f = table(spark, d, "supplier").select(F.concat(F.lit("F"), s.cast("string")).alias("name"), (s % 5 + 1).alias("i1"), (s % 7 + 1).alias("i2"), F.lit(3).alias("j1"), F.lit(2).alias("j2"), F.lit(1).alias("k1"), F.lit(1).alias("k2"), F.when(s % 3 == 0, "x").when(s % 3 == 1, "Y-").otherwise("Z").alias("face"))
    return layout.fault_faces(f).withColumn("slots", F.array_join("slots", ","))


@query(f"WITH g AS ({_GRID}), b AS (SELECT n_nationkey AS aq, n_nationkey % 4 + 1 AS lo, n_nationkey % 4 + 3 AS hi FROM nation) SELECT aq, i + 10 * (j + 5 * k) AS cell_id FROM g JOIN b ON i BETWEEN lo - 1 AND hi - 1 AND j BETWEEN 0 AND 2 AND k BETWEEN aq AND aq + 1")
def cells_in_boxes(spark, d):
    g = _grid(spark, d).withColumn("cell_id", cells.ordinal(F.col("i"), F.col("j"), F.col("k"), 10, 5))
    n = F.col("n_nationkey")
    b = table(spark, d, "nation").select(n.alias("aq"), (n % 4 + 1).alias("i1"), (n % 4 + 3).alias("i2"), F.lit(1).alias("j1"), F.lit(3).alias("j2"), (n + 1).alias("k1"), (n + 2).alias("k2"))
    return layout.in_boxes(g, b, "aq")
