"""Decks written from the driver's tables and read back by the deck source, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.plans.registry import query, table
from terrane.plans.storage import shared_dir
from terrane.sources import deck


def _decks(spark, d):
    """Records of a deck a nation: its customers are the steps of a schedule, in files of text that the deck source reads."""
    c = table(spark, d, "customer")
    key, well, bal = F.col("c_custkey"), F.concat(F.lit("'W"), (F.col("c_custkey") % 7).cast("string"), F.lit("'")), F.abs("c_acctbal").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    produce = F.array(F.lit("WCONPROD -- a comment"), say("  ", well, " OPEN ORAT ", bal, " 4* ", key % 50 + 100, " / left out"), F.lit("/"))
    inject = F.array(F.lit("wconinje"), say(well, " 'WATER' OPEN RATE"), say(" ", bal, " 1* ", key % 40 + 200, " /"), F.lit("/"))
    shut = F.array(F.lit("WELOPEN"), say(well, " SHUT /"), F.lit("/"))
    complete = F.array(F.lit("COMPDAT"), say(well, " ", F.when(key % 2 == 0, "2*").otherwise(say(key % 9 + 1, " ", key % 5 + 1)), " ", key % 4 + 1, " ", key % 6 + 1, " OPEN 1* ", key % 11 + 1, " /"), F.lit("/"))
    step = F.array(F.lit("TSTEP"), say(" ", key % 3, " 1.0 /"))
    rows = F.concat(F.when(key % 3 == 0, produce).when(key % 3 == 1, inject).otherwise(shut), complete, step)
    body = c.select(F.col("c_nationkey").alias("deck"), key.cast("long").alias("at"), F.posexplode(rows).alias("n", "value"))
    n = F.col("n_nationkey")
    wells = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda w: F.concat(F.lit("'W"), w.cast("string"), F.lit("' G "), (w + 1).cast("string"), F.lit(" "), (w + n).cast("string"), F.lit(" /")))
    many = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("many"))
    top = F.concat(F.array(F.lit("-- made from tables"), F.lit("RUNSPEC"), F.when(n % 2 == 0, "METRIC").otherwise("FIELD"), F.lit("START"), F.lit("  1 'JLY' 2019 /"), F.lit("GRID"), F.lit("PORO"), say("  ", F.col("many"), "*0.25 ", n + 1, "*0.5 /"), F.lit("SCHEDULE"), F.lit("WELSPECS")), wells, F.array(F.lit("/")))
    head = table(spark, d, "nation").join(many, "n_nationkey").select(n.alias("deck"), F.lit(-1).cast("long").alias("at"), F.posexplode(top).alias("n", "value"))
    folder = shared_dir(spark)
    lines = body.unionByName(head).repartition("deck").sortWithinPartitions("deck", "at", "n")
    lines.select("deck", "value").write.partitionBy("deck").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect()  # a path a deck
    paths = sorted(r["path"].replace("file:/", "file:///", 1) if not r["path"].startswith("file:///") else r["path"] for r in files if "deck=" in r["path"])
    return deck.read(spark, ",".join(paths))


def _number(df):
    return df.withColumn("deck", F.regexp_extract("path", r"deck=(\d+)", 1).cast("int"))


_CLOCK = "WITH c AS (SELECT *, epoch(TIMESTAMP '2019-07-01')::BIGINT + coalesce(sum((c_custkey % 3 + 1) * 86400) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clock FROM customer)"


@query(_CLOCK + """
SELECT c_nationkey AS deck, 'W' || c_custkey % 7 AS well, clock AS at, ['WCONPROD', 'WCONINJE', 'WELOPEN'][c_custkey % 3 + 1] AS source, CASE WHEN c_custkey % 3 = 2 THEN 'SHUT' ELSE 'OPEN' END AS mode,
  ['ORAT', 'RATE', NULL][c_custkey % 3 + 1] AS control, CASE WHEN c_custkey % 3 = 1 THEN 'WATER' END AS phase, CASE WHEN c_custkey % 3 < 2 THEN abs(c_acctbal)::DOUBLE END AS rate, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 50 + 100 WHEN 1 THEN c_custkey % 40 + 200 END::DOUBLE AS bhpt FROM c""")
def deck_controls(spark, d):
    """The schedules of decks: producers, injectors and openings on the decks' clocks."""
    out = _number(deck.controls(_decks(spark, d)))
    return out.select("deck", "well", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "source", "mode", "control", "phase", "rate", "bhpt")


@query(_CLOCK + """
SELECT c_nationkey AS deck, 'W' || c_custkey % 7 AS well, clock AS at, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 + 1 ELSE c_custkey % 9 + 1 END::INTEGER AS i, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 + c_nationkey ELSE c_custkey % 5 + 1 END::INTEGER AS j,
  k::INTEGER AS k, 'OPEN' AS status, (c_custkey % 11 + 1)::DOUBLE AS cf FROM c, range(1, 7) AS r(k) WHERE k BETWEEN least(c_custkey % 4 + 1, c_custkey % 6 + 1) AND greatest(c_custkey % 4 + 1, c_custkey % 6 + 1)""")
def deck_completions(spark, d):
    """Completions a layer, with places out of the wells' own where they are defaulted."""
    out = _number(deck.completions(_decks(spark, d)))
    return out.select("deck", "well", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "i", "j", "k", "status", "cf")


@query(_CLOCK + """,
r AS (SELECT c_nationkey, 'W' || c_custkey % 7 AS well, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 + 1 ELSE c_custkey % 9 + 1 END AS i, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 + c_nationkey ELSE c_custkey % 5 + 1 END AS j, k, (c_custkey % 11 + 1)::DOUBLE AS cf, clock
  FROM c, range(1, 7) AS r(k) WHERE k BETWEEN least(c_custkey % 4 + 1, c_custkey % 6 + 1) AND greatest(c_custkey % 4 + 1, c_custkey % 6 + 1)),
l AS (SELECT * FROM r WHERE clock <= epoch(TIMESTAMP '2019-08-01') QUALIFY row_number() OVER (PARTITION BY c_nationkey, well, i, j, k ORDER BY c_custkey DESC) = 1)
SELECT c_nationkey AS deck, well, count(*) AS n_open, sum(cf) AS cf FROM l GROUP BY 1, 2""")
def deck_open_blocks(spark, d):
    """Blocks open at a date: the last word on each."""
    out = deck.open_blocks(deck.completions(_decks(spark, d)), F.lit("2019-08-01").cast("timestamp_ntz"))
    return _number(out).groupBy("deck", "well").agg(F.count(F.lit(1)).alias("n_open"), F.sum("cf").alias("cf"))


@query("""
SELECT c_nationkey AS deck, count(*) + c_nationkey + 1 AS n_values, (count(*) * 0.25 + (c_nationkey + 1) * 0.5)::DOUBLE AS total, CASE WHEN c_nationkey % 2 = 0 THEN 'METRIC' ELSE 'FIELD' END AS unit_system, 'standard' AS kind, 'default' AS oil_model, 7 AS n_wells
FROM customer GROUP BY c_nationkey""")
def deck_facts(spark, d):
    """Arrays with repeats, units, kind, model and groups of each deck."""
    records = _decks(spark, d)
    a = _number(deck.array(records, "PORO")).groupBy("deck").agg(F.count("value").alias("n_values"), F.sum("value").alias("total"))
    wells = _number(deck.tree_parents(records)).filter("parent = 'G'").groupBy("deck").agg(F.count(F.lit(1)).cast("int").alias("n_wells"))
    for facts in (deck.unit_system(records), deck.deck_kind(records), deck.oil_model(records)):
        a = a.join(_number(facts).drop("path"), "deck")
    return a.join(wells, "deck").select("deck", "n_values", F.col("total"), "unit_system", "kind", "oil_model", "n_wells")
