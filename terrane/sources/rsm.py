"""Summary reports in fixed-width columns (RSM): blocks of 13-character fields.

A block starts after a page line, has rows of names, units, multipliers, wells and numbers,
and then values. One partition reads one report; values come out long.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 13


def fields(line: Column) -> Column:
    """Fixed-width fields, trimmed."""
    n = F.ceil(F.length(line) / WIDTH).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.trim(F.substring(line, k * WIDTH + 1, F.lit(WIDTH))))


def multiplier(text: Column) -> Column:
    """``*10**3`` as 1000; blank as 1."""
    power = F.regexp_extract(text, r"\*10\*\*(-?\d+)", 1)
    return F.when(power == "", 1.0).otherwise(F.pow(F.lit(10.0), power.cast("double")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, block, row, name, unit, well and value (with its multiplier)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    blocks = text.select("path", F.posexplode(F.split("value", r"(?m)^1?\s*(?:SUMMARY OF RUN|\s*PAGE).*$")).alias("block", "body"))
    lines = blocks.select("path", "block", F.filter(F.split("body", "\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^-+$")).alias("l")).filter(F.size("l") > 3)
    first_value = lambda l: F.size(F.filter(l, lambda x: ~F.trim(x).rlike(r"^[-+.0-9]")))
    parts = lines.select("path", "block", first_value(F.col("l")).alias("h"), "l").filter("h >= 2")
    typed = parts.select("path", "block", fields(F.get("l", 0)).alias("names"), fields(F.get("l", 1)).alias("units"), F.when(F.exists(F.slice("l", 3, F.greatest(F.col("h") - 2, F.lit(0))), lambda x: x.contains("*10**")), fields(F.get(F.filter("l", lambda x: x.contains("*10**")), F.lit(0)))).alias("mult"), fields(F.get("l", F.col("h") - 1)).alias("wells"), F.slice("l", F.col("h") + 1, 1 << 20).alias("body"))
    rows = typed.select("path", "block", "names", "units", "mult", "wells", F.posexplode("body").alias("row", "line"))
    cells = rows.select("path", "block", "row", "names", "units", "mult", "wells", F.posexplode(fields(F.col("line"))).alias("c", "v"))
    get = lambda a: F.get(a, F.col("c"))
    return cells.select("path", "block", "row", get("names").alias("name"), get("units").alias("unit"), F.nullif(get("wells"), F.lit("")).alias("well"), (F.col("v").try_cast("double") * F.coalesce(multiplier(get("mult")), F.lit(1.0))).alias("value")).filter(F.col("name") != "")


def is_well_name(name: str) -> bool:
    return bool(re.match(r"[A-Za-z0-9]", name))
